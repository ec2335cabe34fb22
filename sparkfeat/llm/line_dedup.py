"""Blocks of lines that an earlier document has too, by pairwise patience alignment.

From each line on, and up to each line, the run of lines that first reaches the length of a block is
hashed; the first document that has a run is its owner. A later document is paired with the owners of its runs: at
most two for each line, however many documents share it, and every block that an earlier document has begins, ends and
goes on with such runs. The lines of a pair are aligned with patience diff, again for what is left until no block is
found, and aligned blocks go from the later document. Blocks that stand in another order are found by their runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import join_groups
from sparkfeat.llm.patience import align
from sparkfeat.sources.staging import stage

BLOCK_CHARS = 50
_FACTOR = 0x9E3779B97F4A7C15  # an odd number, which has an inverse modulo 2 ** 64


def runs(chars: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts, ends`` of the shortest runs of ``least`` characters from each line on, and of those up to each line."""
    before = np.r_[0, np.cumsum(chars)].astype(np.int64)
    lines = np.arange(len(chars))
    after = np.searchsorted(before, before[:-1] + least)
    first = np.searchsorted(before, before[1:] - least, side="right") - 1
    on, up = after <= len(chars), first >= 0
    return np.r_[lines[on], first[up]], np.r_[after[on], lines[up] + 1]


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each run of lines; equal runs have the same. Prefix sums make a run one subtraction."""
    with np.errstate(over="ignore"):
        ahead, back = (np.r_[np.uint64(1), np.cumprod(np.full(len(hashes), np.uint64(x)))] for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
        weighed = np.r_[np.uint64(0), np.cumsum(hashes.astype(np.int64).view(np.uint64) * ahead[:-1])]
        # Line k of a run that starts at s counts FACTOR ** (k - s).
        return ((weighed[ends] - weighed[starts]) * back[starts] + (ends - starts).astype(np.uint64)).view(np.int64)


def common_blocks(a: np.ndarray, b: np.ndarray, chars: np.ndarray, least: int, a_chars: np.ndarray | None = None) -> list[int]:
    """``start, end, ...`` of the runs of lines of ``b`` aligned with consecutive lines of ``a``.

    A run counts if its lines of ``b`` (``chars`` long) have at least ``least`` characters together.
    """
    out: list[int] = []
    left, rest = list(b.tolist()), True
    earlier = a.tolist()
    while rest:
        pairs, rest, begin = align(earlier, left), False, 0
        for k in range(1, len(pairs) + 1):
            if k == len(pairs) or pairs[k] != (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1):
                start, end = pairs[begin][1], pairs[k - 1][1] + 1
                if chars[start:end].sum() >= least:
                    out += [start, end]
                    left[start:end] = [None] * (end - start)  # equals no line
                    rest = True
                begin = k
    if a_chars is not None:
        known = {tuple(earlier[i:j]) for i, j in zip(*map(np.ndarray.tolist, runs(a_chars, least)), strict=True)}
        lines = b.tolist()
        out += [x for i, j in zip(*map(np.ndarray.tolist, runs(chars, least)), strict=True) if tuple(lines[i:j]) in known for x in (i, j)]
    return _union(out)


def _union(spans: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Which lines of each document an earlier one (by id) has in a block.

    Returns ``id_col, n_lines, n_removed, n_removed_chars`` (without line ends) and ``spans``
    (start, end, ... in lines). Lines end at ``\\n`` and are compared without blanks at their ends; a
    block is a run of consecutive lines, and one of under ``block_chars`` characters stays. A null text is
    one empty line, which stays. A null id is later than any; of rows that repeat, the first one read is
    the earlier, and the others lose all that has the length of a block. An empty table gives no rows; further columns
    are ignored.

    Lines that many documents share do not gather them: the few runs of a large share of all rows meet their
    rows where these are, and an owner's lines go to as many places as hash ranges of its later documents need them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # F.trim itself would take the place of a line as the characters to trim.
    lines = F.transform(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n"), lambda x: F.trim(x))
    table = stage(docs.select(
        F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"), F.transform(lines, F.char_length).alias("chars")))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(run_hashes(h, *runs(c, block_chars))) for h, c in zip(batch["hashes"], batch["chars"], strict=True)]
            yield batch[["none", "id", "row"]].assign(runs=found)

    order = F.struct("none", "id", "row")
    shared = stage(table.select(F.col("id").isNull().alias("none"), "id", "row", "hashes", "chars").where(
        F.aggregate("chars", F.lit(0), lambda x, y: x + y) >= block_chars).mapInPandas(
        hashed, f"none boolean, id {kind}, row bigint, runs array<bigint>").select(order.alias("at"), F.explode("runs").alias("hash")))
    owners = stage(shared.groupBy("hash").agg(F.min("at").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n"))
    spread = max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = stage(join_groups(shared, owners, "hash").where("at.row != owner.row").select(
        F.col("owner.row").alias("owner"), F.col("at.row").alias("row")).distinct().withColumn("part", F.pmod(F.xxhash64("row"), F.lit(spread))))
    side = table.select(F.col("row").alias("owner"), F.col("hashes").alias("before"), F.col("chars").alias("before_chars"))
    side = pairs.select("owner", "part").distinct().join(side, "owner")
    both = pairs.join(side, ["owner", "part"]).join(table.select("row", "hashes", "chars"), "row").select(
        "row", "before", "before_chars", "hashes", "chars")

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [common_blocks(a, b, c, block_chars, d) for a, d, b, c in zip(
                batch["before"], batch["before_chars"], batch["hashes"], batch["chars"], strict=True)]
            yield pd.DataFrame({"row": batch["row"].to_numpy(), "spans": found})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [_union(list(s)) if s is not None else [] for s in batch["spans"]]
            gone = [np.concatenate([np.arange(a, b) for a, b in zip(s[::2], s[1::2], strict=True)]) if s else [] for s in spans]
            yield pd.DataFrame({
                "id": batch["id"].to_numpy(), "n_lines": [len(c) for c in batch["chars"]], "n_removed": [len(g) for g in gone],
                "n_removed_chars": [int(c[g].sum()) if len(g) else 0 for c, g in zip(batch["chars"], gone, strict=True)],
                "spans": spans})

    spans = both.mapInPandas(diff, "row bigint, spans array<bigint>").groupBy("row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"))
    done = table.select("id", "row", "chars").join(spans, "row", "left").select("id", "chars", "spans").mapInPandas(
        merge, f"id {kind}, n_lines bigint, n_removed bigint, n_removed_chars bigint, spans array<bigint>")
    return done.withColumnRenamed("id", id_col)


def without_lines(text: str | None, spans: list[int]) -> str:
    """The text without the lines in ``spans``."""
    lines = (text or "").split("\n")
    for start, end in reversed(list(zip(spans[::2], spans[1::2], strict=True))):
        del lines[start:end]
    return "\n".join(lines)
