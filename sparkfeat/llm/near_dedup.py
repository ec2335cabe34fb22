"""Near duplicates by ProbMinHash signatures of weighted word shingles.

A text's shingles of five words, weighted by how often they occur, each start a Poisson process of
that rate; every arrival falls on a random register, and a register keeps its first one. Arrivals
later than the last register's first one cannot matter, so that an element stops early. The share
of equal registers estimates the probability Jaccard similarity

    J(x, y) = sum over i of 1 / sum over j of max(x_j / x_i, y_j / y_i),

which is the usual Jaccard similarity if no shingle repeats. Bands of registers give candidates;
these are verified exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import HOT_SHARE, join_groups
from sparkfeat.llm.components import connected_components
from sparkfeat.sources.staging import stage

WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 5
TEXTS_IN_BLOCK = 256
BLOCK_BYTES = 3_000_000
CACHE_WORDS = 250_000
#: Texts that are compared with one text are dealt to so many parts.
PARTS = 64
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted shingle hashes with their counts."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, text: str | None) -> list[bytes]:
        """Runs of a-z (A-Z folded), 0-9 and characters beyond ASCII."""
        return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()

    def shingles(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of a text under five words, all of them are one shingle."""
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        single = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(WORDS, len(words))
        h = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            h = _mix(h * _GOLDEN + single[k:len(words) - width + 1 + k])
        values, counts = np.unique(h, return_counts=True)
        return values, counts.astype(np.int32)


def print_of(words: list[bytes]) -> bytes:
    """128 bits that stand for a word sequence."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash of several weighted sets: the element that is first in each register."""
    # A register holds the time of its first arrival (as float bits, which sort alike), then the element.
    first = np.full(texts * registers, np.iinfo(np.uint64).max, np.uint64)
    time = np.zeros(len(elements), np.float32)
    state, weights = elements.copy(), weights.astype(np.float32)
    low = _mix(elements ^ np.uint64(0xA5A5A5A5)) & np.uint64(0xFFFFFFFF)
    while len(state):
        state = state + _GOLDEN
        draw = _mix(state)
        uniform = ((draw >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -24)
        time = time - np.log(uniform) / weights
        register = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        key = time.view(np.uint32).astype(np.uint64) << np.uint64(32)
        np.minimum.at(first, owner * registers + register, key | low)
        last = first.reshape(texts, registers).max(1)
        open_ = np.flatnonzero(key < last[owner])
        state, time, weights, owner, low = state[open_], time[open_], weights[open_], owner[open_], low[open_]
    return (first & np.uint64(0xFFFFFFFF)).reshape(texts, registers)


def _bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band number is part of it."""
    parts = signature.reshape(len(signature), BANDS, BAND_ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(BAND_ROWS):
        h = _mix(h * _GOLDEN + parts[:, :, k])
    return h.view(np.int64)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for batch in batches:
        texts = batch["text"].tolist()
        group = np.cumsum([len(t or "") for t in texts]) // BLOCK_BYTES
        for g in np.unique(group):
            part = np.flatnonzero(group == g)
            words = [shingler.words(texts[i]) for i in part]
            sets = [shingler.shingles(w) for w in words]
            owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
            bands = _bands(signatures(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), owner,
                                      len(sets), BANDS * BAND_ROWS))
            yield batch.drop(columns="text").iloc[part].assign(
                print=[print_of(w) for w in words], bands=[b if len(s[0]) else [] for b, s in zip(bands, sets, strict=True)])


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two weight vectors over the same shingles (0 where a text has not the shingle)."""
    with np.errstate(divide="ignore"):
        ratio = np.where(x > 0, y / np.maximum(x, 1e-300), np.inf)
    order = np.argsort(ratio)
    x, y, ratio = x[order], y[order], ratio[order]
    last = np.searchsorted(ratio, ratio, side="right")
    below, above = np.cumsum(x)[last - 1], y.sum() - np.cumsum(y)[last - 1]
    both = (x > 0) & (y > 0)
    return float((x[both] / (below[both] + above[both] / ratio[both])).sum())


def _similar(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two texts, as shingles and counts, reach the similarity."""
    both = np.union1d(x[0], y[0])
    a, b = np.zeros(len(both)), np.zeros(len(both))
    a[np.searchsorted(both, x[0])], b[np.searchsorted(both, y[0])] = x[1], y[1]
    return probability_jaccard(a, b) >= SIMILARITY - 1e-12


def _set(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(shingles, np.uint64), np.frombuffer(counts, np.int32).astype(float)


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        good = [_similar(_set(*x[:2]), _set(*x[2:])) for x in zip(
            batch["shingles"], batch["counts"], batch["rep_shingles"], batch["rep_counts"], strict=True)]
        yield batch.loc[np.array(good, bool), ["u", "v"]]


class _Forest:
    """Which texts are linked already."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.find(i)] = self.find(j)


def _links(frame: pd.DataFrame) -> pd.DataFrame:
    """Verified links of one block of texts, or between two; those that follow from others, or from known classes, are left out."""
    frame = frame.drop_duplicates("text_no").reset_index(drop=True)
    n = len(frame)
    shingles, counts = zip(*[_set(x, y) for x, y in zip(frame["shingles"], frame["counts"], strict=True)], strict=True)
    owner = np.repeat(np.arange(n), [len(x) for x in shingles])
    values, column = np.unique(np.concatenate(shingles), return_inverse=True)
    weight = np.concatenate(counts)
    totals = np.bincount(owner, weight, n)
    met = np.flatnonzero(np.bincount(column, minlength=len(values)) > 1)
    place = np.full(len(values), -1)
    place[met] = np.arange(len(met))
    # common[i, j]: the share of i's weight on shingles that j has too, an upper bound of the similarity.
    common = np.zeros((n, n), np.float32)
    used = place[column]
    order = np.argsort(used, kind="stable")
    for begin in range(0, len(met), 4096):
        part = order[np.searchsorted(used[order], begin):np.searchsorted(used[order], begin + 4096)]
        has = np.zeros((n, 4096), np.float32)
        has[owner[part], used[part] - begin] = 1
        share = np.zeros((n, 4096), np.float32)
        share[owner[part], used[part] - begin] = weight[part] / totals[owner[part]]
        common += share @ has.T
    bound = np.minimum(common, common.T)
    across = frame["block"].to_numpy()
    if frame["left"].iloc[0] != frame["right"].iloc[0]:
        bound[across[:, None] == across] = 0
    a, b = np.nonzero(np.triu(bound, 1) >= SIMILARITY - 1e-4)
    best = np.argsort(-bound[a, b], kind="stable")
    forest, out, first = _Forest(n), [], {}
    for i, known in enumerate(frame["known"].tolist()):
        forest.join(i, first.setdefault(known, i))
    for i, j in zip(a[best].tolist(), b[best].tolist(), strict=True):
        if forest.find(i) == forest.find(j):
            continue
        if _similar((shingles[i], counts[i]), (shingles[j], counts[j])):
            forest.join(i, j)
            out.append((frame["text_no"].iloc[i], frame["text_no"].iloc[j]))
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Classes of texts linked by a similarity of at least 0.8 (probability Jaccard).

    Returns ``id_col, class_id`` (the smallest id of the class), ``class_size`` (rows) and ``kept``
    (true for one row of each class, one with that id), and the row's columns in ``keep``. Texts of equal words are one text; a null
    text, and any without words, has none and is the same as the others of that kind. The class of
    null ids alone is null. Rows that repeat are copies; an empty table gives no rows; further
    columns are ignored.

    Candidate texts are grouped into components of shared bands. Each text is first compared with the first text of
    the bucket that most of its bands share; within a component, texts outside the largest class that this gives are
    compared with all others, in blocks of TEXTS_IN_BLOCK, by the weight of their common shingles. So no link between
    candidates is lost, no pairs are listed, and a component of copies costs as much as its texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    keep = [c for c in keep if c != id_col]
    names = {c: "text" if c == text_col else f"kept_{i}" for i, c in enumerate(keep)}
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                         *[F.col(f"`{c}`").alias(n) for c, n in names.items() if n != "text"])
    # Numbered once, so that texts and verdicts find their rows whatever the ids are.
    carried = stage(source.withColumn("row", F.monotonically_increasing_id()))
    signed = stage(carried.select("id", "text", "row").mapInPandas(_sign, f"id {kind}, row bigint, print binary, bands array<bigint>"))
    rows = signed.select("id", "row", "print")
    texts = stage(signed.groupBy("print").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("least"), F.count("*").alias("copies"),
                                              F.min_by("bands", "row").alias("bands")).select(
        "print", F.col("least.id").alias("id"), F.col("least.row").alias("text_no"), "copies", "bands"))

    keys = texts.select("text_no", F.explode("bands").alias("key"))
    buckets = stage(keys.groupBy("key").agg(F.min("text_no").alias("v"), F.count("*").alias("n")).where("n > 1"))
    # The few buckets with a large share of all texts come to their rows; see join_groups.
    hot = F.broadcast(stage(buckets.where(F.col("n") * HOT_SHARE > BANDS * texts.count()).drop("n")))
    rest = keys.join(hot.select("key"), "key", "left_anti").join(buckets.drop("n").hint("merge"), "key")
    edges = stage(keys.join(hot, "key").unionByName(rest).where("text_no != v").groupBy(F.col("text_no").alias("u"), "v").agg(
        F.count("*").alias("hits")))
    near = connected_components(edges)
    near = stage(near.unionByName(near.select(F.col("v").alias("u"), "v").distinct()))

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.shingles(shingler.words(t)) for t in batch["text"]]
            yield batch.drop(columns="text").assign(
                shingles=[s[0].tobytes() for s in sets], counts=[s[1].tobytes() for s in sets])

    # A text's number is that of the row it was first seen in.
    found = stage(carried.select(F.col("row").alias("text_no"), "text").join(near.select(
        F.col("u").alias("text_no"), F.col("v").alias("component")).hint("merge"), "text_no").select("text_no", "component", "text").mapInPandas(
        shingle, "text_no bigint, component bigint, shingles binary, counts binary"))

    # Each text against the first text of most of its buckets: most links are found here, without any block.
    part = F.pmod(F.xxhash64("u"), F.lit(PARTS)).alias("part")
    first = stage(edges.groupBy("u").agg(F.max_by("v", F.struct("hits", -F.col("v"))).alias("v")).select("u", "v", part))
    side = first.select("v", "part").distinct().join(found.select(
        F.col("text_no").alias("v"), F.col("shingles").alias("rep_shingles"), F.col("counts").alias("rep_counts")), "v")
    met = found.select(F.col("text_no").alias("u"), "shingles", "counts").join(first, "u").join(side, ["v", "part"])
    known = stage(connected_components(met.mapInPandas(_verified, "u bigint, v bigint")))

    # Within a component, texts outside the largest class so far are compared with all that are not of their class.
    member = stage(found.select("text_no", "component").join(known.withColumnRenamed("u", "text_no"), "text_no", "left").select(
        "text_no", "component", F.coalesce("v", "text_no").alias("known")))
    sizes = member.groupBy("component", "known").agg(F.count("*").alias("n")).groupBy("component").agg(
        F.max_by("known", F.struct("n", -F.col("known"))).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("n")).where("n > most")
    blocks = stage(sizes.select("component", "largest", *[F.ceil(x / TEXTS_IN_BLOCK).cast("int").alias(name) for name, x in (
        ("small", F.col("n") - F.col("most")), ("large", F.col("most")))]))
    in_large = F.col("known") == F.col("largest")
    placed = join_groups(member, blocks, "component").withColumns({
        "block": F.when(in_large, F.col("small") + F.pmod(F.xxhash64("text_no"), F.col("large"))).otherwise(
            F.pmod(F.xxhash64("text_no"), F.col("small"))).cast("int"),
        "last": F.when(in_large, F.col("small") - 1).otherwise(F.col("small") + F.col("large") - 1)})
    paired = found.drop("component").join(placed.hint("merge"), "text_no").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumns(
        {"left": F.least("block", "other"), "right": F.greatest("block", "other")}).select(
        "component", "block", "left", "right", "text_no", "known", "shingles", "counts")
    links = stage(paired.groupBy("component", "left", "right").applyInPandas(_links, "u bigint, v bigint"))
    classes = known if links.isEmpty() else connected_components(known.unionByName(links))

    grouped = stage(texts.drop("bands").join(classes.withColumnRenamed("u", "text_no"), "text_no", "left").withColumn(
        "class", F.coalesce("v", "text_no")).drop("v"))
    least = grouped.groupBy("class").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("text_no"))).alias("keep"),
                                         F.sum("copies").alias("class_size"))
    named = stage(grouped.join(least, "class").select("print", "copies", F.col("keep.id").alias("class_id"),
                                                      F.col("keep.text_no").alias("keep_row"), "class_size"))
    done = join_groups(rows, named, "print").withColumn("kept", F.col("row") == F.col("keep_row"))
    if keep:
        done = done.select("id", "row", "class_id", "class_size", "kept").join(carried.drop("id"), "row")
    return done.select(F.col("id").alias(id_col), "class_id", "class_size", "kept", *[F.col(n).alias(c) for c, n in names.items()])
