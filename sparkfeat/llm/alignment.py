"""Aligns the tokens of two tokenizers over the same bytes.

A text is encoded by a byte-level BPE (A) and by a sentencepiece model (B). The byte offsets at which tokens
of both end are found by a galloping intersection: the shorter list of ends drives, and each of its ends is
looked up in the longer one by steps that double until they pass it, then by halving the last step. The
common ends slice the tokens into groups, and the difference between the ranks of a token's two ends is the range
of the other side's tokens that it overlaps. Each overlap is a link between two ids.

How often an id pair is linked is counted over the whole corpus. A block of texts numbers its different pairs once;
they are joined with the corpus counts and go back to their block, so that a pair, however frequent, has one row a
block, and no task holds the table of pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.bpe import byte_letters
from sparkfeat.sources.staging import stage

BLOCK_BYTES = 2_000_000
CALL_CHARS = 200_000
KNOWN_CHUNKS = 200_000
#: A text is cut at single blanks between two of these characters, none of which is white space or combines with others
#: to either tokenizer: ASCII signs, Latin, Greek and Cyrillic letters. A token of both then begins with the blank.
_EDGE = "[!-~\u00a1-\u00ac\u00ae-\u024f\u0391-\u03a1\u03a3-\u03ff\u0400-\u0482\u048a-\u04ff]"
_CUT = re.compile(f" (?={_EDGE})(?<={_EDGE} )")
_NUMBER = np.dtype("<u4")


@dataclass
class Tokenizers:
    """Two tokenizer files, read on the driver, and the bytes of every token."""

    a_file: str = field(repr=False)
    b_file: bytes = field(repr=False)
    a_bytes: list[bytes] = field(repr=False)
    b_bytes: list[bytes] = field(repr=False)

    @classmethod
    def read(cls, a_path: str, b_path: str) -> Tokenizers:
        import sentencepiece

        with open(a_path, encoding="utf-8") as file:
            a_file = file.read()
        with open(b_path, "rb") as file:
            b_file = file.read()
        value = {letter: i for i, letter in enumerate(byte_letters())}
        vocabulary = json.loads(a_file)["model"]["vocab"]
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            # A token that is no run of byte letters (a special one) never comes out of plain text.
            a_bytes[i] = bytes([value[c] for c in token]) if all(c in value for c in token) else b""
        model = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
                   else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
        # Texts are encoded in chunks, which needs that no piece goes on after a blank.
        if any(b" " in piece.lstrip(b" ") for piece in b_bytes):
            raise ValueError("a piece of the second tokenizer goes on after a blank")
        return cls(a_file, b_file, a_bytes, b_bytes)


class _Encoder:
    """Both tokenizers in a task. They encode each different chunk of a text once, and a bounded number of characters a call.
    Chunks are what lies between the cuts, each encoded by itself, without the blank before it.

    Ids lie one after the other in ``ids``; a chunk's are from ``begins`` on, ``counts`` many.
    """

    def __init__(self, files: Tokenizers) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.a_file)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b_file)
        self.spelled = (files.a_bytes, files.b_bytes)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.counts = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.good = np.zeros(0, bool)

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks, and note of each whether both sides spell a blank and the chunk."""
        begin = 0
        while begin < len(chunks):
            end, size = begin, 0
            while end < len(chunks) and size < CALL_CHARS:
                size += len(chunks[end])
                end += 1
            call = chunks[begin:end]
            raw = [b" " + x.encode("utf-8", "surrogatepass") for x in call]
            good = np.ones(len(call), bool)
            for k, sides in enumerate(([x.ids for x in self.a.encode_batch_fast([" " + x for x in call], add_special_tokens=False)],
                                       self.b.encode(call, num_threads=1))):
                flat, counts, names = list(chain.from_iterable(sides)), np.array(list(map(len, sides)), np.int64), self.spelled[k]
                tokens = [names[i] for i in flat]
                ends, at = np.r_[0, np.cumsum(list(map(len, tokens)))], np.r_[0, np.cumsum(counts)]
                # All at once, and one by one only where a chunk is spelled otherwise.
                if (np.diff(ends[at]) != list(map(len, raw))).any() or b"".join(tokens) != b"".join(raw):
                    good &= [b"".join(tokens[i:j]) == x for i, j, x in zip(at, at[1:], raw, strict=False)]
                self.counts[k] = np.concatenate([self.counts[k], counts])
                self.ids[k] = np.concatenate([self.ids[k], np.array(flat, np.int64)])
            self.known.update(zip(call, range(len(self.known), len(self.known) + len(call)), strict=True))
            self.good = np.concatenate([self.good, good])
            begin = end

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of A and B for each text; None where there are none, or their bytes are not blank + text."""
        if len(self.known) > KNOWN_CHUNKS:
            self._forget()
        split = list(map(_CUT.split, texts))
        flat = list(chain.from_iterable(split))
        new = [x for x in dict.fromkeys(flat) if x not in self.known]
        if new:
            self._learn(new)
        numbers = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        cuts = np.cumsum(list(map(len, split)))[:-1]
        sides = []
        for ids, counts in zip(self.ids, self.counts, strict=True):
            width = counts[numbers]
            at = np.repeat((np.cumsum(counts) - counts)[numbers] - np.cumsum(width) + width, width) + np.arange(width.sum())
            ends = np.cumsum(width)
            sides.append(np.split(ids[at], ends[cuts - 1] if len(ends) else []))
        good = np.split(self.good[numbers], cuts)
        for text, a, b, fine in zip(texts, *sides, good, strict=True):
            if not text:
                yield None
            elif fine.all() or self._spells(a, b, text):
                yield a, b
            else:
                yield None

    def _spells(self, a: np.ndarray, b: np.ndarray, text: str) -> bool:
        raw = b" " + text.encode("utf-8", "surrogatepass")
        return all(b"".join([names[i] for i in ids.tolist()]) == raw for names, ids in zip(self.spelled, (a, b), strict=True))


def gallop(wanted: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each wanted value the first place in ``[low, high]`` of ``ends`` that is not below it.

    ``ends[high]`` must not be below. From the guess, steps double away until they pass the value; the last
    step is halved then. All values take their steps together, so that a round is one array operation.
    """
    low, high = low.copy(), high.copy()
    down = ends[guess] >= wanted
    high[down] = guess[down]
    low[~down] = guess[~down] + 1
    at, step = np.flatnonzero(low < high), 1
    while len(at):
        falls = down[at]
        probe = np.where(falls, np.maximum(guess[at] - step, low[at]), np.minimum(guess[at] + step, high[at]))
        reached = ends[probe] >= wanted[at]
        high[at[reached]] = probe[reached]
        low[at[~reached]] = probe[~reached] + 1
        at = at[(reached == falls) & (low[at] < high[at])]
        step *= 2
    at = np.flatnonzero(low < high)
    while len(at):
        middle = (low[at] + high[at]) // 2
        reached = ends[middle] >= wanted[at]
        high[at[reached]] = middle[reached]
        low[at[~reached]] = middle[~reached] + 1
        at = at[low[at] < high[at]]
    return low


@dataclass
class Aligned:
    """Texts side by side: tokens of the driving and the other list, all texts one after the other."""

    common: np.ndarray  # for each driving token, whether its end is common
    first: np.ndarray   # the first of the other tokens that it overlaps
    last: np.ndarray    # and the last


def overlaps(lengths: np.ndarray, others: np.ndarray, counts: np.ndarray, other_counts: np.ndarray) -> Aligned:
    """Ranges of overlapping tokens, from the byte lengths of tokens and the number of tokens of each text.

    Both sides of a text have equally many bytes.
    """
    ends, other_ends = np.cumsum(lengths), np.cumsum(others)
    begin = np.cumsum(counts) - counts
    other_end = np.cumsum(other_counts)
    low = np.repeat(other_end - other_counts, counts)
    high = np.repeat(other_end - 1, counts)
    rank = np.arange(len(lengths)) - np.repeat(begin, counts)
    guess = low + rank * np.repeat(other_counts, counts) // np.maximum(np.repeat(counts, counts), 1)
    last = gallop(ends, other_ends, low, high, guess)
    common = other_ends[last] == ends
    # A token begins where the one before it ends: past the other token that ends there too, or inside it.
    first = np.empty_like(last)
    first[1:] = last[:-1] + common[:-1]
    first[begin[counts > 0]] = low[begin[counts > 0]]
    return Aligned(common, first, last)


def _names(size: int) -> np.ndarray:
    """Decimal ids followed by a comma, a bar, a semicolon or nothing."""
    return np.array([f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(size)], object)


def group_texts(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray,
                names: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text; ``a_last`` and ``b_last`` are the last tokens of the groups."""
    size = len(names) // 4
    a_sizes, b_sizes = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
    a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_mark[a_last], b_mark[b_last] = 1, 2
    b_mark[np.cumsum(b_counts) - 1] = 3
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + np.repeat(np.cumsum(b_sizes) - b_sizes, a_sizes)] = names[a + size * a_mark]
    out[np.arange(len(b)) + np.repeat(np.cumsum(a_sizes), b_sizes)] = names[b + size * b_mark]
    cuts = np.r_[0, np.cumsum(a_counts + b_counts)].tolist()
    return ["".join(out[i:j].tolist()) for i, j in zip(cuts, cuts[1:], strict=False)]


@dataclass
class _Block:
    """What is known of a block of texts that have tokens on both sides."""

    a: list[np.ndarray]
    b: list[np.ndarray]

    def links(self, tokenizers: Tokenizers, lengths: tuple[np.ndarray, np.ndarray], names: np.ndarray):
        """Number of groups, groups and linked pairs (``a * size of B + b``) of each text."""
        groups, texts, pairs = [0] * len(self.a), [""] * len(self.a), [np.zeros(0, np.int64)] * len(self.a)
        a_counts, b_counts = (np.array(list(map(len, x)), np.int64) for x in (self.a, self.b))
        for a_drives in (True, False):  # the shorter list drives
            chosen = np.flatnonzero((a_counts <= b_counts) == a_drives)
            if not len(chosen):
                continue
            a, b = (np.concatenate([x[i] for i in chosen]) for x in (self.a, self.b))
            na, nb = a_counts[chosen], b_counts[chosen]
            sides = [(a, lengths[0][a], na), (b, lengths[1][b], nb)]
            (drive, drive_bytes, drive_n), (_, other_bytes, other_n) = sides if a_drives else sides[::-1]
            found = overlaps(drive_bytes, other_bytes, drive_n, other_n)
            ends, other_ends = np.flatnonzero(found.common), found.last[found.common]
            marked = np.r_[0, np.cumsum(found.common)]
            cuts = np.r_[0, np.cumsum(drive_n)]
            made = group_texts(a, b, *((ends, other_ends) if a_drives else (other_ends, ends)), na, nb, names)
            width = found.last - found.first + 1
            place = np.repeat(np.arange(len(drive)), width)
            other = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width - found.first, width)
            at, bt = (place, other) if a_drives else (other, place)
            linked = np.split(a[at] * len(tokenizers.b_bytes) + b[bt], np.cumsum(width)[cuts[1:-1] - 1])
            for i, count, text, link in zip(chosen.tolist(), (marked[cuts[1:]] - marked[cuts[:-1]]).tolist(), made, linked, strict=True):
                groups[i], texts[i], pairs[i] = count, text, link
        return groups, texts, pairs


_EMPTY = np.zeros(0, np.int64)


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK_BYTES or i == len(texts) - 1:
            yield begin, texts[begin:i + 1]
            begin, size = i + 1, 0


def align_texts(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text",
                keep_groups: bool = False) -> DataFrame:
    """The alignment of each text, and the pairs of each block of texts.

    A frame of ``block, id, n_a, n_b, n_groups, n_links, groups_sha256, links`` (and ``groups``) a text, and a row with
    ``pairs, counts`` a block: its different pairs, the most frequent first, whose numbers ``links`` holds, compressed.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"block bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
              "links binary, pairs array<bigint>, counts array<bigint>" + (", groups string" if keep_groups else ""))
    types = {"block": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
             "groups_sha256": pa.string(), "links": pa.binary(), "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()),
             "groups": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, codec = _Encoder(tokenizers), pa.Codec("zstd")
        lengths = tuple(np.array(list(map(len, x)), np.int64) for x in (tokenizers.a_bytes, tokenizers.b_bytes))
        names = _names(max(len(tokenizers.a_bytes), len(tokenizers.b_bytes)))
        context = TaskContext.get()
        part, made = (context.partitionId() if context else 0), 0

        def rows(ids: pa.Array, values: dict[str, list]) -> pa.RecordBatch:
            arrays = [ids if name == "id" else pa.array(values.get(name, [None] * len(ids)), types[name]) for name in columns]
            return pa.RecordBatch.from_arrays(arrays, columns)

        for batch in batches:
            for begin, texts in _blocks(batch.column("text").to_pylist()):
                ids = list(encoder.encode(texts))
                inside = [i for i, x in enumerate(ids) if x is not None]
                block = _Block([ids[i][0] for i in inside], [ids[i][1] for i in inside])
                groups, written, linked = block.links(tokenizers, lengths, names)
                pairs, numbers, counts = np.unique(np.concatenate([_EMPTY, *linked]), return_inverse=True, return_counts=True)
                order = np.argsort(-counts, kind="stable")
                place = np.empty(len(order), _NUMBER)
                place[order] = np.arange(len(order))
                numbers = np.split(place[numbers], np.cumsum([len(x) for x in linked])[:-1])
                n = len(texts)
                out: dict[str, list] = {name: [0] * n for name in ("n_a", "n_b", "n_groups", "n_links")}
                out |= {"block": [part << 32 | made] * n, "groups_sha256": [""] * n, "groups": [""] * n, "links": [b""] * n}
                for k, i in enumerate(inside):
                    out["n_a"][i], out["n_b"][i] = len(block.a[k]), len(block.b[k])
                    out["n_groups"][i], out["n_links"][i] = groups[k], len(linked[k])
                    out["groups_sha256"][i] = hashlib.sha256(written[k].encode()).hexdigest()
                    out["links"][i] = codec.compress(numbers[k].tobytes(), asbytes=True)
                    out["groups"][i] = written[k]
                own = batch.column("id").slice(begin, n)
                yield rows(own, out)
                yield rows(pa.nulls(1, own.type), {"block": [part << 32 | made], "pairs": [pairs[order]], "counts": [counts[order]]})
                made += 1

    columns = [x.split()[0] for x in schema.split(", ")]
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return source.mapInArrow(run, schema)


def pair_counts(pairs: DataFrame, b_size: int) -> DataFrame:
    """``pair, n, best``: the links of every id pair of ``pairs`` (``pair, n``), and whether none of its B id has more."""
    counts = stage(pairs.groupBy("pair").agg(F.sum("n").alias("n")))
    # One row an id of B, which its vocabulary bounds.
    most = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", F.col("pair") % b_size).join(F.broadcast(most), "b").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text",
          keep_groups: bool = False) -> DataFrame:
    """Align every whole text and score its links by the whole corpus.

    Returns ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, and with ``keep_groups`` the
    ``groups`` themselves (``a1,a2|b1;a3|b2``). ``n_best`` counts the links whose pair no other pair of the B id outnumbers, and
    ``count_sum`` adds the pairs' counts up. Texts that are null or empty, or whose tokens on either side do not spell
    a blank and the text, have zeros and an empty ``groups_sha256``. Rows that repeat count as often as they stand;
    other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    b_size = len(tokenizers.b_bytes)
    made = stage(align_texts(docs, tokenizers, id_col, text_col, keep_groups))
    pairs = made.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("number", "x")).select(
        "block", "number", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    # Many rows a pair, at most one a block: no more of the rows than a block's share of different pairs.
    scored = pairs.select("block", "number", "pair").join(pair_counts(pairs, b_size), "pair").select(F.col("block").alias("in_block"), "number", "n", "best")
    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if keep_groups else [])]
    texts = made.where("pairs IS NULL").select("block", *kept, "links")

    def finish(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        codec = pa.Codec("zstd")
        size = int(known["number"].max()) + 1 if len(known) else 0
        n, best = np.zeros(size, np.int64), np.zeros(size, bool)
        n[known["number"]], best[known["number"]] = known["n"], known["best"]
        sums = []
        for links, count in zip(rows["links"], rows["n_links"], strict=True):
            at = np.frombuffer(codec.decompress(links, count * _NUMBER.itemsize, asbytes=True), _NUMBER) if count else _EMPTY
            sums.append((int(best[at].sum()), int(n[at].sum())))
        result = rows[kept].reset_index(drop=True)
        result[["n_best", "count_sum"]] = np.array(sums, np.int64).reshape(-1, 2)
        return result

    schema = (f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
              + ("groups string, " if keep_groups else "") + "n_best bigint, count_sum bigint")
    done = texts.groupBy("block").cogroup(scored.groupBy("in_block")).applyInPandas(finish, schema)
    return done.withColumnRenamed("id", id_col)
