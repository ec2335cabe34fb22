"""Passages that an earlier document has too, found with suffix arrays.

A 50-byte string belongs to the 16-byte string in it with the smallest hash, its anchor. Equal
strings have equal anchors, so that all places of a string meet in the shard of its anchor:

1. Documents are cut into chunks. A run of neighbouring strings with one anchor is a context.
2. The sorted anchor hashes of all chunks are merged; those in one document only drop out.
3. Each chunk looks its anchors up by binary search in the merged list and sends the different
   contexts that are left, with their smallest document, to the shard of the anchor.
4. A shard, one range of anchors after the other, sorts the suffixes of its contexts (Larsson-Sadakane), takes
   common prefixes (Kasai) and so finds for each string the smallest document. The answer is a bit for each string.
5. Each chunk merges the answers into spans.

Lists travel packed, a row for each chunk and shard. A passage in many documents is sent once by a
chunk, whatever the number of its documents there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import parts_for, whole_ids
from sparkfeat.llm.suffixes import common_prefixes, suffix_array
from sparkfeat.sources.staging import stage, staging_root

LENGTH = 50
ANCHOR = 16
STARTS = LENGTH - ANCHOR + 1
CONTEXT = LENGTH + STARTS - 1
HALF = (LENGTH - ANCHOR + 1) // 2 + ANCHOR
CHUNK_BYTES = 12 << 20
SHARD_BYTES = 16 << 20
RANGE_BYTES = 2 << 20
_PIECE = 1 << 16
_NO_ID = np.iinfo(np.int64).max
_ALL = np.uint64((1 << STARTS) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    spare = -rows.shape[1] % 8
    if spare:
        rows = np.concatenate([rows, np.zeros((len(rows), spare), np.uint8)], axis=1)
    words = np.ascontiguousarray(rows).view(np.uint64)
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(words.shape[1]):
        h = _mix(h ^ words[:, i]) + np.uint64(0x632BE59BD9B4E019)
    return h


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each different row, and for each row the number of its kind; exact."""
    h = _row_hash(rows)
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    if (rows[first[kind]] != rows).any():  # different rows with equal hashes
        _, first, kind = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, kind.ravel()


def _anchors(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each string of the data, by its start, where its anchor is (the leftmost of equals); a piece at a time."""
    for begin in range(0, len(data) - LENGTH + 1, _PIECE):
        part = data[begin:begin + _PIECE + LENGTH - 1]
        h = part.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
        width = 1
        while width < ANCHOR:
            later = h[width:]
            h = (h[:-width] ^ (h[:-width] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + (later ^ (later >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            width *= 2
        h ^= h >> np.uint32(16)
        least = h.astype(np.int64) << 20 | np.arange(len(h))
        width = 1
        while width * 2 <= STARTS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < STARTS:
            least = np.minimum(least[:width - STARTS], least[STARTS - width:])
        yield begin, (least & 0xFFFFF) + begin


def _runs(texts: list[bytes]) -> list[bytes]:
    """For each text its runs of strings with one anchor: length and anchor's offset, a byte each.

    Only bytes and runs are held for all texts; what takes numbers for each string is done by piece.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    long = lengths >= LENGTH
    inside[starts[long]] += 1
    inside[(starts + lengths)[long] - LENGTH + 1] -= 1
    np.cumsum(inside, dtype=np.int8, out=inside)
    begins, places, ranks, seen, last = [], [], [], 0, -1
    for first, anchors in _anchors(data):
        at = np.flatnonzero(inside[first:first + len(anchors)])
        mine = anchors[at]
        heads = np.flatnonzero(np.append(last, mine[:-1]) != mine) if len(mine) else at
        begins.append(at[heads] + first)
        places.append(mine[heads])
        ranks.append(heads + seen)
        seen, last = seen + len(mine), mine[-1] if len(mine) else last
    begin, place, rank = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (begins, places, ranks))
    pairs = np.stack([np.diff(np.append(rank, seen)), place - begin], axis=1).astype(np.uint8)
    cuts = np.searchsorted(begin, starts[1:])
    return [p.tobytes() for p in np.split(pairs, cuts)]


class _Chunk:
    """The texts of a chunk, one after the other, and their runs."""

    def __init__(self, frame: pd.DataFrame) -> None:
        frame = frame.sort_values("row", kind="stable")
        self.ids, self.rows = frame["id"], frame["row"].to_numpy()
        self.texts = frame["data"].tolist()
        self.order = frame["place"].to_numpy(np.int64)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(self.texts) + b"\xff" * CONTEXT, np.uint8)
        pairs = [np.frombuffer(r, np.uint8).reshape(-1, 2) for r in frame["runs"]]
        self.text_of = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        flat = np.concatenate(pairs).astype(np.int64)
        self.size, self.offset = flat[:, 0], flat[:, 1]
        before = np.cumsum(self.size) - self.size
        first = np.searchsorted(self.text_of, self.text_of)
        self.begin = self.starts[self.text_of] + before - before[first] if len(flat) else before
        self.hash = _row_hash(sliding_window_view(self.data, ANCHOR)[self.begin + self.offset])

    def anchor_lists(self, shards: int) -> Iterator[tuple[int, bytes]]:
        """For each shard the sorted anchor hashes, then a byte each: more than one document."""
        order = np.lexsort((self.order[self.text_of], self.hash))
        h, doc = self.hash[order], self.order[self.text_of][order]
        heads = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        many = doc[heads] != doc[np.append(heads[1:], len(h)) - 1] if len(h) else np.zeros(0, bool)
        for shard, part in _by_shard(h[heads], shards):
            yield shard, h[heads][part].tobytes() + many[part].astype(np.uint8).tobytes()

    def contexts(self, shared: np.ndarray, shards: int) -> None:
        """Sets the runs whose anchor is shared, their contexts, and how they go to shards."""
        at = np.minimum(np.searchsorted(shared, self.hash), max(0, len(shared) - 1))
        self.chosen = np.flatnonzero(shared[at] == self.hash) if len(shared) else np.zeros(0, np.int64)
        size = self.size[self.chosen] + LENGTH - 1
        rows = sliding_window_view(self.data, CONTEXT)[self.begin[self.chosen]].copy()
        rows[np.arange(CONTEXT) >= size[:, None]] = 255
        first, self.kind = _distinct(rows)
        self.least = np.full(len(first), _NO_ID, np.int64)
        doc = self.order[self.text_of[self.chosen]]
        np.minimum.at(self.least, self.kind, doc)
        self.rows_of_kind = rows[first]
        self.offset_of_kind = self.offset[self.chosen][first].astype(np.uint8)
        self.parts = list(_by_shard(self.hash[self.chosen][first], shards))

    def packed_contexts(self) -> Iterator[tuple[int, bytes]]:
        for shard, part in self.parts:
            yield shard, (self.least[part].tobytes() + self.offset_of_kind[part].tobytes() + self.rows_of_kind[part].tobytes())

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Whether each byte goes: the bytes of all strings that a smaller document has."""
        bits = np.zeros(len(self.least), np.uint64)
        for shard, part in self.parts:
            if shard in answers:
                bits[part] = np.frombuffer(answers[shard], np.uint64)
        doc = self.order[self.text_of[self.chosen]]
        mask = np.where(doc > self.least[self.kind], _ALL, bits[self.kind])
        some = np.flatnonzero(mask)
        begin, size, mask = self.begin[self.chosen][some], self.size[self.chosen][some], mask[some]
        edge = np.zeros(len(self.data) + 1, np.int8)  # sums are at most LENGTH
        for j in range(STARTS):
            here = begin[(size > j) & ((mask >> np.uint64(j)) & np.uint64(1) == 1)] + j
            edge[here] += 1  # a start occurs once, so that no place is counted twice in one step
            edge[here + LENGTH] -= 1
        return np.cumsum(edge[:-1], dtype=np.int8, out=edge[:-1]) > 0

    def results(self, removed: np.ndarray, with_text: bool) -> pd.DataFrame:
        out = []
        for begin, length, text in zip(self.starts.tolist(), self.lengths.tolist(), self.texts, strict=True):
            gone = removed[begin:begin + length]
            if not gone.any():
                out.append((length, 0, 0, hashlib.sha256(text).hexdigest(), [], text))
                continue
            turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            kept = self.data[begin:begin + length][~gone].tobytes()
            out.append((length, int(gone.sum()), len(turn) // 2, hashlib.sha256(kept).hexdigest(), turn.tolist(), kept))
        frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
        frame.insert(0, "id", self.ids.to_numpy())
        return frame if with_text else frame.drop(columns="kept")


def _by_shard(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the hashes of each shard."""
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[part[0]]), part


def _merge_anchors(lists: pd.DataFrame) -> pd.DataFrame:
    """The anchors of a shard that more than one document has, for each chunk that has them."""
    hashes, many = [], []
    for data in lists["data"]:
        n = len(data) // 9
        hashes.append(np.frombuffer(data, np.uint64, n))
        many.append(np.frombuffer(data, np.uint8, n, 8 * n))
    flat = np.concatenate(hashes)
    unique, kind, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    shared[kind[np.concatenate(many) > 0]] = True
    keep = unique[shared]
    found = [h[keep[np.minimum(np.searchsorted(keep, h), len(keep) - 1)] == h].tobytes() if len(keep) else b"" for h in hashes]
    out = pd.DataFrame({"chunk": lists["chunk"].to_numpy(), "shard": lists["shard"].to_numpy(), "data": found})
    return out[[len(x) > 0 for x in found]]


def _smallest_documents(lists: pd.DataFrame) -> pd.DataFrame:
    """For each context of each chunk a bit for each of its strings: a smaller document has it.

    Contexts with different anchors have no string in common, so that a shard is worked on by ranges of a hash
    of the anchor, and what takes numbers for each byte is held for one range.
    """
    parts, docs, offsets, bits = [], [], [], []
    for data in lists["data"]:
        n = len(data) // (9 + CONTEXT)
        docs.append(np.frombuffer(data, np.int64, n))
        offsets.append(np.frombuffer(data, np.uint8, n, 8 * n))
        parts.append(np.frombuffer(data, np.uint8, n * CONTEXT, 9 * n).reshape(n, CONTEXT))
        bits.append(np.zeros(n, np.uint64))
    ranges = max(1, -(-sum(map(len, docs)) * CONTEXT // RANGE_BYTES))
    numbers = [_anchor_range(rows, offset, ranges) for rows, offset in zip(parts, offsets, strict=True)]
    for number in range(ranges):
        chosen = [np.flatnonzero(x == number) for x in numbers]
        rows, doc, offset = (np.concatenate([x[at] for x, at in zip(every, chosen, strict=True)]) for every in (parts, docs, offsets))
        if not len(rows):
            continue
        found = np.split(_smaller(rows, doc, offset.astype(np.int64)), np.cumsum([len(at) for at in chosen])[:-1])
        for all_bits, at, part in zip(bits, chosen, found, strict=True):
            all_bits[at] = part
    return pd.DataFrame({"chunk": lists["chunk"].to_numpy(), "shard": lists["shard"].to_numpy(), "data": [b.tobytes() for b in bits]})


def _anchor_range(rows: np.ndarray, offset: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each context's anchor, by the half of its hash that does not choose the shard."""
    if not len(rows):
        return np.zeros(0, np.uint16)
    at = np.arange(len(rows)) * CONTEXT + offset
    low = _row_hash(sliding_window_view(rows.ravel(), ANCHOR)[at]) & np.uint64(0xFFFFFFFF)
    return (low * np.uint64(ranges) >> np.uint64(32)).astype(np.uint16 if ranges <= 1 << 16 else np.uint32)


def _smaller(rows: np.ndarray, doc: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """For each context a bit for each of its strings: a context here of a smaller document has it."""
    first, kind = _distinct(rows)
    least = np.full(len(first), _NO_ID, np.int64)
    np.minimum.at(least, kind, doc)
    rows, offset = np.ascontiguousarray(rows[first]), offset[first]
    chosen = _worth_sorting(rows, offset)
    bits = np.where(least[kind] < doc, _ALL, np.uint64(0))
    if len(chosen):
        by_string = _string_minima(rows[chosen], least[chosen])
        place = np.full(len(rows), -1)
        place[chosen] = np.arange(len(chosen))
        entry = np.flatnonzero(place[kind] >= 0)
        smaller = by_string[place[kind[entry]]] < doc[entry][:, None]
        bits[entry] = (smaller.astype(np.uint64) << np.arange(STARTS, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return bits


def _worth_sorting(rows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Contexts that can share a string with another one.

    A common string goes at least half of what it has besides the anchor to the left or to the
    right of it, so that the anchor with that half is common as well.
    """
    flat = np.append(rows.ravel(), np.full(CONTEXT, 255, np.uint8))
    view = sliding_window_view(flat, HALF)
    base = np.arange(len(rows)) * CONTEXT + offset
    keep = np.zeros(len(rows), bool)
    for side, able in ((base, offset + HALF <= CONTEXT), (base + ANCHOR - HALF, offset + ANCHOR >= HALF)):
        place = np.flatnonzero(able)
        _, kind, count = np.unique(_row_hash(view[side[place]]), return_inverse=True, return_counts=True)
        keep[place] |= count[kind] > 1
    return np.flatnonzero(keep)


def _string_minima(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each context and each of its strings, the smallest document of a context with that string."""
    sizes = (rows != 255).sum(1)
    text = np.full(int((sizes + 1).sum()), 255, np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    lane = np.arange(CONTEXT) < sizes[:, None]
    place = (begins[:, None] + np.arange(CONTEXT))[lane]
    text[place] = rows[lane]
    padded = np.append(text, np.full(8, 255, np.uint8))
    first = np.zeros(len(text), np.uint64)
    for k in range(8):
        first = first << np.uint64(8) | padded[k:k + len(text)]
    order = suffix_array(first, step=8)
    shared = common_prefixes(text, order, begins, begins + sizes, LENGTH)
    owner = np.repeat(np.arange(len(rows)), sizes + 1)
    heads = np.flatnonzero(shared < LENGTH)
    minima = np.minimum.reduceat(least[owner[order]], heads)
    of_suffix = np.empty(len(text), np.int64)
    of_suffix[order] = np.repeat(minima, np.diff(np.append(heads, len(order))))
    out = np.full((len(rows), STARTS), _NO_ID, np.int64)
    for j in range(STARTS):
        has = np.flatnonzero(sizes >= j + LENGTH)
        out[has, j] = of_suffix[begins[has] + j]
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Removes each byte covered by a 50-byte string that also starts in a document with a smaller id.

    Texts are UTF-8 bytes, null counts as empty; strings never cross documents and are judged on
    the input. Returns ``id_col`` (a whole number), ``n_bytes, n_removed, n_spans, kept_sha256`` and ``spans``
    (start, end, start, end, ... of the removed runs), and with ``with_text`` the bytes ``kept``.
    A string that repeats inside a document, or in rows that repeat an id, stays. A null id counts
    as larger than any. An empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    whole_ids(docs, id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(_NO_ID))).alias("place"),
                         F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("data"))
    shards = parts_for(source, "data", SHARD_BYTES)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for batch in batches:
            texts = batch["data"].tolist()
            ends = np.cumsum([len(t) for t in texts]) // CHUNK_BYTES
            for group in np.unique(ends):
                part = np.flatnonzero(ends == group)
                frame = batch.iloc[part]
                yield frame.assign(chunk=number >> 16, row=np.arange(number, number + len(frame)), runs=_runs([texts[i] for i in part]))[columns]
                number += 1 << 16

    columns = ["chunk", "row", "id", "place", "data", "runs"]
    name = f"repeats_{uuid.uuid4().hex}"
    source.mapInPandas(cut, f"chunk bigint, row bigint, id {kind}, place bigint, data binary, runs binary").write.format(
        "parquet").option("path", f"{staging_root(spark)}/{name}").bucketBy(shards, "chunk").saveAsTable(name)
    texts = spark.table(name).groupBy("chunk")
    packed = "chunk bigint, shard bigint, data binary"

    def send_anchors(frame: pd.DataFrame) -> pd.DataFrame:
        return _frame(frame, _Chunk(frame).anchor_lists(shards))

    def send_contexts(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(found):
            return _frame(frame, [])
        chunk = _Chunk(frame)
        chunk.contexts(_sorted(found["data"]), shards)
        return _frame(frame, chunk.packed_contexts())

    def finish(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        chunk = _Chunk(frame)
        answers = found[found["answer"]]
        chunk.contexts(_sorted(found.loc[~found["answer"], "data"]), shards)
        removed = chunk.removed(dict(zip(answers["shard"], answers["data"], strict=True)))
        return chunk.results(removed, with_text)

    anchors = texts.applyInPandas(send_anchors, packed)
    shared = stage(anchors.groupBy("shard").applyInPandas(_merge_anchors, packed))
    contexts = texts.cogroup(shared.groupBy("chunk")).applyInPandas(send_contexts, packed)
    answers = contexts.groupBy("shard").applyInPandas(_smallest_documents, packed)
    both = shared.withColumn("answer", F.lit(False)).unionByName(answers.withColumn("answer", F.lit(True)))
    out = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>"
    done = texts.cogroup(both.groupBy("chunk")).applyInPandas(finish, out + (", kept binary" if with_text else ""))
    return done.withColumnRenamed("id", id_col)


def _sorted(lists: pd.Series) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(lists), np.uint64))


def _frame(chunk: pd.DataFrame, rows: Iterator[tuple[int, bytes]] | list) -> pd.DataFrame:
    frame = pd.DataFrame(list(rows), columns=["shard", "data"])
    frame.insert(0, "chunk", chunk["chunk"].iloc[0] if len(chunk) else 0)
    return frame
