"""Benchmark passages in training documents, found with an FM-index per shard of documents.

A shard is some megabytes of documents that a task holds. Its words become numbers: those of the benchmark
keep theirs, any other word is a separator. Only runs of numbered words as long as the shortest
window can hold one, so the index covers exactly these. A suffix array in numpy gives the
Burrows-Wheeler transform, whose ranks a wavelet matrix answers; all windows are searched
backwards at once, and their occurrences located by sampled suffix positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import parts_for
from sparkfeat.llm.suffixes import suffix_array

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_CHARS = 6_000_000
SAMPLE = 8
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only): runs of a-z, 0-9 and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit level after the other."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.levels, self.zeros = [], []
        current = sequence
        for bit in range(bits - 1, -1, -1):
            ones = (current >> bit) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(current) - int(self.levels[-1][-1]))
            current = np.concatenate([current[ones == 0], current[ones == 1]])
        self.bits = bits

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        low, high = np.zeros(len(symbols), np.int64), ends.astype(np.int64)
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            bit = (symbols >> (self.bits - 1 - level)) & 1
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(bit == 1, zeros + low_ones, low - low_ones)
            high = np.where(bit == 1, zeros + high_ones, high - high_ones)
        return high - low


class FmIndex:
    """Backward search over a sequence of numbers from 1; the index ends it with a 0 of its own."""

    def __init__(self, text: np.ndarray, alphabet: int) -> None:
        text = np.append(text, 0)
        order = suffix_array(text)
        self.n = len(text)
        self.bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.ranks = WaveletMatrix(self.bwt, max(1, int(alphabet - 1).bit_length()))
        self.sampled = order % SAMPLE == 0
        self.position = np.where(self.sampled, order, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each phrase (rows of equal length), empty if it does not occur."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, column]
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            s = symbol[live]
            low[live] = self.first[s] + self.ranks.rank(s, low[live])
            high[live] = self.first[s] + self.ranks.rank(s, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step backwards to the next sampled position."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.sampled[at]
            out[open_[done]] = self.position[at[done]] + steps
            open_, at = open_[~done], at[~done]
            symbol = self.bwt[at]
            rows[open_] = self.first[symbol] + self.ranks.rank(symbol, at)
            steps += 1
        return out


@dataclass
class Phrases:
    """The windows of a block of benchmark items: words numbered from 2 (1: any other), windows by length."""

    numbers: dict[bytes, int]
    windows: dict[int, np.ndarray]
    items: dict[int, list[np.ndarray]]
    shortest: int

    @classmethod
    def of(cls, items: list[tuple[object, str | None]], window: int) -> Phrases:
        numbers: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for number, (_, text) in enumerate(items):
            ids = [numbers.setdefault(w, len(numbers) + 2) for w in words_of(text)]
            width = min(window, len(ids))
            for i in range(len(ids) - width + 1 if ids else 0):
                found.setdefault(width, {}).setdefault(tuple(ids[i:i + width]), set()).add(number)
        return cls(numbers, {k: np.array(list(v), np.int64) for k, v in found.items()},
                   {k: [np.array(sorted(x), np.int64) for x in v.values()] for k, v in found.items()}, min(found, default=0))


class _Shard:
    """The words of some documents as numbers, and which of them an occurrence covers."""

    def __init__(self, texts: list[str | None], phrases: Phrases) -> None:
        numbers, get = phrases.numbers, phrases.numbers.get
        lengths, parts = [], []
        for text in texts:
            words = words_of(text)
            lengths.append(len(words))
            parts.append(np.fromiter(map(get, words, [1] * len(words)), np.int32, len(words)))
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words = np.concatenate(parts) if parts else np.ones(0, np.int32)
        self.alphabet = len(numbers) + 2

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, length, item)`` of every occurrence of every window."""
        text, origin = self._runs(phrases.shortest)
        none = np.zeros(0, np.int64)
        if not len(text) or not phrases.windows:
            return none, none, none
        index = FmIndex(text, self.alphabet)
        starts, widths, items = [none], [none], [none]
        for width, windows in phrases.windows.items():
            low, high = index.search(windows)
            hit = np.flatnonzero(high > low)
            counts = high[hit] - low[hit]
            window = np.repeat(hit, counts)
            rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[hit], counts)
            at = origin[index.locate(rows)]
            owners = [phrases.items[width][w] for w in window]
            many = np.array([len(x) for x in owners], np.int64)
            starts.append(np.repeat(at, many))
            widths.append(np.full(many.sum(), width, np.int64))
            items += owners
        return np.concatenate(starts), np.concatenate(widths), np.concatenate(items)

    def _runs(self, shortest: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs of numbered words inside a document and at least ``shortest`` long, separated by 1."""
        n = len(self.words)
        inside = np.append(self.words > 1, False)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = self.starts[self.lengths > 0]
        begins[first] |= inside[first]
        stops = np.append(~inside[:-1], True)
        stops[first] = True
        begin = np.flatnonzero(begins)
        stop_at = np.flatnonzero(stops)
        end = stop_at[np.searchsorted(stop_at, begin + 1)] if len(begin) else begin
        long = end - begin >= max(1, shortest)
        begin, size = begin[long], (end - begin)[long] + 1
        place = np.cumsum(size) - size
        origin = np.arange(size.sum()) - np.repeat(place, size) + np.repeat(begin, size)
        text = np.where(np.arange(size.sum()) - np.repeat(place, size) == np.repeat(size - 1, size), 1,
                        self.words[np.minimum(origin, max(0, n - 1))] if n else 0).astype(np.int64)
        return text, origin


def _pieces(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Consecutive rows of a batch, about SHARD_CHARS of text at a time."""
    piece = np.cumsum([len(t or "") for t in batch["text"]]) // SHARD_CHARS
    for number in np.unique(piece):
        yield batch[piece == number]


def _search(phrases: Phrases, names: list[object], columns: list[str], last: bool):
    """A task's work: add the covered spans and the items found to each document; at last, the verdict."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard_rows in _pieces(batch):
                shard = _Shard(shard_rows["text"].tolist(), phrases)
                start, width, item = shard.occurrences(phrases)
                doc = np.searchsorted(shard.starts + shard.lengths, start, side="right")
                found_items = [list(x) for x in shard_rows["items"]]
                found_spans = [list(x) for x in shard_rows["spans"]]
                for d, i in set(zip(doc.tolist(), item.tolist(), strict=True)):
                    found_items[d].append(str(names[i]))
                if len(start):
                    for d, a, b in _merged(doc, start - shard.starts[doc], width):
                        found_spans[d] += [a, b]
                found = shard_rows.assign(items=found_items, spans=found_spans, n_words=shard.lengths)
                yield (_judged(found) if last else found)[columns]

    return run


def _judged(found: pd.DataFrame) -> pd.DataFrame:
    out = []
    for spans, items in zip(found["spans"], found["items"], strict=True):
        pairs = np.asarray(spans, np.int64).reshape(-1, 2)
        none = np.zeros(len(pairs), np.int64)
        merged = [[a, b] for _, a, b in _merged(none, pairs[:, 0], pairs[:, 1] - pairs[:, 0])] if len(pairs) else []
        names = sorted(set(items))
        hit = sum(b - a for a, b in merged)
        out.append((hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0, merged))
    judged = pd.DataFrame(out, columns=["n_hit", "n_items", "items_sha256", "contaminated", "spans"], index=found.index)
    return pd.concat([found.drop(columns=["spans", "items"]), judged], axis=1)


def _merged(doc: np.ndarray, start: np.ndarray, width: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Unions of ``[start, start + width)`` of a document that touch or overlap."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + width)[order]
    reach = np.maximum.accumulate(end + doc * (1 << 40))
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] + doc[1:] * (1 << 40) > reach[:-1])]
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:] - 1, len(doc) - 1)
    yield from zip(doc[heads].tolist(), start[heads].tolist(), (reach[tails] - doc[tails] * (1 << 40)).tolist(), strict=True)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  keep: list[str] | None = None) -> DataFrame:
    """Words of each document inside any occurrence of a benchmark window.

    A window is ``window`` consecutive words of an item; a shorter item is one window, one without
    words (null, empty) none. Returns ``id_col``, the columns in ``keep``, ``n_words``, ``n_hit``,
    ``n_items``, ``items_sha256`` (of the item ids sorted as text and joined by commas),
    ``contaminated`` and ``spans`` (arrays of start, end in words, merged). A document without
    words has no hits; repeated rows are judged alike; further columns are ignored. The benchmark
    is searched in blocks of about 8 MB of text, each sent to the tasks; items go to blocks by hash.
    """
    keep = [c for c in (keep or []) if c != id_col]
    kinds = dict(docs.dtypes)
    # The text, if wanted back, is not carried twice.
    carried = {c: "text" if c == text_col else f"kept_{i}" for i, c in enumerate(keep)}
    others = {c: name for c, name in carried.items() if name != "text"}
    flat = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       F.array().cast("array<string>").alias("items"), F.array().cast("array<bigint>").alias("spans"),
                       F.lit(0).cast("bigint").alias("n_words"), *[F.col(f"`{c}`").alias(name) for c, name in others.items()])
    passed = "".join(f", {name} {kinds[c]}" for c, name in others.items())
    between = f"id {kinds[id_col]}, text string, items array<string>, spans array<bigint>, n_words bigint{passed}"
    text = ", text string" if text_col in keep else ""
    verdict = (f"id {kinds[id_col]}{text}, n_words bigint{passed}, n_hit bigint, n_items bigint, items_sha256 string, "
               "contaminated boolean, spans array<array<bigint>>")
    items = benchmark.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{item_text_col}`").alias("text"))
    blocks = parts_for(items, "text", BLOCK_BYTES)
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        rows = [(r["id"], r["text"]) for r in part.collect()]  # about BLOCK_BYTES
        last = block == blocks - 1
        columns = ["id", *(["text"] if text else []), "n_words", *others.values(), "n_hit", "n_items", "items_sha256",
                   "contaminated", "spans"] if last else flat.columns
        flat = flat.mapInPandas(_search(Phrases.of(rows, window), [r[0] for r in rows], columns, last), verdict if last else between)
    return flat.select(F.col("id").alias(id_col), *[F.col(name).alias(c) for c, name in carried.items()],
                       "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
