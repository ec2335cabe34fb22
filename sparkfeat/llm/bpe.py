"""Byte-pair encoding of whole partitions with a pair occurrence index.

The distinct words of a block of texts lie in one symbol array. An index maps each pair's rank to
all its positions; the active ranks are applied in ascending order, and each application updates
the lists of the neighbouring pairs it makes. Words do not touch, so that the order among the
pairs of one word is the same as if it were encoded alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 3_000_000
CACHE_WORDS = 300_000
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """What a word-level-BPE tokenizer file says, as arrays; made once on the driver."""

    tokens: list[str]
    specials: dict[str, int]
    pattern: str
    suffix: str
    pair_keys: np.ndarray = field(repr=False)
    pair_ranks: np.ndarray = field(repr=False)
    rank_left: np.ndarray = field(repr=False)
    rank_right: np.ndarray = field(repr=False)
    rank_merged: np.ndarray = field(repr=False)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a tokenizer file: NFC, one blank for white space, lower case, split, byte letters, BPE."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*ids.values(), *specials.values()]) + 1)
        for token, i in [*ids.items(), *specials.items()]:
            tokens[i] = token
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, merged = (np.array([ids[x] for x in side], np.int64) for side in (
            [a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        return cls(tokens, specials, split, suffix, keys[order], order.astype(np.int64), left, right, merged)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, or ``_NONE``."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], _NONE)


class _Occurrences:
    """Positions by rank, and a heap of the ranks that have any."""

    def __init__(self) -> None:
        self.lists: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        active = ranks != _NONE
        ranks, positions = ranks[active], positions[active]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True):
            if rank not in self.lists:
                self.lists[rank] = []
                heapq.heappush(self.heap, rank)
            self.lists[rank].append(part)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        while self.heap:
            rank = heapq.heappop(self.heap)
            yield rank, np.unique(np.concatenate(self.lists.pop(rank)))


def _disjoint(positions: np.ndarray, following: np.ndarray) -> np.ndarray:
    """From the left, positions of a pair of equal symbols that do not overlap."""
    taken, out = -1, []
    for at, after in zip(positions.tolist(), following.tolist(), strict=True):
        if at != taken:
            out.append(at)
            taken = after
    return np.array(out, np.int64)


def encode_words(words: list[str], vocabulary: Vocabulary, letter_ids: np.ndarray, end_ids: np.ndarray) -> list[np.ndarray]:
    """The ids of each word, which must not be empty."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    lengths = np.array([len(w) for w in raw], np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(raw), np.uint8)
    symbols = letter_ids[data]
    symbols[ends - 1] = end_ids[data[ends - 1]]
    n = len(symbols)
    # One cell more at the end: position n stands for "no neighbour" and holds symbol -1.
    symbols = np.append(symbols, -1)
    following, before = np.arange(1, n + 2), np.arange(-1, n)
    following[n] = n
    following[ends - 1] = n
    before[ends - lengths] = n
    before = np.append(before, n)[: n + 1]
    index = _Occurrences()
    every = np.arange(n)
    index.add(vocabulary.ranks(symbols[:n], symbols[following[:n]]), every)
    for rank, at in index:
        a, b = vocabulary.rank_left[rank], vocabulary.rank_right[rank]
        at = at[(symbols[at] == a) & (symbols[following[at]] == b)]
        if a == b and len(at) > 1:
            at = _disjoint(at, following[at])
        if not len(at):
            continue
        gone = following[at]
        symbols[at] = vocabulary.rank_merged[rank]
        symbols[gone] = -2
        after = following[gone]
        following[at] = after
        before[after] = at
        before[n] = n
        prior = before[at]
        index.add(vocabulary.ranks(symbols[prior], symbols[at]), prior)
        index.add(vocabulary.ranks(symbols[at], symbols[after]), at)
    alive = np.flatnonzero(symbols[:n] >= 0)
    cuts = np.searchsorted(alive, ends[:-1])
    return np.split(symbols[alive], cuts)


class Encoder:
    """Encodes blocks of texts; keeps the words it has met, up to ``CACHE_WORDS``."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        letters = byte_letters()
        ids = {t: i for i, t in enumerate(vocabulary.tokens)}
        self.letter_ids = np.array([ids[x] for x in letters], np.int64)
        self.end_ids = np.array([ids[x + vocabulary.suffix] for x in letters], np.int64)
        self.words = regex.compile(vocabulary.pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True)))
                                     or r"(?!)")
        self.blank = regex.compile(r"\s+")
        self.known: dict[str, tuple[str, str, int]] = {}

    def split(self, text: str) -> list[str]:
        """Words of a text; special tokens stand for themselves."""
        out: list[str] = []
        start = 0
        for found in self.special.finditer(text) if "<" in text else ():
            out += self._plain(text[start:found.start()])
            out.append(found.group())
            start = found.end()
        return out + self._plain(text[start:] if start else text)

    def _plain(self, text: str) -> list[str]:
        text = self.blank.sub(" ", unicodedata.normalize("NFC", text))
        return self.words.findall(text.replace("Σ", "σ").lower())

    def learn(self, words: set[str]) -> None:
        """Encode the words not met before: ``word -> (ids, tokens, number of ids)``, as text."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if not self.known:
            self.known = {t: (str(i), t, 1) for t, i in self.vocabulary.specials.items()}
        new = [w for w in words if w not in self.known]
        if not new:
            return
        tokens, names = self.vocabulary.tokens, list(map(str, range(len(self.vocabulary.tokens))))
        for word, ids in zip(new, encode_words(new, self.vocabulary, self.letter_ids, self.end_ids), strict=True):
            ids = ids.tolist()
            self.known[word] = (" ".join([names[i] for i in ids]), " ".join([tokens[i] for i in ids]), len(ids))

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, ids joined by blanks, and the decoded text."""
        for block in _blocks(texts):
            split = [self.split(t) for t in block]
            self.learn({w for words in split for w in words})
            known = self.known
            for words in split:
                found = [known[w] for w in words]
                yield (sum([f[2] for f in found]), " ".join([f[0] for f in found]), " ".join([f[1] for f in found]))


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
           keep_text: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256``, and with ``keep_text`` also ``ids``
    (decimal, joined by blanks) and ``decoded``. The file has no decoder, so that decoding joins
    the tokens by blanks. A null text is empty and gives no ids; rows may repeat; other columns
    are ignored. The vocabulary, a file of fixed size, is read on the driver and sent along.
    """
    vocabulary = Vocabulary.read(vocabulary_path)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            out = []
            for n, ids, decoded in encoder.encode(batch["text"].tolist()):
                row = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                out.append((*row, ids, decoded) if keep_text else row)
            columns = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_text else [])]
            frame = pd.DataFrame(out, columns=columns)
            frame.insert(0, id_col, batch["id"].to_numpy())
            yield frame

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return source.mapInPandas(run, schema + (", ids string, decoded string" if keep_text else ""))
