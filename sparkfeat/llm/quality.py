"""Text quality by logistic regression on hashed word n-grams.

Words are runs of letters and digits, or runs of other marks. A text's features are the hashed
words and word pairs, and the hashed one to three neighbouring word forms (capitals, digits, marks,
a repeated word), ``sqrt(count / n)`` each, so that the vector has length 1.
Training follows the regularised leader (FTRL-Proximal) in several shards at once, whose weights
are averaged; scoring is a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
SHARDS = 4
CACHE_WORDS = 250_000
BLOCK_CHARS = 1_500_000
_WORD = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")


def _shape(word: str) -> str:
    """The form of a word: digits, capitals, title or small letters; marks stand for themselves."""
    if not word[0].isalnum():
        return word
    if word.isdigit():
        return "9"
    if word.isupper() and len(word) > 1:
        return "AA"
    return "Aa" if word[0].isupper() else "a"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Texts to ``(text number, feature, value)``; remembers the hashes of the words it met."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.known: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word, and that of its form."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in set(words).difference(known):
            form = zlib.crc32(_shape(word).encode("utf-8", "surrogatepass"))
            known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) << 32 | form
        both = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat: list[str] = []
        lengths = []
        for text in texts:
            found = _WORD.findall(text)
            lengths.append(len(found))
            flat += found
        words, forms = self._hashes(flat)
        text_of = np.repeat(np.arange(len(texts)), lengths).astype(np.uint64)
        follows = text_of[1:] == text_of[:-1]
        # A word that repeats the one before it has a form of its own.
        forms = forms * np.uint64(2)
        forms[1:] += follows & (words[1:] == words[:-1])
        where, index = [text_of], [_mix(words + np.uint64(1 << 40))]
        for grams, deepest, salt in ((words, 2, 2), (forms, 3, 3)):
            gram = _mix(grams + np.uint64(salt << 40))
            if salt == 3:
                where.append(text_of)
                index.append(gram)
            for back in range(1, deepest):
                gram = _mix(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + _mix(grams[back:]))
                whole = text_of[back:] == text_of[:-back]
                where.append(text_of[back:][whole])
                index.append(gram[whole])
        key = np.concatenate(where) << np.uint64(32) | (np.concatenate(index) & self.mask)
        keys, counts = np.unique(key, return_counts=True)
        row = (keys >> np.uint64(32)).astype(np.int64)
        total = np.bincount(row, counts, len(texts))
        return row, (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), np.sqrt(counts / total[row])


@dataclass
class Ftrl:
    """FTRL-Proximal with per-coordinate rates."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.01

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], size: int, epochs: int) -> np.ndarray:
        z, n = np.zeros(size), np.zeros(size)
        for _ in range(epochs):
            for (index, value), label in zip(rows, labels, strict=True):
                w = self.weights(z[index], n[index])
                margin = float(np.clip(w @ value, -35, 35))
                gradient = (1 / (1 + np.exp(-margin)) - label) * value
                squared = gradient * gradient
                step = (np.sqrt(n[index] + squared) - np.sqrt(n[index])) / self.alpha
                z[index] += gradient - step * w
                n[index] += squared
        return self.weights(z, n)


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK_CHARS or i == len(texts) - 1:
            yield start, texts[start:i + 1]
            start, size = i + 1, 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_labels: int = 8000, epochs: int = 4, bits: int = BITS, rule: Ftrl | None = None) -> np.ndarray:
    """The weights: ``2**bits`` features, then the constant.

    Learns from at most ``max_labels`` labelled rows, those of the smallest id hash; each shard
    gets a part of them, so that no task holds more than the bound. A null text is empty; rows
    with a null label or id are not learned from. Without any label every weight is 0 and every
    score 1/2.
    """
    rule = rule or Ftrl()
    size = (1 << bits) + 1
    order = F.xxhash64(F.col("id"))
    chosen = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(
        "id IS NOT NULL AND label IS NOT NULL").orderBy(order, "label").limit(max_labels)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    shard = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SHARDS)).alias("shard")
    sample = texts.join(F.broadcast(chosen), "id").select(shard, "id", "label", "text")

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.iloc[np.argsort([zlib.crc32(str(i).encode()) for i in part["id"]], kind="stable")]
        hasher, rows = Hasher(bits), []
        for _, block in _blocks(part["text"].tolist()):
            row, index, value = hasher.features(block)
            cuts = np.searchsorted(row, np.arange(1, len(block)))
            for i, v in zip(np.split(index, cuts), np.split(value, cuts), strict=True):
                rows.append((np.append(i, size - 1), np.append(v, 1.0)))
        w = rule.fit(rows, part["label"].tolist(), size, epochs)
        used = np.flatnonzero(w)
        return pd.DataFrame({"feature": used, "weight": w[used]})

    trained = sample.groupBy("shard").applyInPandas(train, "feature long, weight double")
    # At most 2**bits + 1 rows, whatever the corpus.
    averaged = trained.groupBy("feature").agg((F.sum("weight") / SHARDS).alias("weight")).toPandas()
    weights = np.zeros(size)
    weights[averaged["feature"].to_numpy(np.int64)] = averaged["weight"].to_numpy(float)
    return weights


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as ``out_col``, which replaces a column of that name.

    Every whole text is scored, a null or empty one by the constant alone. The weights are
    sent along: the hash bits fix their number.
    """
    w = weights.astype(np.float32)
    bits = int(np.log2(len(weights) - 1))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher(bits)
        for texts in batches:
            parts = [np.zeros(0)]
            for _, block in _blocks(texts.fillna("").tolist()):
                row, index, value = hasher.features(block)
                margin = np.bincount(row, w[index] * value, len(block)) + w[-1]
                parts.append(1 / (1 + np.exp(-np.clip(margin, -35, 35))))
            yield pd.Series(np.concatenate(parts))

    return docs.withColumn(out_col, F.pandas_udf(run, "double")(F.col(f"`{text_col}`")))
