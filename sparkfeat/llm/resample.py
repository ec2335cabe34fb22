"""Draws documents whose words resemble a target corpus.

Each text is a bag of hashed word n-grams. The log ratio of a bucket's frequency in the target and
in the documents is its gain; the mean gain of a document is its weight, and the highest weights
plus seeded Gumbel noise are a draw without replacement in proportion to ``exp(weight / 1000)``.

The bags are built by Arrow kernels over some megabytes of texts at a time: ``ascii_lower``,
``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode`` number the words, shifted numbers
form the n-grams, each distinct n-gram is hashed once, and the gains of a document are taken and
added up as one segment.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.operators.ranking import running_total
from sparkfeat.sources.staging import stage

BUCKETS = 10_000
LONGEST = 2
SHARE = 25
MIN_WORDS = 20
SEED = 7
SLICE_BYTES = 2_000_000
#: What lies between words: ASCII that is neither letter nor digit (A-Z is lower-cased before).
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive texts of about SLICE_BYTES together (a longer text alone), with the number of the first."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield begin, texts.slice(begin, end - begin)
        begin = end


def _buckets_of(names: pa.Array, buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(x) % buckets for x in names.cast(pa.binary()).to_pylist()), np.int64, len(names))


def bags(texts: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each n-gram length the buckets of all runs and the texts they are in.

    ``texts`` has no nulls. The texts of the runs ascend.
    """
    split = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=_BETWEEN)
    words, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    inside = pc.greater(pc.binary_length(words), 0)
    words = words.filter(inside).dictionary_encode()
    owner = owner.filter(inside).to_numpy(zero_copy_only=False).astype(np.int64)
    names, codes = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first, first_codes, found = names, codes, [(_buckets_of(names, buckets)[codes], owner)]
    for n in range(2, longest + 1):
        # The run of n - 1 words at i, continued by the word at i + n - 1 of the same text.
        same = owner[n - 1:] == owner[:len(owner) - n + 1]
        runs = first_codes[:len(same)] * len(names) + codes[n - 1:]
        distinct, numbers = np.unique(runs[same], return_inverse=True)
        first = pc.binary_join_element_wise(first.take(pa.array(distinct // max(len(names), 1))),
                                            names.take(pa.array(distinct % max(len(names), 1))), " ")
        found.append((_buckets_of(first, buckets)[numbers], owner[:len(same)][same]))
        first_codes = np.zeros(len(same), np.int64)
        first_codes[same] = numbers
    return np.bincount(owner, minlength=len(texts)), found


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text",
          longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """``floor(1000 ln(target frequency / documents' frequency))`` of every bucket, each count plus one.

    Counts cover all whole texts; each task adds its texts up, and the driver gets two numbers a bucket.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            wanted = batch.column("wanted").to_numpy(zero_copy_only=False)
            for begin, texts in _slices(batch.column("text")):
                for bucket, owner in bags(texts, longest, buckets)[1]:
                    side = wanted[begin + owner].astype(np.int64)
                    sums += np.bincount(side * buckets + bucket, minlength=2 * buckets).reshape(2, buckets)
        side, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(side), pa.array(bucket), pa.array(sums[side, bucket])], ["side", "bucket", "n"])

    both = _texts(docs, text_col).withColumn("wanted", F.lit(False)).unionByName(
        _texts(target, target_text_col).withColumn("wanted", F.lit(True)))
    counted = both.mapInArrow(run, "side bigint, bucket bigint, n bigint").groupBy("side", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, buckets))
    for side, bucket, n in counted.collect():  # at most 2 * buckets rows
        counts[side, bucket] = n
    (s, t), (s_all, t_all) = counts, counts.sum(1)
    ratio = ((t + 1) * (s_all + buckets)) / ((s + 1) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _texts(frame: DataFrame, text_col: str) -> DataFrame:
    return frame.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          longest: int = LONGEST) -> DataFrame:
    """``id_col, n_words, n_features, weight``: the floored mean gain of each text's n-grams, 0 without any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for _, texts in _slices(batch.column("text")):
                words, found = bags(texts, longest, len(gain))
                features, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for bucket, owner in found:
                    if not len(owner):
                        continue
                    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    total[owner[starts]] += np.add.reduceat(gain[bucket], starts)
                    features += np.bincount(owner, minlength=len(texts))
                made.append((words, features, total // np.maximum(features, 1)))
            columns = [np.concatenate(x) for x in zip(*made, strict=True)] if made else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, columns)],
                                             ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    weighed = source.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    return weighed.withColumnRenamed("id", id_col)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED,
             longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """Weights of all documents, and the draw of ``share`` percent of those with ``min_words`` words.

    Returns ``id_col, n_words, n_features, weight, score, rank``: a row for each row of ``docs``. ``rank``
    counts the drawn ones from 1 by falling score (equal scores: by id, a null id first), and is null for the others.
    A null text is empty and has weight 0. The noise depends on the seed and the id alone: rows
    that repeat an id share it and are ranked one after the other. An empty ``target`` only evens out
    the documents' own buckets. Ranks come from ranges of the scores with the totals of the ranges
    before, so that no task holds all scores.
    """
    weighed = weigh(docs, gains(docs, target, text_col, target_text_col, longest, buckets), id_col, text_col, longest)
    own = F.col(f"`{id_col}`")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    scored = stage(weighed.withColumn("score", score.cast("long")).withColumn("__row", F.monotonically_increasing_id()))
    eligible = scored.where(F.col("n_words") >= min_words).withColumn("__falling", -F.col("score"))
    draw = share * eligible.count() // 100
    ranked = running_total(eligible, F.lit(1), ["__falling", id_col, "n_features", "weight", "__row"], out="__before", group_limit=0)
    drawn = ranked.withColumn("rank", F.when(F.col("__before") < draw, F.col("__before") + 1))
    others = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = [own, "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return drawn.select(*columns).unionByName(others.select(*columns))
