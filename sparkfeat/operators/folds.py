"""Seeded stratified folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.nulls import column
from sparkfeat.operators.ranking import bucket_count, bucket_offsets, hash_bucket
from sparkfeat.sources.staging import BROADCAST_BYTES, checked_broadcast, measured_bytes, stage

FOLDS = 5
SEED = 4590


def stratified_folds(df: DataFrame, label: str, key: str, k: int = FOLDS, seed: int = SEED,
                     out: str = "fold", buckets: int | None = None, small: bool | None = None) -> DataFrame:
    """Add a fold number 0..k-1; per label the fold sizes differ by at most one row.

    Rows of a label are ordered by a hash of the (unique) key and cut into k runs; the label's
    hash says which run is fold 0, so that the odd rows of small labels (down to one row) spread
    over all folds. Only the
    k - 1 cut points per label are computed: hash-range counts tell which range holds each
    cut, and just those ranges are sorted. The fold is then a comparison on each row, so the
    table itself is not shuffled, and the result does not depend on its partitioning.

    So many labels that their cut points are too large to broadcast (measured; ``small`` decides by hand)
    meet their rows by label and hash range, where no label is too much for a task, however many rows it has.
    """
    count = buckets or bucket_count(df)
    slim = df.select(column(label).alias("__label"), column(key).alias("__key"))
    slim = slim.withColumn("__hash", F.xxhash64(F.lit(seed), F.col("__key")))
    slim = slim.withColumn("__bucket", hash_bucket(F.col("__hash"), count))

    counts = slim.groupBy("__label", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    placed = bucket_offsets(counts, ["__label"], "__bucket", "__n")
    cut_rank = F.floor(F.col("__total") * F.col("j") / F.lit(k)).cast("long")
    inside = (cut_rank >= F.col("__before")) & (cut_rank < F.col("__before") + F.col("__n"))
    cuts = stage(placed.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(k - 1)))).where(inside)
                 .select(F.col("__label").alias("cut_label"), F.col("__bucket").alias("cut_bucket"),
                         "j", (cut_rank - F.col("__before")).alias("at")))

    ranges = checked_broadcast(
        cuts.groupBy("cut_label", "cut_bucket").agg(F.collect_list(F.struct("at", "j")).alias("wanted")))
    same = (F.col("__label").eqNullSafe(F.col("cut_label"))) & (F.col("__bucket") == F.col("cut_bucket"))
    position = F.row_number().over(
        Window.partitionBy("__label", "__bucket").orderBy("__hash", "__key")) - 1
    points = (slim.join(ranges, same)
              .withColumn("position", position)
              .withColumn("cut", F.explode(F.filter("wanted", lambda w: w["at"] == F.col("position")))))
    point = F.struct(F.col("__hash").alias("h"), F.col("__key").alias("k"))
    per_label = stage(points.groupBy(F.col("__label").alias("__cut_label")).agg(
        F.collect_list(point).alias("__cuts")))

    own = F.struct(F.xxhash64(F.lit(seed), column(key)).alias("h"), column(key).alias("k"))
    turn = F.pmod(F.xxhash64(F.lit(seed), column(label)), F.lit(k))
    if measured_bytes(per_label) <= BROADCAST_BYTES if small is None else small:
        joined = df.join(F.broadcast(per_label), column(label).eqNullSafe(F.col("__cut_label")), "left").withColumn("__run", F.lit(0))
    else:
        joined = df.withColumn("__range", hash_bucket(own["h"], count)).join(
            _by_range(placed, points, point, k), column(label).eqNullSafe(F.col("__cut_label")) & (F.col("__range") == F.col("__cut_range")),
            "left").drop("__range", "__cut_range")
    passed = F.filter("__cuts", lambda cut: cut <= own)
    run = F.coalesce(F.col("__run") + F.coalesce(F.size(passed), F.lit(0)), F.lit(0))
    return joined.withColumn(out, ((run + turn) % k).cast("int")).drop("__cut_label", "__cuts", "__run")


def _by_range(placed: DataFrame, points: DataFrame, point: Column, k: int) -> DataFrame:
    """For each label and hash range: how many cuts lie before the range, and those within."""
    inside = points.groupBy(F.col("__label").alias("__in_label"), F.col("__bucket").alias("__in_range")).agg(
        F.collect_list(point).alias("__cuts"))
    # Cut j is the row at rank total * j / k.
    cut_ranks = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda j: F.floor(F.col("__total") * j / F.lit(k)))
    earlier = F.size(F.filter(cut_ranks, lambda rank: rank < F.col("__before")))
    ranges = placed.select(F.col("__label").alias("__cut_label"), F.col("__bucket").alias("__cut_range"), earlier.alias("__run"))
    same = F.col("__cut_label").eqNullSafe(F.col("__in_label")) & (F.col("__cut_range") == F.col("__in_range"))
    return ranges.join(inside, same, "left").drop("__in_label", "__in_range")


def hashed_folds(df: DataFrame, key: str, k: int = FOLDS, seed: int = SEED,
                 out: str = "fold") -> DataFrame:
    """Folds straight from the key's hash: no counting pass, balanced only on average."""
    return df.withColumn(out, F.pmod(F.xxhash64(F.lit(seed), column(key)), F.lit(k)).cast("int"))
