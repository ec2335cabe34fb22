"""Running totals and ranks over groups of any size.

A plain window sorts each group in one task. These helpers cut a group into slices of
ordered rows, total each slice, and add the totals of the slices before it, so the group
count does not limit the parallelism and a single group may be the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.nulls import column
from sparkfeat.sources.staging import checked_broadcast, stage

GROUP_LIMIT = 1_000_000
RANGE_ROWS = 1_000_000
_SLICE = "__slice"


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows in the biggest group."""
    counts = df.groupBy(*[column(b) for b in by]).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n").alias("n")).first()["n"] or 0


def sliced(df: DataFrame, keys: Sequence[str], slices: int | None = None) -> DataFrame:
    """Range-partition by ``keys`` and record each row's range in ``__slice``.

    The result is written out: ranges come from sampling, so they must be fixed before two
    readers (the totals and the rows) can agree on them.
    """
    columns = [column(k) for k in keys]
    ranged = df.repartitionByRange(*([slices] if slices else []), *columns)
    return stage(ranged.withColumn(_SLICE, F.spark_partition_id()))


def running_total(df: DataFrame, value: Column, order: Sequence[str], by: Sequence[str] = (),
                  out: str = "before", group_limit: int = GROUP_LIMIT,
                  slices: int | None = None, largest: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that sort earlier.

    ``order`` must be unique within a group. ``df`` should be a staged frame, since its group
    sizes are measured first (unless the caller knows the ``largest``): groups within
    ``group_limit`` use one window, larger ones are sliced.
    """
    rows = df.withColumn("__value", value)
    groups, ordering = [column(b) for b in by], [column(o) for o in order]
    if (largest_group(df, by) if largest is None else largest) <= group_limit:
        window = (Window.partitionBy(*(groups or [F.lit(0)])).orderBy(*ordering)
                  .rowsBetween(Window.unboundedPreceding, -1))
        total = F.coalesce(F.sum("__value").over(window), F.lit(0))
        return rows.withColumn(out, total).drop("__value")

    ranged = sliced(rows, [*by, *order], slices)
    totals = ranged.groupBy(*groups, _SLICE).agg(F.sum("__value").alias("__slice_total"))
    # A group has at most one row per slice here, so this window is small.
    earlier = (Window.partitionBy(*(groups or [F.lit(0)])).orderBy(_SLICE)
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = stage(totals.select(
        *[column(b).alias(f"__by{i}") for i, b in enumerate(by)],
        F.col(_SLICE).alias("__of_slice"),
        F.coalesce(F.sum("__slice_total").over(earlier), F.lit(0)).alias("__offset")))
    match = F.col(_SLICE) == F.col("__of_slice")
    for i, b in enumerate(by):
        match = match & column(b).eqNullSafe(F.col(f"__by{i}"))
    joined = ranged.join(checked_broadcast(offsets), match)
    within = (Window.partitionBy(*groups, _SLICE).orderBy(*ordering)
              .rowsBetween(Window.unboundedPreceding, -1))
    total = F.col("__offset") + F.coalesce(F.sum("__value").over(within), F.lit(0))
    return joined.withColumn(out, total).drop(
        "__value", "__offset", "__of_slice", _SLICE, *[f"__by{i}" for i in range(len(by))])


def hash_bucket(hashed: Column, buckets: int) -> Column:
    """Equal ranges of a 64-bit hash, in hash order."""
    share = hashed.cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return F.least(F.floor(share * F.lit(buckets)), F.lit(buckets - 1)).cast("int")


def bucket_count(df: DataFrame) -> int:
    """How many hash ranges to cut a group into.

    Four per configured shuffle partition, and enough that a range of the whole table has at most
    ``RANGE_ROWS`` rows. The rows are counted; the number of ranges never changes a result.
    """
    configured = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, -(-df.count() // RANGE_ROWS))


def bucket_offsets(counts: DataFrame, by: Sequence[str], bucket: str, n: str) -> DataFrame:
    """Rows before each (group, bucket), and rows in the whole group.

    ``counts`` has one row per group and bucket, so its windows hold at most as many rows as
    there are buckets.
    """
    group = Window.partitionBy(*[column(b) for b in by])
    earlier = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({
        "__before": F.coalesce(F.sum(n).over(earlier), F.lit(0)),
        "__total": F.sum(n).over(group),
    })
