"""Each row against the one before it within its entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.nulls import clean, column
from sparkfeat.operators.ranking import GROUP_LIMIT, largest_group
from sparkfeat.sources.staging import checked_broadcast, stage, stage_bucketed

_SLICE = "__slice"


def with_previous(df: DataFrame, key: str, order: str, value: str, out: str = "previous",
                  bounded_groups: bool = False, group_limit: int = GROUP_LIMIT,
                  slices: int | None = None) -> DataFrame:
    """Add ``out``, the ``value`` of the preceding row of the same key; NULL on the first.

    ``order`` must be unique within a key. ``bounded_groups`` states that a key has few rows
    by construction (one per month, say) and uses a window as it is. Otherwise the largest
    key is measured, and beyond ``group_limit`` rows the table is cut into ordered slices:
    a slice's first row takes its predecessor from the last row of the slice before. The slices are kept as
    a table bucketed by slice, so that rows are moved once, to their slice.
    """
    rows = df.where(column(key).isNotNull())
    if bounded_groups or largest_group(rows, [key]) <= group_limit:
        window = Window.partitionBy(column(key)).orderBy(column(order))
        return rows.withColumn(out, F.lag(clean(rows, value)).over(window))

    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(count, column(key), column(order)).withColumn(_SLICE, F.spark_partition_id())
    ranged = stage_bucketed(ranged, count, [_SLICE])
    last = ranged.groupBy(_SLICE).agg(
        F.max_by(F.struct(column(key).alias("k"), clean(ranged, value).alias("v")),
                 F.struct(column(key), column(order))).alias("last"))
    # One row per slice: at most as many as there are partitions.
    carried = stage(last.select(
        F.col(_SLICE).alias("__of_slice"),
        F.lag("last").over(Window.orderBy(_SLICE)).alias("__carried")))
    joined = ranged.join(checked_broadcast(carried), F.col(_SLICE) == F.col("__of_slice"), "left")
    within = Window.partitionBy(_SLICE, column(key)).orderBy(column(order))
    first_here = F.row_number().over(within) == 1
    before = F.when(
        first_here, F.when(F.col("__carried.k") == column(key), F.col("__carried.v"))
    ).otherwise(F.lag(clean(ranged, value)).over(within))
    return joined.withColumn(out, before).drop("__of_slice", "__carried", _SLICE)


def _compared(df: DataFrame, key: str, order: str, value: str, out: str, how, **options) -> DataFrame:
    paired = with_previous(df, key, order, value, "__previous", **options)
    result: Column = how(F.col("__previous"), clean(paired, value))
    return paired.withColumn(out, result).where(column(out).isNotNull()).drop("__previous")


def lag_ratio(df: DataFrame, key: str, order: str, value: str, out: str | None = None,
              **options) -> DataFrame:
    """Previous over current value; rows without a predecessor or with a zero value drop out."""
    return _compared(df, key, order, value, out or f"{value}_ratio",
                     lambda previous, current: F.try_divide(previous, current), **options)


def lag_difference(df: DataFrame, key: str, order: str, value: str, out: str | None = None,
                   **options) -> DataFrame:
    """Previous minus current value; rows without a predecessor drop out."""
    return _compared(df, key, order, value, out or f"{value}_difference",
                     lambda previous, current: previous - current, **options)
