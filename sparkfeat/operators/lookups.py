"""Dictionary lookups and chained joins on one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfeat.functions.nulls import column
from sparkfeat.sources.staging import BROADCAST_BYTES, measured_bytes

_KEY = "__lookup_key"
_NOT_HASHABLE = (T.MapType, T.VariantType)


def is_small(mapping: DataFrame) -> bool:
    """Whether the measured mapping may be broadcast."""
    return measured_bytes(mapping) <= BROADCAST_BYTES


def lookup(df: DataFrame, mapping: DataFrame, key: str, values: dict[str, str] | str,
           mapping_key: str | None = None, default=None, small: bool | None = None) -> DataFrame:
    """Add mapped columns to ``df`` by a left join; the mapping's keys must be unique.

    ``values`` names the mapping's value column, or maps it to an output name. A key that is
    missing from the mapping, or NULL, gives ``default``.

    The mapping (staged by the fit functions) is measured first. A small one is broadcast
    and the big table is not shuffled. A large one becomes a shuffle join: rows without a key
    are spread over many partitions, and adaptive execution splits the partitions of hot keys.
    ``small`` carries the verdict of an earlier measurement when one mapping is looked up
    several times.
    """
    names = {values: values} if isinstance(values, str) else dict(values)
    source = mapping_key or key
    side = mapping.where(column(source).isNotNull()).select(
        column(source).alias(_KEY), *[column(n).alias(f"__value_{n}") for n in names])
    if small is None:
        small = is_small(side)
    if small:
        joined = df.join(F.broadcast(side), column(key) == F.col(_KEY), "left")
    else:
        joined = _spread_join(df, side, key)
    fallback = default if isinstance(default, Column) else F.lit(default)
    out = {
        new: F.col(f"`__value_{old}`") if default is None
        else F.coalesce(F.col(f"`__value_{old}`"), fallback)
        for old, new in names.items()
    }
    return joined.withColumns(out).drop(_KEY, *[f"__value_{n}" for n in names])


def _spread_join(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left shuffle join in which NULL keys, all of one hash otherwise, take many partitions."""
    hashable = [column(f.name) for f in df.schema.fields if not isinstance(f.dataType, _NOT_HASHABLE)]
    # The join hashes the spread number again: more numbers than partitions fill them evenly.
    numbers = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.when(column(key).isNull(), F.pmod(F.xxhash64(*hashable), F.lit(numbers))).otherwise(F.lit(0))
    # Always 0, but not a literal: a constant would be folded out of the join keys.
    none = F.pmod(F.xxhash64(F.col(_KEY)), F.lit(1))
    left = df.withColumn("__spread", spread.cast("long"))
    right = side.withColumn("__no_spread", none)
    match = (column(key) == F.col(_KEY)) & (F.col("__spread") == F.col("__no_spread"))
    return left.join(right, match, "left").drop("__spread", "__no_spread")


def left_join_all(base: DataFrame, others: Sequence[DataFrame], on: str) -> DataFrame:
    """Left-join per-entity tables onto ``base``.

    Each input is an aggregate by ``on`` and so already partitioned by it: the joins add no
    exchange.
    """
    result = base
    for other in others:
        result = result.join(other, on, "left")
    return result
