"""Per-entity profiles: one row per key with named aggregates of many columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfeat.functions.nulls import clean, column
from sparkfeat.sources.staging import stage, stage_bucketed

# The rows that a task of a table staged by key takes at least and, unless tasks are many, at most.
ROWS_IN_TASK = (25_000, 250_000)

# Sets are made in place for so many names at most: each row becomes names x names cells.
SETS_IN_PLACE = 16

# A GROUPING SETS clause takes at most 64 columns; wider lists go in several passes.
SETS_AT_ONCE = 50

# The ranges of calendar columns that ``time_features`` makes. Their exact distinct count is
# the number of bits set in one 64-bit mask, an aggregate of constant size.
CALENDAR_DOMAINS = {
    "month": (1, 12),
    "weekofyear": (1, 53),
    "dayofweek": (0, 6),
    "hour": (0, 23),
    "weekend": (0, 1),
}

_SIMPLE = {
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "std": F.stddev_samp,
    "count": F.count,
}


def aggregate(value: Column, how: str) -> Column:
    """One named statistic of a column; the sum of no values is 0."""
    if how == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    return _SIMPLE[how](value)


def by_whole_keys(df: DataFrame, key: str, profile: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``profile(rows, together)`` with the rows of each key brought together once.

    Where keys have few rows each, a wide aggregate that combines before its shuffle sends nearly a buffer, many
    times as long as the row, for each row. Here rows are staged in buckets of ``key``: groupings by it, and by
    it and more columns, need no exchange, and ``together`` says so. Keys of more rows than a task should take are
    profiled apart as they lie, where combining first leaves one buffer a key and task.
    ``df`` is read three times: pass a staged frame.
    """
    rows = df.where(column(key).isNotNull())
    least, most = ROWS_IN_TASK
    counts = rows.groupBy(column(key).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
    total, largest = counts.agg(F.sum("n"), F.max("n")).first()
    total = total or 0
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, math.ceil(total / most), min(partitions, math.ceil(total / least)))

    def placed(part: DataFrame) -> DataFrame:
        return stage_bucketed(part.repartition(buckets, column(key)), buckets, [key])

    if (largest or 0) <= most:
        return profile(placed(rows), True)
    # Fewer keys than buckets.
    large = F.broadcast(stage(counts.where(F.col("n") > most).select("__key")))
    is_large = column(key) == F.col("__key")
    rest = profile(placed(rows.join(large, is_large, "left_anti")), True)
    return rest.unionByName(profile(rows.join(large, is_large, "left_semi"), False))


def by_each(rows: DataFrame, names: Sequence[str], *exprs: Column, key: str | None = None,
            together: bool = False) -> DataFrame:
    """Aggregate by each of ``names`` (and ``key``) apart; in a set the other names are NULL.

    One pass, and one shuffle, for every ``SETS_AT_ONCE`` names. With ``together`` the rows of a key are in one
    partition (see :func:`by_whole_keys`), which a GROUPING SETS clause would forget: the sets are made as an
    array in the row, and nothing is shuffled.
    """
    if together and key is not None and len(names) <= SETS_IN_PLACE:
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        others = [column(f) for f in rows.columns if f not in {key, *names}]
        sets = F.array(*[
            F.struct(F.lit(i).alias("__set"), *[
                (column(n) if n == own else F.lit(None).cast(kinds[n])).alias(n) for n in names])
            for i, own in enumerate(names)])
        cells = rows.select(column(key), *others, F.inline(sets))
        return cells.groupBy(column(key), "__set", *[column(n) for n in names]).agg(*exprs).drop("__set")
    fixed = [] if key is None else [column(key)]
    passes = []
    for begin in range(0, len(names), SETS_AT_ONCE):
        own = [column(n) for n in names[begin:begin + SETS_AT_ONCE]]
        passes.append(rows.groupingSets([[*fixed, n] for n in own], *fixed, *own).agg(*exprs))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), passes)


def _bitmask_distinct(value: Column, low: int, high: int) -> Column:
    if high - low > 62:
        raise ValueError("a bit-mask distinct count covers at most 63 values")
    # Shifting needs the mask typed as a long and the distance as an int.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (value - F.lit(low)).cast("int"))
    outside = F.raise_error(F.lit(f"value outside the declared range {low}..{high}"))
    mask = F.when(value.isNull(), F.lit(None)).when(value.between(low, high), bit).otherwise(outside)
    return F.coalesce(F.bit_count(F.bit_or(mask)), F.lit(0)).cast("long")


def distinct_profile(df: DataFrame, key: str, cols: Sequence[str], approximate: bool = False,
                     suffix: str = "nunique", together: bool = False) -> DataFrame:
    """Exact distinct counts of several columns per key, NULL not counted.

    One grouping set per column de-duplicates (key, value) pairs before and after the first
    shuffle, so a hot key is spread over its values, and no task holds a set of them. The
    second grouping counts what is left. ``approximate`` uses sketches instead, in one pass.
    ``together`` is that of :func:`by_each`.
    """
    rows = df.where(column(key).isNotNull())
    if approximate:
        return rows.groupBy(column(key)).agg(*[
            F.approx_count_distinct(clean(rows, c)).alias(f"{c}_{suffix}") for c in cols])
    slim = rows.select(column(key), *[clean(rows, c).alias(f"__d{i}") for i, c in enumerate(cols)])
    names = [f"__d{i}" for i in range(len(cols))]
    number = F.count(F.lit(1)) if together else F.grouping_id()
    pairs = by_each(slim, names, number.alias("__rows"), key=key, together=together)
    # Within the set of one column all the others are NULL, so count() sees only its values.
    return pairs.groupBy(column(key)).agg(*[
        F.count(n).alias(f"{c}_{suffix}") for n, c in zip(names, cols)])


def entity_profile(df: DataFrame, key: str, spec: Mapping[str, Sequence[str]],
                   count_name: str | None = "transactions_count",
                   domains: Mapping[str, tuple[int, int]] | None = None,
                   approximate: bool = False, distinct_from: DataFrame | None = None,
                   together: bool = False) -> DataFrame:
    """Aggregate ``{column: [sum, mean, max, min, std, count, nunique]}`` by ``key``.

    Outputs are named ``{column}_{statistic}``; the row count comes with the same grouping.
    Distinct counts of columns without a small declared domain are computed apart, on narrow
    rows, and joined on the key: inside one wide aggregate Spark would carry every other
    aggregate's buffer along with each distinct value. ``distinct_from`` may name the same rows
    before lookups that only the other aggregates need. ``domains`` declares the ranges of whole
    numbers for which a bit mask counts distinct values inside the wide aggregate. ``together`` is that of
    :func:`by_each`.
    """
    domains = domains or {}
    for name in domains:
        if name in spec and not isinstance(df.schema[name].dataType, T.IntegralType):
            raise ValueError(f"column {name!r} with a declared range must hold whole numbers")
    rows = df.where(column(key).isNotNull())
    exprs, order, wide_distinct = [], [], []
    if count_name:
        exprs.append(F.count(F.lit(1)).alias(count_name))
        order.append(count_name)
    for name, statistics in spec.items():
        value = clean(rows, name)
        for how in statistics:
            out = f"{name}_{how}"
            order.append(out)
            if how == "mean" and "sum" in statistics:
                # Shares the sum's buffer; Spark would keep a second one for avg().
                exprs.append(F.try_divide(F.sum(value).cast("double"), F.count(value)).alias(out))
            elif how != "nunique":
                exprs.append(aggregate(value, how).alias(out))
            elif name in domains:
                exprs.append(_bitmask_distinct(value, *domains[name]).alias(out))
            else:
                wide_distinct.append(name)
    if not wide_distinct:
        result = rows.groupBy(column(key)).agg(*exprs)
    else:
        source = rows if distinct_from is None else distinct_from
        distinct = distinct_profile(source, key, wide_distinct, approximate, together=together)
        result = rows.groupBy(column(key)).agg(*exprs).join(distinct, key, "left") if exprs else distinct
    return result.select(column(key), *[column(name) for name in order])


def two_level_profile(df: DataFrame, key: str, sub_key: str, measures: Sequence[str],
                      inner: Sequence[str], outer: Sequence[str]) -> DataFrame:
    """Aggregate by (key, sub key), then aggregate those results by key.

    Both levels combine before they shuffle, so a key with very many rows reaches the second
    shuffle as one row per sub key and map task.
    """
    rows = df.where(column(key).isNotNull() & column(sub_key).isNotNull())
    first = rows.groupBy(column(key), column(sub_key)).agg(*[
        aggregate(clean(rows, m), how).alias(f"{m}_{how}") for m in measures for how in inner])
    names = [f"{m}_{how}" for m in measures for how in inner]
    return first.groupBy(column(key)).agg(*[
        aggregate(column(n), how).alias(f"{n}_{how}") for n in names for how in outer])


SUCCESSIVE_STATISTICS = ("mean", "min", "max", "std")


def successive_aggregate(df: DataFrame, key: str, field1: str, field2: str) -> DataFrame:
    """Mean of ``field2`` per (key, field1), then mean, min, max and std of those per key."""
    rows = df.where(column(key).isNotNull()).select(
        column(key), clean(df, field1).alias("__f1"), clean(df, field2).alias("__f2"))
    means = rows.where(F.col("__f1").isNotNull()).groupBy(column(key), "__f1").agg(F.avg("__f2").alias("__mean"))
    return means.groupBy(column(key)).agg(*[
        aggregate(F.col("__mean"), how).alias(f"{field1}_{field2}_{how}")
        for how in SUCCESSIVE_STATISTICS])


def successive_features(df: DataFrame, key: str, pairs: Sequence[tuple[str, str]],
                        together: bool = False) -> DataFrame:
    """:func:`successive_aggregate` of many pairs, on the keys that the first pair keeps.

    All first fields are grouping sets of a single pass: one scan, one shuffle by
    (key, field value), one by key, and no join, however many pairs there are. ``together`` is that of
    :func:`by_each`.
    """
    firsts = list(dict.fromkeys(f1 for f1, _ in pairs))
    seconds = list(dict.fromkeys(f2 for _, f2 in pairs))
    group = {f1: f"__g{i}" for i, f1 in enumerate(firsts)}
    measure = {f2: f"__m{i}" for i, f2 in enumerate(seconds)}
    rows = df.where(column(key).isNotNull()).select(
        column(key),
        *[clean(df, f1).alias(g) for f1, g in group.items()],
        *[clean(df, f2).alias(m) for f2, m in measure.items()])
    means = by_each(rows, list(group.values()), *[F.avg(m).alias(f"{m}_mean") for m in measure.values()], key=key, together=together)
    # Catalyst moves this below the first aggregation: rows without the set's field stop there.
    means = means.where(_any_filled(list(group.values())))
    # A set's own column is NULL in every other set, and where the field itself is missing.
    exprs = [
        aggregate(F.when(column(group[f1]).isNotNull(), column(f"{measure[f2]}_mean")), how)
        .alias(f"{f1}_{f2}_{how}")
        for f1, f2 in pairs for how in SUCCESSIVE_STATISTICS
    ]
    result = means.groupBy(column(key)).agg(F.count(column(group[pairs[0][0]])).alias("__base"), *exprs)
    return result.where(F.col("__base") > 0).drop("__base")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value of a column read as text, most frequent first; NULL counts as ``nan``."""
    counts = df.groupBy(as_level(df, col).alias(col)).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), column(col))


def as_level(df: DataFrame, col: str) -> Column:
    """A column as a text level, with one token for missing values."""
    return F.coalesce(clean(df, col).cast("string"), F.lit("nan"))


def smoothed_group_mean(df: DataFrame, key: str, value: str,
                        prior_weight: float | None = None) -> DataFrame:
    """Group means moved by the table's mean: (mean * n + prior) / n per group.

    ``prior_weight`` C gives the usual shrinkage (mean * n + prior * C) / (n + C) instead.
    n counts all rows of the group, missing values included. One scan fills a table of group
    sums; the prior comes from that table.
    """
    rows = df.select(column(key).alias(key), clean(df, value).cast("double").alias("__v"))
    sums = stage(rows.groupBy(column(key)).agg(
        F.sum("__v").alias("__sum"), F.count("__v").alias("__filled"), F.count(F.lit(1)).alias("__n")))
    prior = sums.agg(F.try_divide(F.sum("__sum"), F.sum("__filled")).alias("prior")).scalar()
    groups = sums.where(column(key).isNotNull()).withColumn(
        "__mean", F.try_divide("__sum", "__filled"))
    n = F.col("__n").cast("double")
    if prior_weight is None:
        smoothed = (F.col("__mean") * n + prior) / n
    else:
        smoothed = (F.col("__mean") * n + prior * F.lit(float(prior_weight))) / (n + F.lit(float(prior_weight)))
    return groups.select(column(key), smoothed.alias(f"{value}_smoothed"))


def grouped_means(df: DataFrame, cats: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means of ``values`` per level of each category column.

    One row per category column and level; the level sits in its own column ``level_{cat}``
    and the other level columns are NULL.
    """
    rows = df.select(*[clean(df, c).alias(f"level_{c}") for c in cats],
                     *[clean(df, v).alias(f"__v{i}") for i, v in enumerate(values)])
    levels = [f"level_{c}" for c in cats]
    means = by_each(rows, levels, *[F.avg(f"__v{i}").alias(f"mean_{v}") for i, v in enumerate(values)])
    return means.where(_any_filled(levels))


def _any_filled(names: Sequence[str]) -> Column:
    """Whether any of the columns holds a value; a balanced tree keeps the plan shallow."""
    if len(names) == 1:
        return column(names[0]).isNotNull()
    half = len(names) // 2
    return _any_filled(names[:half]) | _any_filled(names[half:])
