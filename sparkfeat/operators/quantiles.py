"""Exact quantiles without sorting the table.

A sketch pass brackets every wanted rank, then one more pass counts what lies below the
brackets and keeps the values within: a few ten-thousandths of the data. The counts prove
that a bracket holds its rank; if one does not, it is widened to everything and counted
again, so the sketch only ever affects the cost.

A state keeps the sketches of a table as rows: states of history and of new rows merge into that of both,
which brackets the ranks of both without a sketch pass over the history, or answers by itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.nulls import column, null_if_nan
from sparkfeat.operators.ranking import GROUP_LIMIT, running_total
from sparkfeat.sources.staging import staged

ACCURACY = 10_000
#: Items that a kept sketch holds for each level, and how far its ranks are taken to be off: several times the
#: error that is usual for that size, merged or not.
STATE_ITEMS = 4_000
STATE_MARGIN = 0.004
_EVERYTHING = [(-math.inf, math.inf)]


def _merge(intervals: list[tuple[float, float]]) -> list[tuple[float, float]]:
    merged: list[tuple[float, float]] = []
    for low, high in sorted(intervals):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _bracketed(cells: DataFrame, intervals: dict[int, list]) -> DataFrame:
    """Count the cells per column and region, by value inside brackets and in total outside.

    Regions are odd inside the brackets and even below, between and above them: a value passes a
    low end by reaching it and a high end by exceeding it. The brackets are a table of one row
    for each column, so that the plan does not grow with them.
    """
    value = F.col("value")
    most = max(len(found) for found in intervals.values())
    lines = [(i, *[edge for bracket in found for edge in bracket], *[None] * (2 * (most - len(found))))
             for i, found in intervals.items()]
    ends = ", ".join(f"low{k} double, high{k} double" for k in range(most))
    brackets = cells.sparkSession.createDataFrame(lines, f"series int, {ends}")
    region = F.lit(0)
    for k in range(most):
        for passed in (value >= F.col(f"low{k}"), value > F.col(f"high{k}")):
            region = region + F.coalesce(passed, F.lit(False)).cast("int")
    marked = cells.join(F.broadcast(brackets), "series").withColumn("region", region)
    kept = F.when(F.col("region") % 2 == 1, value)
    return marked.groupBy("series", "region", kept.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _cells(df: DataFrame, cols: Sequence[str], pooled: bool) -> DataFrame:
    """Long form of the columns: (series, value), missing cells left out."""
    def number(name: str) -> Column:
        return null_if_nan(column(name).cast("double"))

    pairs = F.array(*[
        F.struct(F.lit(0 if pooled else i).alias("series"), number(c).alias("value"))
        for i, c in enumerate(cols)])
    return df.select(F.explode(pairs).alias("cell")).select("cell.series", "cell.value").where(
        F.col("value").isNotNull())


def quantile_state(df: DataFrame, cols: Sequence[str], pooled: bool = False) -> DataFrame:
    """``series, n, sketch``: a small mergeable sketch of each column, or of all cells together (series ``*``).

    A frame of one row for each column that has a value, to be written and read as any table.
    """
    names = F.array(*[F.lit(name) for name in (["*"] if pooled else cols)])
    return _cells(df, cols, pooled).groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", F.lit(STATE_ITEMS)).alias("sketch")).select(
        names[F.col("series")].alias("series"), "n", "sketch")


def merge_quantile_states(*states: DataFrame) -> DataFrame:
    """The state of all rows of the states' tables together."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy("series").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def state_quantiles(state: DataFrame, probs: Sequence[float]) -> dict[str, list[float]]:
    """Approximate quantiles of every series of a state; no table is read."""
    points = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probs]))
    return {row["series"]: list(row["q"]) for row in state.select("series", points.alias("q")).collect()}


def _bracket_ends(probs: Sequence[float], margin: float) -> list[float]:
    return [min(max(p + side * margin, 0.0), 1.0) for p in probs for side in (-1, 1)]


def _sketched(cells: DataFrame, probs: Sequence[float]) -> tuple[dict[int, int], dict[int, list]]:
    """Cells of each series, and the brackets of its ranks, by a pass over the cells."""
    sketch = cells.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("value", _bracket_ends(probs, 2.0 / ACCURACY), ACCURACY).alias("ends"))
    sizes, intervals = {}, {}
    for row in sketch.collect():
        sizes[row["series"]], bounds = row["n"], row["ends"]
        intervals[row["series"]] = _merge([(bounds[2 * k], bounds[2 * k + 1]) for k in range(len(probs))])
    return sizes, intervals


def _from_state(state: DataFrame, names: Sequence[str], probs: Sequence[float]) -> tuple[dict[int, int], dict[int, list]]:
    """The same from a kept state."""
    ends = _bracket_ends(probs, STATE_MARGIN)
    found = state_quantiles(state, ends)
    counts = {row["series"]: row["n"] for row in state.select("series", "n").collect()}
    missing = [name for name in names if name not in counts]
    sizes = {i: counts[name] for i, name in enumerate(names) if name in counts}
    intervals = {}
    for i in sizes:
        # The ends of the whole are open: nothing lies beyond them.
        edges = [-math.inf if p <= 0.0 else math.inf if p >= 1.0 else x for p, x in zip(ends, found[names[i]], strict=True)]
        intervals[i] = _merge([(edges[2 * k], edges[2 * k + 1]) for k in range(len(probs))])
    intervals |= {names.index(name): _EVERYTHING for name in missing}
    return sizes | {names.index(name): 0 for name in missing}, intervals


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    pooled: bool = False, approximate: bool = False,
                    group_limit: int = GROUP_LIMIT, state: DataFrame | None = None) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation, per column, or over all cells together.

    The result is ``{column: [one value per probability]}``; a pooled result has the single
    key ``"*"``. ``approximate`` stops after the sketch. A ``state`` of the very rows of ``df`` (see
    :func:`quantile_state`, merged or not) spares the sketch pass, and with ``approximate`` any
    pass; that it has as many values as the rows is checked by the counting pass.
    """
    cells = _cells(df, cols, pooled)
    names = ["*"] if pooled else list(cols)
    if approximate:
        if state is not None:
            known = state_quantiles(state, probs)
            return {name: known.get(name, [None] * len(probs)) for name in names}
        sketch = cells.groupBy("series").agg(
            F.percentile_approx("value", [float(p) for p in probs], ACCURACY).alias("q"))
        found = {row["series"]: list(row["q"]) for row in sketch.collect()}
        return {name: found.get(i, [None] * len(probs)) for i, name in enumerate(names)}

    sizes, intervals = _sketched(cells, probs) if state is None else _from_state(state, names, probs)
    ranks = {
        i: sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}) if n else []
        for i, n in sizes.items()
    }
    values: dict[tuple[int, int], float] = {}
    pending = dict(intervals)
    while pending:
        missed = _select_ranks(cells, pending, {i: ranks[i] for i in pending}, values, group_limit, sizes)
        pending = {i: _EVERYTHING for i in missed}

    result = {}
    for i, name in enumerate(names):
        if not sizes.get(i):
            result[name] = [None] * len(probs)
            continue
        points = []
        for p in probs:
            at = p * (sizes[i] - 1)
            low, high = values[i, math.floor(at)], values[i, math.ceil(at)]
            points.append(low + (high - low) * (at - math.floor(at)) if high != low else low)
        result[name] = points
    return result


def _select_ranks(cells: DataFrame, intervals: dict[int, list], ranks: dict[int, list[int]],
                  values: dict, group_limit: int, sizes: dict[int, int]) -> list[int]:
    """Find the values at the given 0-based ranks; return the series whose bracket missed one."""
    marked = _bracketed(cells, intervals)
    with staged(marked) as counts:
        return _from_counts(counts, intervals, ranks, values, group_limit, sizes)


def _from_counts(counts: DataFrame, intervals: dict[int, list], ranks: dict[int, list[int]],
                 values: dict, group_limit: int, sizes: dict[int, int]) -> list[int]:
    # At most (2 * probabilities + 1) regions per column.
    found_regions = counts.groupBy("series", "region").agg(
        F.sum("n").alias("n"), F.count("value").alias("distinct")).collect()
    totals = {(row["series"], row["region"]): row["n"] for row in found_regions}
    seen = {i: sum(n for (series, _), n in totals.items() if series == i) for i in intervals}
    if any(seen[i] != sizes[i] for i in intervals):
        raise ValueError(f"the quantile state is of other rows: it has {[sizes[i] for i in intervals]} values, the table {list(seen.values())}")
    missed, wanted = [], []
    for i, found in intervals.items():
        local = []
        for rank in ranks[i]:
            before = 0
            for region in range(2 * len(found) + 1):
                size = totals.get((i, region), 0)
                if rank < before + size:
                    local.append((region, rank - before, rank))
                    break
                before += size
        if any(region % 2 == 0 for region, _, _ in local):
            missed.append(i)
        else:
            wanted += [(i, *entry) for entry in local]
    if not wanted:
        return missed
    inside = counts.where(F.col("value").isNotNull())
    ordered = running_total(inside, F.col("n"), ["value"], by=["series", "region"],
                            group_limit=group_limit,
                            largest=max(row["distinct"] for row in found_regions))
    targets = counts.sparkSession.createDataFrame(wanted, "series int, region int, rank bigint, whole bigint")
    hit = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    chosen = ordered.join(F.broadcast(targets), ["series", "region"]).where(hit)
    for row in chosen.select("series", "value", "whole").collect():
        values[row["series"], row["whole"]] = row["value"]
    return missed


# The four table-wide quantiles and their column names.
GLOBAL_QUANTILES = {"quan_1": 0.01, "quan_2": 0.05, "quan_3": 0.95, "quan_4": 0.99}


def with_global_quantiles(df: DataFrame, cols: Sequence[str],
                          probs: dict[str, float] | None = None,
                          approximate: bool = False, state: DataFrame | None = None) -> DataFrame:
    """Add quantiles over all cells of ``cols`` together, the same value on every row."""
    wanted = GLOBAL_QUANTILES if probs is None else probs
    found = exact_quantiles(df, cols, list(wanted.values()), pooled=True, approximate=approximate, state=state)["*"]
    return df.withColumns({
        name: F.lit(value).cast("double") for name, value in zip(wanted, found)})
