"""Filling missing numbers from the column's own distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.nulls import column, null_if_nan
from sparkfeat.operators.quantiles import exact_quantiles


def _as_double(name: str) -> Column:
    return null_if_nan(column(name).cast("double"))


def fill_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns as doubles with missing values replaced by the column mean.

    All means come from one aggregation, read through a scalar subquery.
    """
    means = df.agg(F.struct(*[F.avg(_as_double(c)).alias(f"m{i}") for i, c in enumerate(cols)])
                   .alias("means")).scalar()
    return df.withColumns({
        c: F.coalesce(_as_double(c), means.getField(f"m{i}")) for i, c in enumerate(cols)})


def fill_quantile(df: DataFrame, cols: Sequence[str], q: float = 0.5,
                  approximate: bool = False, fit_on: DataFrame | None = None,
                  state: DataFrame | None = None) -> DataFrame:
    """Columns as doubles with missing values replaced by the column's quantile.

    The fit reads its input twice before the result reads ``df``: give a stored table as
    ``fit_on`` if ``df`` is the result of joins. A kept ``state`` of those rows spares the first read,
    and with ``approximate`` both; see :func:`quantile_state`.
    """
    found = exact_quantiles(df if fit_on is None else fit_on, cols, [q], approximate=approximate, state=state)
    return df.withColumns({
        c: F.coalesce(_as_double(c), F.lit(found[c][0]).cast("double")) for c in cols})
