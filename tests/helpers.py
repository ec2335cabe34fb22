"""Small helpers for reading results and plans."""

import math


def rows(df, *order):
    """Rows as tuples, sorted by ``order`` (or as they are)."""
    if order:
        df = df.orderBy(*[f"`{c}`" for c in order])
    return [tuple(row) for row in df.collect()]


def same(actual, expected, tolerance=1e-9):
    """Equal values, with NULL equal to NULL and floats within a relative tolerance."""
    if actual is None or expected is None:
        return actual is None and expected is None
    if isinstance(expected, float):
        return math.isclose(actual, expected, rel_tol=tolerance, abs_tol=tolerance)
    return actual == expected


def plan(df, mode="formatted"):
    """The physical plan as text."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
