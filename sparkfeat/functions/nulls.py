"""Missing values: SQL NULL is the only one; NaN is turned into it on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_if_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(None))


def clean(df: DataFrame, name: str) -> Column:
    """The named column, with NaN as NULL when the type can hold NaN."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return null_if_nan(column(name))
    return column(name)
