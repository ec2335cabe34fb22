"""Choosing the narrowest numeric type that holds a column's values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfeat.functions.nulls import clean, column

# The ends of each type's range. A column fits when it lies strictly inside.
INTEGER_RANGES = (
    (T.ByteType(), -(2**7), 2**7 - 1),
    (T.ShortType(), -(2**15), 2**15 - 1),
    (T.IntegerType(), -(2**31), 2**31 - 1),
    (T.LongType(), -(2**63), 2**63 - 1),
)
HALF_MAX = 65504.0
SINGLE_MAX = 3.4028234663852886e38

WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}
_NARROWABLE = (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _fitting_type(current: T.DataType, low, high) -> T.DataType:
    if isinstance(current, (T.FloatType, T.DoubleType)):
        # There is no half-precision type, so both smaller ranges end in a 4-byte float.
        fits = low is not None and low > -SINGLE_MAX and high < SINGLE_MAX
        return T.FloatType() if fits else T.DoubleType()
    for candidate, least, greatest in INTEGER_RANGES:
        if low is not None and low > least and high < greatest:
            return candidate
    return current


def _choose(df: DataFrame, float_columns) -> tuple[dict[str, T.DataType], int]:
    """One pass over the numeric columns: the new type of each, and the row count."""
    def wanted(field: T.StructField) -> bool:
        if not isinstance(field.dataType, _NARROWABLE):
            return False
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            return float_columns == "all" or field.name in float_columns
        return True

    fields = [field for field in df.schema.fields if wanted(field)]
    bounds = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        value = clean(df, field.name)
        bounds += [F.min(value).alias(f"low{i}"), F.max(value).alias(f"high{i}")]
    row = df.agg(*bounds).first()
    chosen = {
        field.name: _fitting_type(field.dataType, row[f"low{i}"], row[f"high{i}"])
        for i, field in enumerate(fields)
    }
    return chosen, row["rows"]


def narrow_types(df: DataFrame, float_columns: Iterable[str] | str = ()) -> DataFrame:
    """Cast each numeric column to the narrowest type strictly containing its min and max.

    Floats stay as they are, since a smaller type checked for range only loses digits; name the
    columns where that is fine in ``float_columns``, or ``"all"``.
    """
    chosen, _ = _choose(df, float_columns)
    changed = {
        name: column(name).cast(to) for name, to in chosen.items() if df.schema[name].dataType != to
    }
    return df.withColumns(changed) if changed else df


def narrowing_report(df: DataFrame, float_columns: Iterable[str] | str = ()) -> DataFrame:
    """Bytes per numeric column before and after :func:`narrow_types`, and the share saved."""
    chosen, rows = _choose(df, float_columns)
    lines = []
    for name, to in chosen.items():
        old, new = df.schema[name].dataType.simpleString(), to.simpleString()
        saved = 100.0 * (WIDTHS[old] - WIDTHS[new]) / WIDTHS[old]
        lines.append((name, old, new, rows * WIDTHS[old], rows * WIDTHS[new], saved))
    schema = ("column string, old_type string, new_type string, "
              "old_bytes bigint, new_bytes bigint, saved_pct double")
    return df.sparkSession.createDataFrame(lines, schema)
