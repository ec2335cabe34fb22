"""Column selection, value mapping, casts and row splits: narrow operators, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfeat.functions.calendar import days_between, instant, to_timestamp
from sparkfeat.functions.nulls import clean, column, null_if_nan

# The identifier and label columns that are never features.
NOT_FEATURES = ("card_id", "first_active_month", "target", "outliers")


def feature_columns(df: DataFrame, exclude: Iterable[str] = NOT_FEATURES) -> list[str]:
    """Names of all columns outside ``exclude``, in table order."""
    skipped = set(exclude)
    return [name for name in df.columns if name not in skipped]


def select_features(df: DataFrame, exclude: Iterable[str] = NOT_FEATURES) -> DataFrame:
    return df.select(*[column(name) for name in feature_columns(df, exclude)])


def select_supported(df: DataFrame, feature_cols: Sequence[str], support: Sequence[bool],
                     keep: Sequence[str] = ()) -> DataFrame:
    """Keep the features whose support flag is true, matched by name, plus ``keep``."""
    if len(feature_cols) != len(support):
        raise ValueError("one support flag per feature is needed")
    chosen = [name for name, flag in zip(feature_cols, support) if flag]
    return df.select(*[column(name) for name in [*keep, *chosen]])


def split_all_null(df: DataFrame, probe_cols: Sequence[str],
                   leftover_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Divide the rows: those with any probe column filled, and those with none.

    The second frame is narrowed to ``leftover_cols``. With no probe column every row is
    "all null".
    """
    if probe_cols:
        filled = [clean(df, name).isNotNull() for name in probe_cols]
        any_filled = filled[0]
        for condition in filled[1:]:
            any_filled = any_filled | condition
    else:
        any_filled = F.lit(False)
    leftover = df.where(~any_filled).select(*[column(name) for name in leftover_cols])
    return df.where(any_filled), leftover


def map_values(df: DataFrame, cols: Sequence[str], mapping: Mapping) -> DataFrame:
    """Replace values by ``mapping``; a value outside it becomes NULL."""
    def mapped(name: str) -> Column:
        result = F.lit(None)
        for source, target in mapping.items():
            result = F.when(column(name) == F.lit(source), F.lit(target)).otherwise(result)
        return result
    return df.withColumns({name: mapped(name) for name in cols})


def replace_values(df: DataFrame, cols: Sequence[str], mapping: Mapping) -> DataFrame:
    """Replace exact whole-cell values; everything else stays."""
    def replaced(name: str) -> Column:
        result = column(name)
        for source, target in mapping.items():
            hit = column(name).isNull() if source is None else column(name) == F.lit(source)
            result = F.when(hit, F.lit(target)).otherwise(result)
        return result.cast(df.schema[name].dataType)
    return df.withColumns({name: replaced(name) for name in cols})


def patch_value(df: DataFrame, key_col: str, key, col: str, value) -> DataFrame:
    """Overwrite one cell, addressed by its row key."""
    patched = F.when(column(key_col) == F.lit(key), F.lit(value)).otherwise(column(col))
    return df.withColumn(col, patched.cast(df.schema[col].dataType))


def cast_columns(df: DataFrame, cols: Sequence[str], to: str | T.DataType) -> DataFrame:
    return df.withColumns({name: column(name).cast(to) for name in cols})


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.drop(*cols)


def one_hot(df: DataFrame, col: str, levels: Sequence, null_level: str | None = "N") -> DataFrame:
    """Add ``{col}_{level}`` 0/1 columns, and one for NULL named by ``null_level``."""
    value = clean(df, col)
    flags = {
        f"{col}_{level}": F.coalesce(value == F.lit(level), F.lit(False)).cast("int")
        for level in levels
    }
    if null_level is not None:
        flags[f"{col}_{null_level}"] = value.isNull().cast("int")
    return df.withColumns(flags)


def time_features(df: DataFrame, ts_col: str) -> DataFrame:
    """Calendar columns of a timestamp: ISO week, Monday-first weekday, weekend flag, hour."""
    from_text = isinstance(df.schema[ts_col].dataType, T.StringType)
    stamp = to_timestamp(column(ts_col), from_text)
    day = F.weekday(stamp)
    return df.withColumns({
        ts_col: stamp,
        "year": F.year(stamp),
        "weekofyear": F.weekofyear(stamp),
        "month": F.month(stamp),
        "dayofweek": day,
        "weekend": F.coalesce(day >= 5, F.lit(False)).cast("int"),
        "hour": F.hour(stamp),
    })


def month_diff(df: DataFrame, ts_col: str, lag_col: str, as_of: str,
               out: str = "month_diff") -> DataFrame:
    """Full 30-day periods from the timestamp to ``as_of``, plus the row's own month lag."""
    days = days_between(instant(as_of), column(ts_col))
    return df.withColumn(out, (F.floor(days / F.lit(30)) + column(lag_col)).cast("int"))


def normalise_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({name: null_if_nan(column(name)) for name in floating}) if floating else df
