"""From anonymous numeric columns to row statistics and table-wide quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sparkfeat.operators.project import feature_columns
from sparkfeat.operators.quantiles import with_global_quantiles
from sparkfeat.operators.rowstats import row_statistics

# The columns of such a table that are not features.
NOT_NUMERIC = ("ID_code", "target")


def row_features(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Add the eight row statistics and the four quantiles over all feature cells."""
    cols = list(features) if features is not None else feature_columns(df, NOT_NUMERIC)
    return with_global_quantiles(row_statistics(df, cols), cols)
