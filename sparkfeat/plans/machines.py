"""From a machine table with text columns to an encoded, gap-free feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from sparkfeat.functions.nulls import column
from sparkfeat.functions.text import contains_flag, first_parts, sku_family
from sparkfeat.operators.encode import bucket_rare_apply, bucket_rare_fit, target_encode_columns
from sparkfeat.operators.impute import fill_mean, fill_quantile
from sparkfeat.operators.version import segment_widths, version_number

# The battery marker, and the branch name's delimiter and parts to keep.
BATTERY_NEEDLE = "li"
BRANCH_DELIMITER, BRANCH_PARTS = "_", 2
# The machine table's columns by treatment, and the level sizes to keep.
MACHINE_COLUMNS = {
    "branch_cols": ["Census_OSBranch"],
    "sku_cols": ["Census_OSSkuName"],
    "battery_cols": ["Census_InternalBatteryType"],
    "rare_thresholds": {"OsSuite": 100, "LocaleEnglishNameIdentifier": 100000},
    "version_cols": ["OsVer", "AvSigVersion", "EngineVersion", "AppVersion", "Census_OSVersion"],
}
MACHINE_LABEL = "HasDetections"


def machine_features(df: DataFrame, key: str, label: str, branch_cols: Sequence[str] = (),
                     sku_cols: Sequence[str] = (), battery_cols: Sequence[str] = (),
                     mean_cols: Sequence[str] = (), median_cols: Sequence[str] = (),
                     rare_thresholds: Mapping[str, int] | None = None,
                     version_cols: Sequence[str] = (),
                     target_cols: Sequence[str] = ()) -> DataFrame:
    """Clean text, fill gaps, merge rare levels, number versions, encode by label.

    ``label`` is NULL on unlabelled rows, which are encoded from the labelled ones. Every fit
    aggregates the cleaned table itself, not the half-encoded one with its joins; all
    applications share a single pass with map-side lookups. A column may be target-encoded or have
    its rare levels merged, not both.
    """
    twice = sorted(set(target_cols) & {*(rare_thresholds or {}), *version_cols, *mean_cols, *median_cols})
    if twice:
        raise ValueError(f"columns {twice} are treated before they would be target-encoded")
    cleaned = df.withColumns({
        **{c: first_parts(column(c), BRANCH_DELIMITER, BRANCH_PARTS) for c in branch_cols},
        **{c: sku_family(column(c)) for c in sku_cols},
        **{c: contains_flag(column(c), BATTERY_NEEDLE) for c in battery_cols},
    })
    codes = {c: bucket_rare_fit(cleaned, c, n, key) for c, n in (rare_thresholds or {}).items()}
    widths = segment_widths(cleaned, version_cols) if version_cols else {}

    encoded = fill_mean(cleaned, mean_cols) if mean_cols else cleaned
    if median_cols:
        encoded = fill_quantile(encoded, median_cols, fit_on=cleaned)
    for name, mapping in codes.items():
        encoded = bucket_rare_apply(encoded, mapping, name, out=name)
    if version_cols:
        encoded = version_number(encoded, version_cols, widths=widths)
    return target_encode_columns(encoded, target_cols, label, fit_on=cleaned) if target_cols else encoded
