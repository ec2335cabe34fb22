"""Ratios and spans derived from a finished card profile: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.calendar import days_between, epoch_seconds, instant

# The look-back windows in months, and the guard against a zero divisor.
WINDOWS = (3, 6, 12)
EPSILON = 1e-15


def recency_features(profile: DataFrame, as_of: str, date: str = "purchase_date",
                     count: str = "transactions_count") -> DataFrame:
    """Day spans of the entity's first and last date, days to ``as_of``, dates as seconds."""
    first, last, today = F.col(f"{date}_min"), F.col(f"{date}_max"), instant(as_of)
    span = days_between(last, first)
    return profile.withColumns({
        f"{date}_span": span,
        f"{date}_avg_span": F.try_divide(span.cast("double"), F.col(count)),
        f"{date}_uptonow_max": days_between(today, last),
        f"{date}_uptonow_min": days_between(today, first),
        f"{date}_max": epoch_seconds(last),
        f"{date}_min": epoch_seconds(first),
    })


def ratio_features(profile: DataFrame) -> DataFrame:
    """Activity, merchant-activity, gain and energy ratios of a card profile.

    A zero divisor gives NULL, except where the small guard is added to it.
    """
    months = F.col("month_lag_nunique").cast("double")
    periods = F.floor(F.col("purchase_date_span") / F.lit(30)) + F.lit(1)
    per_month = F.try_divide(F.col("purchase_amount_sum"), months)
    active = F.try_divide(months, periods)
    columns = {"avg_purchase_amount_per_act_month": per_month, "card_active_ratio": active}
    for w in WINDOWS:
        merchant_active = F.col(f"active_months_lag{w}_mean")
        profit = F.col(f"merchant_profit{w}_mean") + F.lit(EPSILON)
        columns[f"merchant_active_ratio{w}"] = merchant_active / F.lit(w)
        columns[f"card_merch_act_ratio{w}"] = F.try_divide(active, merchant_active / F.lit(w))
        columns[f"card_merch_gain_ratio{w}"] = F.try_divide(per_month, profit)
        columns[f"card_merch_biasgain_ratio{w}"] = F.try_divide(F.col("purchase_amount_mean"), profit)
        columns[f"energy_ratio{w}"] = F.try_divide(months, merchant_active)
    return profile.withColumns(columns)
