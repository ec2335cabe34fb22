"""From a transactions table to one feature row per card."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from sparkfeat.functions.nulls import clean, column
from sparkfeat.operators.group_means import mean_encode, with_group_mean
from sparkfeat.operators.lag import lag_ratio
from sparkfeat.operators.lookups import left_join_all
from sparkfeat.operators.profile import (
    CALENDAR_DOMAINS, aggregate, by_whole_keys, entity_profile, successive_features, two_level_profile,
)
from sparkfeat.operators.project import cast_columns, map_values, month_diff, one_hot, time_features
from sparkfeat.operators.ratios import ratio_features, recency_features
from sparkfeat.sources.staging import stage

# Which statistics each column of a transaction contributes; merchant columns by
# name or by the start of their name, any other by MOMENTS.
MOMENTS = ["sum", "mean", "max", "min", "std"]
BASE_SPEC = {
    "category_1": ["sum", "mean"],
    "category_2_1.0": ["mean", "sum"],
    "category_2_2.0": ["mean", "sum"],
    "category_2_3.0": ["mean", "sum"],
    "category_2_4.0": ["mean", "sum"],
    "category_2_5.0": ["mean", "sum"],
    "category_2_N": ["mean", "sum"],
    "category_3_A": ["mean", "sum"],
    "category_3_B": ["mean", "sum"],
    "category_3_C": ["mean", "sum"],
    "category_3_N": ["mean", "sum"],
    "state_id": ["nunique"],
    "city_id": ["nunique"],
    "purchase_amount": MOMENTS,
    "installments": MOMENTS,
    "month": ["mean", "max", "min", "std", "nunique"],
    "purchase_date": ["min", "max"],
    "month_lag": ["nunique", "mean", "max", "min", "std"],
    "month_diff": ["mean", "max", "min", "std"],
    "weekend": ["sum", "mean"],
}
MERCHANT_SPEC = {"merchant_group_id": ["nunique"], "category_4": ["sum", "mean"]}
MERCHANT_PREFIX_SPEC = {"most_recent": ["sum", "mean"]}
CATEGORY_MEAN_STATISTICS = ["mean", "max", "min", "std"]
# Columns that are only counted, the categories and their levels.
DISTINCT_COLUMNS = ("hour", "weekofyear", "dayofweek", "year", "subsector_id", "merchant_id",
                    "merchant_category_id")
CATEGORIES = ("category_1", "category_2", "category_3", "category_4")
CATEGORY_2_LEVELS = (1.0, 2.0, 3.0, 4.0, 5.0)
CATEGORY_3_LEVELS = ("A", "B", "C")
FLAG_VALUES = {"Y": 1, "N": 0}
# The monthly statistics.
MONTHLY_STATISTICS = ("count", "sum", "mean", "min", "max", "std")
# Merchant columns that may hold infinities and are kept as 4-byte floats.
FLOAT_COLUMNS = ("numerical_1", "numerical_2", "active_months_lag12", "avg_sales_lag12",
                 "avg_purchases_lag12", "merchant_profit3", "merchant_profit6", "merchant_profit12")
# The card features that are mixed, and with what.
MIXED_FEATURES = ("feature_1", "feature_2", "feature_3")
MIXES = ("outliers", "hist_purchase_amount_mean")
# Pairs of successive aggregates.
SUCCESSIVE_PAIRS = (
    ("category_1", "purchase_amount"),
    ("category_2", "purchase_amount"),
    ("category_3", "purchase_amount"),
    ("installments", "purchase_amount"),
    ("city_id", "purchase_amount"),
    ("category_1", "installments"),
    ("category_2", "installments"),
    ("category_3", "installments"),
    ("category_2", "merchant_profit3"),
    ("category_2", "merchant_profit6"),
    ("category_2", "merchant_profit12"),
    ("category_4", "merchant_profit3"),
    ("category_4", "merchant_profit6"),
    ("category_4", "merchant_profit12"),
)


def statistics_of(name: str, by_name: Mapping[str, Sequence[str]], by_prefix: Mapping[str, Sequence[str]],
                  default: Sequence[str]) -> list[str]:
    """The statistics a table of rules gives a column: by name, else by prefix, else the default."""
    prefixed = (how for prefix, how in by_prefix.items() if name.startswith(prefix))
    return list(by_name.get(name) or next(prefixed, default))


def profile_spec(merchant_cols: Sequence[str] = (), distinct_cols: Sequence[str] = DISTINCT_COLUMNS,
                 base: Mapping[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """The aggregate spec of a card: ``base`` columns, merchant columns by rule, distinct counts."""
    merchants = {c: statistics_of(c, MERCHANT_SPEC, MERCHANT_PREFIX_SPEC, MOMENTS) for c in merchant_cols}
    counted = dict.fromkeys(distinct_cols, ["nunique"])
    means = dict.fromkeys((f"{c}_mean" for c in CATEGORIES), CATEGORY_MEAN_STATISTICS)
    return {c: list(how) for c, how in {**(base or BASE_SPEC), **merchants, **counted, **means}.items()}


def transaction_rows(transactions: DataFrame, as_of: str,
                     flags: Sequence[str] = ("authorized_flag", "category_1")) -> DataFrame:
    """Row features: flags as 0/1, calendar columns, month difference, one-hot categories."""
    rows = map_values(transactions, flags, FLAG_VALUES)
    rows = month_diff(time_features(rows, "purchase_date"), "purchase_date", "month_lag", as_of)
    rows = one_hot(rows, "category_2", CATEGORY_2_LEVELS)
    return one_hot(rows, "category_3", CATEGORY_3_LEVELS)


def card_profile(rows: DataFrame, merchant_cols: Sequence[str], as_of: str,
                 distinct_cols: Sequence[str] = DISTINCT_COLUMNS, stage_rows: bool = False) -> DataFrame:
    """The aggregated card with its recency and ratio columns.

    The rows are read three times; ``stage_rows`` writes them if joins made them, and again by card.
    """
    if stage_rows:
        return by_whole_keys(_with_means(stage(rows)), "card_id",
                             lambda part, together: _profile(part, part, merchant_cols, as_of, distinct_cols, together))
    return _profile(_with_means(rows), rows, merchant_cols, as_of, distinct_cols)


def _with_means(rows: DataFrame) -> DataFrame:
    return with_group_mean(rows, CATEGORIES, "purchase_amount")


def _profile(with_means: DataFrame, rows: DataFrame, merchant_cols: Sequence[str], as_of: str,
             distinct_cols: Sequence[str], together: bool = False) -> DataFrame:
    profile = entity_profile(with_means, "card_id", profile_spec(merchant_cols, distinct_cols),
                             domains=CALENDAR_DOMAINS, distinct_from=rows, together=together)
    return ratio_features(recency_features(profile, as_of))


def monthly_profile(rows: DataFrame) -> DataFrame:
    """Mean and std over the months of a card's monthly amount and instalment statistics."""
    return two_level_profile(rows, "card_id", "month_lag", ["purchase_amount", "installments"],
                             MONTHLY_STATISTICS, ["mean", "std"])


def monthly_purchases(rows: DataFrame) -> DataFrame:
    """Purchase amount per card and month."""
    months = rows.where(F.col("card_id").isNotNull() & F.col("month_lag").isNotNull())
    return months.groupBy("card_id", "month_lag").agg(
        aggregate(clean(rows, "purchase_amount"), "sum").alias("purchase_amount"))


def purchase_ratio(rows: DataFrame) -> DataFrame:
    """Each month's predecessor over the month itself; a card has one row per month."""
    return lag_ratio(monthly_purchases(rows), "card_id", "month_lag", "purchase_amount",
                     "purchase_ratio", bounded_groups=True)


def float_columns(rows: DataFrame, cols: Sequence[str] = FLOAT_COLUMNS) -> DataFrame:
    return cast_columns(rows, cols, "float")


def mix_features(train: DataFrame, test: DataFrame, features: Sequence[str] = MIXED_FEATURES,
                 mixes: Sequence[str] = MIXES) -> tuple[DataFrame, DataFrame]:
    """Training means of the mixes per level of each card feature, added to both tables."""
    encoded = mean_encode(train, [test], features, mixes)
    return encoded[0], encoded[1]


def card_features(transactions: DataFrame, merchant_cols: Sequence[str], as_of: str,
                  flags: Sequence[str] = ("authorized_flag", "category_1"),
                  distinct_cols: Sequence[str] = DISTINCT_COLUMNS,
                  stage_rows: bool = False, prefix: str = "") -> DataFrame:
    """Everything per card: profile, monthly statistics and successive aggregates.

    The rows are read five times, each time only the columns in use. If ``transactions`` is
    itself the result of joins rather than a stored table, ``stage_rows`` writes the prepared
    rows so that those joins do not run five times, and then once more by card, so that the
    rows are shuffled once instead of their aggregates five times. ``prefix`` goes before every column but
    ``card_id``, to join the profiles of several transaction tables to one card table.
    """
    rows = transaction_rows(transactions, as_of, flags)

    def features_of(with_means: DataFrame, rows: DataFrame, together: bool = False) -> DataFrame:
        return left_join_all(
            _profile(with_means, rows, merchant_cols, as_of, distinct_cols, together),
            [monthly_profile(rows), successive_features(rows, "card_id", SUCCESSIVE_PAIRS, together)],
            "card_id")

    if stage_rows:
        features = by_whole_keys(_with_means(stage(rows)), "card_id",
                                 lambda part, together: features_of(part, part, together))
    else:
        features = features_of(_with_means(rows), rows)
    return features.select("card_id", *[column(c).alias(f"{prefix}{c}") for c in features.columns if c != "card_id"])
