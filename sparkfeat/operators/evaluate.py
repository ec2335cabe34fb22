"""Exact evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.nulls import clean, column
from sparkfeat.operators.ranking import GROUP_LIMIT, running_total
from sparkfeat.sources.staging import stage, staged


def exact_auc(df: DataFrame, label: str, score: str, by: str | None = None,
              out: str = "auc", group_limit: int = GROUP_LIMIT,
              slices: int | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half, for the table or per ``by`` group.

    Rows with equal scores collapse to one (score, positives, negatives) row before anything
    is ordered; the negatives below each score are a running total over those. NULL when a
    class is absent.
    """
    result = _auc(stage(_tally(df, label, score, by)), by, out, group_limit, slices)
    return result.withColumnRenamed("__by", by) if by else result


def _tally(df: DataFrame, label: str, score: str, by: str | None, count: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score; a row stands for ``count`` of them."""
    rows = df.select(*([column(by).alias("__by")] if by else []), *([column(count).alias("__count")] if count else []),
                     clean(df, score).alias("__score"), clean(df, label).cast("double").alias("__label"))
    rows = rows.where(F.col("__score").isNotNull() & F.col("__label").isNotNull())
    positive, negative = F.col("__label") > 0, F.col("__label") <= 0
    if count:
        pos, neg = (F.sum(F.when(side, F.col("__count")).otherwise(0)) for side in (positive, negative))
    else:
        pos, neg = F.count_if(positive), F.count_if(negative)
    return rows.groupBy(*(["__by"] if by else []), "__score").agg(pos.alias("pos"), neg.alias("neg"))


def _auc(tally: DataFrame, by: str | None, out: str, group_limit: int = GROUP_LIMIT,
         slices: int | None = None) -> DataFrame:
    groups = ["__by"] if by else []
    ordered = running_total(tally, F.col("neg"), ["__score"], by=groups, out="below",
                            group_limit=group_limit, slices=slices)
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ordered.groupBy(*groups).agg(F.try_divide(wins, pairs).alias(out))


def neg_rmse(df: DataFrame, label: str, prediction: str, out: str = "neg_rmse", count: str | None = None) -> DataFrame:
    """Minus the root of the mean squared error, so that larger is better; a row stands for ``count`` of them."""
    error = clean(df, prediction).cast("double") - clean(df, label).cast("double")
    if count is None:
        return df.agg((-F.sqrt(F.avg(error * error))).alias(out))
    times = F.when(error.isNotNull(), column(count))
    return df.agg((-F.sqrt(F.try_divide(F.sum(error * error * times), F.sum(times)))).alias(out))


def metric_row(metric: DataFrame, name: str, higher_is_better: bool = True) -> DataFrame:
    """A one-value metric frame as (name, value, higher_is_better)."""
    value = column(metric.columns[0]).cast("double")
    return metric.select(F.lit(name).alias("name"), value.alias("value"),
                         F.lit(higher_is_better).alias("higher_is_better"))


def auc_metric(df: DataFrame, label: str = "label", prediction: str = "prediction", count: str | None = None) -> float:
    """The AUC as a number, for a search; nothing stays behind in the staging folder."""
    with staged(_tally(df, label, prediction, None, count)) as tally:
        return _auc(tally, None, "auc").first()["auc"]


def neg_rmse_metric(df: DataFrame, label: str = "label", prediction: str = "prediction", count: str | None = None) -> float:
    return neg_rmse(df, label, prediction, count=count).first()["neg_rmse"]
