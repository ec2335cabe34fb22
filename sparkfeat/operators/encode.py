"""Encoders: fit a mapping on one table, apply it to any number of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.nulls import clean, column
from sparkfeat.operators.lookups import is_small, lookup
from sparkfeat.operators.profile import as_level, grouped_means
from sparkfeat.operators.ranking import running_total
from sparkfeat.sources.staging import stage, staged

MISSING_CODE = -1
# Fixed value: the name of the bucket of rare levels.
OTHERS = "others"


def factorize_fit(df: DataFrame, col: str, order_col: str) -> DataFrame:
    """Mapping (level, code): levels numbered from 0 by first appearance along ``order_col``."""
    rows = df.select(clean(df, col).alias("level"), column(order_col).alias("__order"))
    firsts = rows.where(F.col("level").isNotNull()).groupBy("level").agg(
        F.min("__order").alias("first"))
    return _numbered(firsts)


def _numbered(firsts: DataFrame) -> DataFrame:
    """Mapping (level, code) from each level's first appearance."""
    with staged(firsts) as levels:
        coded = running_total(levels, F.lit(1).cast("long"), ["first", "level"], out="code")
        return stage(coded.select("level", F.col("code").cast("int").alias("code")))


def factorize(df: DataFrame, col: str, order_col: str, out: str | None = None) -> DataFrame:
    """Integer codes by first appearance; NULL is -1."""
    name = out or f"{col}_code"
    codes = factorize_fit(df, col, order_col)
    return lookup(df, codes, col, {"code": name}, mapping_key="level", default=MISSING_CODE)


def bucket_rare_fit(df: DataFrame, col: str, threshold: int, order_col: str) -> DataFrame:
    """Mapping (level, code) of the levels with at least ``threshold`` rows, and ``others``.

    Missing values are a level of their own. One aggregation yields each level's size and
    first appearance. The mapping has at most rows / threshold entries, plus one.
    """
    counted = (df.select(as_level(df, col).alias("level"), column(order_col).alias("__order"))
               .groupBy("level")
               .agg(F.count(F.lit(1)).alias("n"), F.min("__order").alias("first")))
    kept = F.when(F.col("n") < threshold, F.lit(OTHERS)).otherwise(F.col("level"))
    return _numbered(counted.groupBy(kept.alias("level")).agg(F.min("first").alias("first")))


def bucket_rare_apply(df: DataFrame, mapping: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Codes of the levels; every level outside the mapping gets the code of ``others``."""
    others = mapping.where(F.col("level") == OTHERS).select("code").first()
    keyed = df.withColumn("__level", as_level(df, col))
    encoded = lookup(keyed, mapping, "__level", {"code": out or f"{col}_code"}, mapping_key="level",
                     default=others["code"] if others else None)
    return encoded.drop("__level")


def bucket_rare(df: DataFrame, col: str, threshold: int, order_col: str,
                out: str | None = None) -> DataFrame:
    """Merge levels with fewer than ``threshold`` rows into ``others``, then factorize."""
    return bucket_rare_apply(df, bucket_rare_fit(df, col, threshold, order_col), col, out)


def target_encode_fit(df: DataFrame, cat: str, label: str) -> DataFrame:
    """Mapping (level, mean): the mean label per category over the labelled rows."""
    rows = df.select(clean(df, cat).alias("level"), clean(df, label).alias("__label"))
    labelled = rows.where(F.col("level").isNotNull() & F.col("__label").isNotNull())
    return stage(labelled.groupBy("level").agg(F.avg("__label").alias("mean")))


def target_encode_apply(df: DataFrame, mapping: DataFrame, cat: str, out: str | None = None,
                        fallback: bool = True) -> DataFrame:
    """Replace or add the encoded category.

    Categories without a labelled row get the plain mean of the category means, or NULL when
    ``fallback`` is off.
    """
    default = mapping.agg(F.avg("mean").alias("m")).first()["m"] if fallback else None
    return lookup(df, mapping, cat, {"mean": out or cat}, mapping_key="level", default=default)


def target_encode(df: DataFrame, cat: str, label: str, out: str | None = None,
                  fallback: bool = True) -> DataFrame:
    """Fit on the rows of ``df`` that have a label, apply to all of them."""
    return target_encode_apply(df, target_encode_fit(df, cat, label), cat, out, fallback)


def target_encode_columns(df: DataFrame, cats: Sequence[str], label: str,
                          fit_on: DataFrame | None = None) -> DataFrame:
    """Replace several categories by their mean label, all fitted in one pass.

    ``fit_on`` names the frame to fit on where ``df`` already carries joins the fit can spare.
    """
    source = df if fit_on is None else fit_on
    means = stage(grouped_means(source.where(clean(source, label).isNotNull()), cats, [label]))
    of_column = {c: F.when(column(f"level_{c}").isNotNull(), column(f"mean_{label}")) for c in cats}
    fallback = means.agg(*[F.avg(m).alias(c) for c, m in of_column.items()]).first()
    small = is_small(means)
    result = df
    for cat in cats:
        result = lookup(result, means, cat, {f"mean_{label}": cat}, mapping_key=f"level_{cat}",
                        default=fallback[cat], small=small)
    return result
