"""Resampling, evaluation and model-driven jobs.

Where a result is random or fitted, the query returns what must hold for every outcome.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.views import (
    LABELLED_SQL, TXN_SQL, VECTOR_FEATURES, VECTORS_SQL, labelled_documents, r, rounded, table, txn, vectors,
)
from sparkfeat import operators as ops
from sparkfeat import plans
from sparkfeat.functions import column
from sparkfeat.sources import read_table, stage, staging_root

QUERIES, ORACLES = {}, {}


def check(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def _marginals(df, originals, group: str):
    """Marginals per group, and how many rows have all their cells from one original row."""
    cells = F.xxhash64(*[column(c) for c in VECTOR_FEATURES])
    known = originals.select(cells.alias("cells")).distinct().withColumn("known", F.lit(1))
    df = df.withColumn("cells", cells).join(known, "cells", "left")
    parts = [F.count(F.lit(1)).alias("n"), F.count("known").alias("unchanged")]
    for c in VECTOR_FEATURES:
        parts += [F.sum(c).alias(f"{c}_sum"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return rounded(df.groupBy(column(group)).agg(*parts))


_MARGINALS_SQL = "CAST(sum(w) AS BIGINT) AS n, " + ", ".join(
    f"{r(f'sum({c} * w)')} AS {c}_sum, {r(f'min({c})')} AS {c}_min, {r(f'max({c})')} AS {c}_max"
    for c in VECTOR_FEATURES)


@check("shuffle_columns", f"""
SELECT CAST("copy" AS INT) AS "copy", CAST(0 AS BIGINT) AS unchanged, {_MARGINALS_SQL} FROM (SELECT *, 1 AS w, unnest([1, 2]) AS "copy" FROM ({VECTORS_SQL}))
GROUP BY "copy" """)
def shuffle_columns(spark, sf):
    rows = vectors(spark, sf)
    return _marginals(ops.shuffle_columns(rows, VECTOR_FEATURES, "vec_id", copies=2), rows, "copy")


_ORDER_CELLS = ["o_custkey", "o_totalprice", "o_orderpriority"]


@check("shuffle_columns_mixed_types", f"""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS last_row, CAST(sum(o_custkey) AS BIGINT) AS custkey_sum, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS price_sum,
 CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent, TRUE AS apart, TRUE AS moved FROM orders""")
def shuffle_columns_mixed_types(spark, sf):
    """The marginals of each column; no more whole rows than by chance, and cells away from the place that their key's order gives."""
    orders = table(spark, sf, "orders")
    shuffled = stage(ops.shuffle_columns(orders, _ORDER_CELLS, "o_orderkey"))
    whole = orders.select(*_ORDER_CELLS).distinct().withColumn("whole", F.lit(1))
    return shuffled.join(whole, _ORDER_CELLS, "left").agg(
        F.count(F.lit(1)).alias("n"), F.max("row").cast("bigint").alias("last_row"), F.sum("o_custkey").alias("custkey_sum"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price_sum"),
        F.sum((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"),
        (F.count("whole") < F.count(F.lit(1)) * 0.01).alias("apart"),
        (F.abs(F.corr(F.col("row"), F.col("o_custkey"))) < 0.1).alias("moved"))


@check("augment", f"""
SELECT y, count(*) AS unchanged, {_MARGINALS_SQL} FROM (SELECT *, CASE WHEN y > 0 THEN 4 ELSE 2 END AS w FROM ({VECTORS_SQL})) GROUP BY y""")
def augment(spark, sf):
    rows = vectors(spark, sf)
    return _marginals(ops.augment(rows, VECTOR_FEATURES, "y", "vec_id", times=3), rows, "y")


def _fold_sizes(folded, label: str, k: int):
    """How many folds of a label have how many rows: which ones is up to the label's hash."""
    sizes = folded.where(F.col("fold").between(0, k - 1)).groupBy(label, "fold").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(label, "n").agg(F.count(F.lit(1)).alias("folds"))


def _fold_sizes_sql(relation: str, label: str, k: int) -> str:
    return f"""
WITH c AS (SELECT {label} AS l, count(*) AS n FROM {relation} GROUP BY 1),
f AS (SELECT l, (n * (j + 1)) // {k} - (n * j) // {k} AS n FROM (SELECT l, n, unnest(range({k})) AS j FROM c))
SELECT l AS {label}, CAST(n AS BIGINT) AS n, count(*) AS folds FROM f WHERE n > 0 GROUP BY l, n"""


@check("stratified_folds", _fold_sizes_sql("embeddings", "label", 5))
def stratified_folds(spark, sf):
    folded = ops.stratified_folds(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id")
    return _fold_sizes(folded, "label", 5)


@check("stratified_folds_small_labels", _fold_sizes_sql("(SELECT *, o_orderkey // (1 + o_orderkey % 4) AS small FROM orders)", "small", 5)
       .replace("SELECT l AS small, CAST(n AS BIGINT) AS n, count(*) AS folds FROM f WHERE n > 0 GROUP BY l, n",
                "SELECT CAST(n AS BIGINT) AS n, count(*) AS folds, CAST(5 AS BIGINT) AS even FROM f WHERE n > 0 GROUP BY n"))
def stratified_folds_small_labels(spark, sf):
    """Labels of very few rows: each within one row of even, and all folds together within a tenth."""
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey DIV (1 + o_orderkey % 4) AS small")
    folded = stage(ops.stratified_folds(orders, "small", "o_orderkey"))
    rows = folded.count()
    even = folded.groupBy("fold").agg(F.count("*").alias("n")).where(F.abs(F.col("n") * 5 / rows - 1) < 0.1).count()
    sizes = _fold_sizes(folded, "small", 5).groupBy("n").agg(F.sum("folds").alias("folds"))
    return sizes.withColumn("even", F.lit(even).cast("bigint"))


@check("stratified_folds_many_labels", _fold_sizes_sql(
    "(SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey // 7 END AS many FROM orders)", "many", 5))
def stratified_folds_many_labels(spark, sf):
    """A label of a third of all rows among thousands of small ones, by the join for cut points that are too large to broadcast."""
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey DIV 7 END AS many")
    return _fold_sizes(ops.stratified_folds(orders, "many", "o_orderkey", small=False), "many", 5)


@check("stratified_folds_orders", _fold_sizes_sql("orders", "o_orderstatus", 3))
def stratified_folds_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    folded = ops.stratified_folds(orders, "o_orderstatus", "o_orderkey", k=3)
    return _fold_sizes(folded, "o_orderstatus", 3)


def _auc_sql(relation: str, label: str, score: str, by: str | None = None) -> str:
    over = f"PARTITION BY {by} " if by else ""
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""
WITH s AS (SELECT {key}{score} AS s, sum(CASE WHEN {label} > 0 THEN 1 ELSE 0 END) AS p,
 sum(CASE WHEN {label} > 0 THEN 0 ELSE 1 END) AS q FROM ({relation}) WHERE {label} IS NOT NULL GROUP BY {key}{score}),
b AS (SELECT *, sum(q) OVER ({over}ORDER BY s) - q AS below FROM s)
SELECT {key}{r('sum(p * (below + q / 2.0)) / NULLIF(CAST(sum(p) AS DOUBLE) * sum(q), 0)', 9)} AS auc FROM b{group}"""


@check("exact_auc", _auc_sql(LABELLED_SQL, "quality", "n_chars"))
def exact_auc(spark, sf):
    return rounded(ops.exact_auc(labelled_documents(spark, sf), "quality", "n_chars"), 9)


@check("exact_auc_by_group", _auc_sql(LABELLED_SQL, "quality", "n_chars", "lang"))
def exact_auc_by_group(spark, sf):
    return rounded(ops.exact_auc(labelled_documents(spark, sf), "quality", "n_chars", by="lang"), 9)


@check("exact_auc_sliced", _auc_sql(
    "SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice, o_orderpriority FROM orders",
    "y", "o_totalprice", "o_orderpriority"))
def exact_auc_sliced(spark, sf):
    """Groups above the size limit, so that each is cut into ordered slices."""
    orders = table(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return rounded(ops.exact_auc(orders, "y", "o_totalprice", by="o_orderpriority", group_limit=1_000, slices=8), 9)


@check("metric_row", f"""
SELECT 'auc' AS name, auc AS value, TRUE AS higher_is_better FROM ({_auc_sql(LABELLED_SQL, "quality", "n_chars")})""")
def metric_row(spark, sf):
    auc = ops.exact_auc(labelled_documents(spark, sf), "quality", "n_chars")
    return rounded(ops.metric_row(auc, "auc"), 9)


@check("neg_rmse", f"""
SELECT {r('-sqrt(avg((quality - n_chars / 1000.0) * (quality - n_chars / 1000.0)))')} AS neg_rmse
FROM ({LABELLED_SQL}) WHERE quality IS NOT NULL""")
def neg_rmse(spark, sf):
    scored = labelled_documents(spark, sf).withColumn("guess", F.col("n_chars") / 1000.0)
    return rounded(ops.neg_rmse(scored, "quality", "guess"))


def _planted(spark, sf):
    return vectors(spark, sf).withColumn("planted", F.col("y").cast("double"))


@check("oof_predictions", f"""
SELECT y, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS keys, CAST(count(*) AS BIGINT) AS in_range,
 CAST(count(*) AS BIGINT) AS right_side FROM (SELECT CAST(y AS DOUBLE) AS y FROM ({VECTORS_SQL})) GROUP BY y""")
def oof_predictions(spark, sf):
    """With a copy of the label among the features every held-out row lands on its side."""
    features = [*VECTOR_FEATURES, "planted"]
    folded = ops.stratified_folds(_planted(spark, sf), "y", "vec_id", k=3)
    scored = plans.oof_predictions(folded, features, "y", "fold", "vec_id", {"maxIter": 5, "maxDepth": 3}, parallelism=3)
    right = (F.col("prediction") > 0.5) == (F.col("y") > 0.5)
    return scored.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("keys"),
        F.count_if(F.col("prediction").between(0.0, 1.0)).alias("in_range"), F.count_if(right).alias("right_side"))


_SEARCH_ORACLE = """
SELECT CAST({trials} AS BIGINT) AS trials, CAST(1 AS BIGINT) AS best, TRUE AS planted_found, TRUE AS noise_clear, TRUE AS whole_space
FROM (SELECT count(*) FROM embeddings)"""


def _searched(planted, noise, trials: int, found, clear, space=plans.SEARCH_SPACE, fixed=("maxIter",)):
    """The best trial of a search with a copy of the label, and all of one on hashes alone."""
    names = {*space, *fixed}
    keys = F.forall(F.json_object_keys("params"), lambda k: k.isin(*names)) & (
        F.size(F.json_object_keys("params")) == len(names))
    worst = noise.agg(F.max("score")).first()[0]
    return planted.agg(
        F.count(F.lit(1)).alias("trials"), F.count_if("is_best").alias("best"),
        F.max(F.col("is_best") & found(F.col("score"))).alias("planted_found"),
        F.lit(bool(clear(worst))).alias("noise_clear"), F.min(keys).alias("whole_space"))


# The shipped keys, in ranges that fit tables of a few hundred rows as well.
_SPACE = {"maxDepth": (2, 3), "maxLeaves": (4, 50), "stepSize": (0.3, 1.0), "minInstancesPerNode": (5, 20), "subsamplingRate": (0.7, 1.0),
          "featureSubsetStrategy": (0.8, 1.0)}


def _noise(df, names):
    return df.withColumns({c: F.pmod(F.xxhash64("vec_id", F.lit(c)), F.lit(1000)).cast("double") for c in names})


@check("random_search", _SEARCH_ORACLE.format(trials=3))
def random_search(spark, sf):
    """A copy of the label is found (the score is exactly 1), noise finds nothing."""
    options = {"space": _SPACE, "folds": 2, "fixed": {"maxIter": 2}, "parallelism": 2}
    features = [*VECTOR_FEATURES, "planted"]
    planted = plans.random_search(_planted(spark, sf), features, "y", "vec_id", n_trials=3, **options)
    noise = plans.random_search(_noise(vectors(spark, sf), ["a", "b"]), ["a", "b"], "y", "vec_id", n_trials=2, **options)
    return _searched(planted, noise, 3, lambda s: s == 1.0, lambda worst: worst < 0.8)


@check("random_search_regression", _SEARCH_ORACLE.format(trials=3))
def random_search_regression(spark, sf):
    """A continuous label, folds stratified by a class apart from it."""
    options = {"space": _SPACE, "folds": 2, "fixed": {"maxIter": 2}, "parallelism": 2, "task": "regression", "stratify_by": "y"}
    rows = vectors(spark, sf).withColumn("target", F.col("e0") + F.col("y") * 100.0)
    planted = plans.random_search(rows.withColumn("planted", F.col("target")), ["planted", "e1"], "target", "vec_id", n_trials=3, **options)
    noise = plans.random_search(_noise(rows, ["a", "b"]), ["a", "b"], "target", "vec_id", n_trials=2, **options)
    return _searched(planted, noise, 3, lambda s: s > -25.0, lambda worst: worst < -40.0)


@check("random_search_penalties", _SEARCH_ORACLE.format(trials=4))
def random_search_penalties(spark, sf):
    """Linear models over the whole ranges of both penalties."""
    options = {"folds": 3, "learner": "linear", "parallelism": 3}
    planted = plans.random_search(_planted(spark, sf), [*VECTOR_FEATURES, "planted"], "y", "vec_id", n_trials=4, **options)
    noise = plans.random_search(_noise(vectors(spark, sf), ["a", "b"]), ["a", "b"], "y", "vec_id", n_trials=3, **options)
    return _searched(planted, noise, 4, lambda s: s == 1.0, lambda worst: worst < 0.8, plans.PENALTY_SPACE, [])


@check("random_search_penalties_regression", _SEARCH_ORACLE.format(trials=4))
def random_search_penalties_regression(spark, sf):
    """The same for a continuous label: nearly all of its spread is explained, or none."""
    options = {"folds": 3, "learner": "linear", "parallelism": 3, "task": "regression", "stratify_by": "y"}
    rows = vectors(spark, sf).withColumn("target", F.col("e0") + F.col("y") * 100.0)
    planted = plans.random_search(rows.withColumn("planted", F.col("target")), [*VECTOR_FEATURES, "planted"], "target", "vec_id",
                                  n_trials=4, **options)
    noise = plans.random_search(_noise(rows, ["a", "b"]), ["a", "b"], "target", "vec_id", n_trials=3, **options)
    return _searched(planted, noise, 4, lambda s: s > -5.0, lambda worst: worst < -40.0, plans.PENALTY_SPACE, [])


@check("random_search_shipped", """
SELECT CAST(4 AS BIGINT) AS trials, CAST(1 AS BIGINT) AS best, TRUE AS planted_found, TRUE AS noise_clear, TRUE AS whole_space
FROM (SELECT count(*) FROM orders)""")
def random_search_shipped(spark, sf):
    """The ranges as shipped, with trees that stop by the held-out fold."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("customer"),
        (F.col("o_orderstatus") == "F").cast("int").alias("late"))
    options = {"folds": 3, "fixed": {"maxIter": 10}, "parallelism": 3, "stop_early": 0.01, "n_trials": 4}
    planted = plans.random_search(orders.withColumn("planted", F.col("late").cast("double")),
                                  ["o_totalprice", "customer", "planted"], "late", "o_orderkey", **options)
    noise = plans.random_search(orders, ["o_totalprice", "customer"], "late", "o_orderkey", **options)
    return _searched(planted, noise, 4, lambda s: s > 0.999, lambda worst: worst < 0.8)


@check("oof_early_stop", """
SELECT CAST(3 AS BIGINT) AS folds, CAST(3 AS BIGINT) AS stopped, CAST(3 AS BIGINT) AS same_auc FROM (SELECT count(*) FROM embeddings)""")
def oof_early_stop(spark, sf):
    """A label with a tenth of wrong copies: the held-out fold soon gains no more and ends the trees, at the AUC of all of them."""
    wrong = F.when(F.col("vec_id") % 10 == 0, 1 - F.col("y")).otherwise(F.col("y"))
    folded = stage(ops.stratified_folds(vectors(spark, sf).withColumn("copy", wrong), "y", "vec_id", k=3))
    params = {"maxIter": 20, "maxDepth": 2, "stepSize": 0.5}
    stopped = plans.out_of_fold(folded, ["copy"], "y", "fold", "vec_id", params, parallelism=3, stop_early=0.01)
    whole = plans.out_of_fold(folded, ["copy"], "y", "fold", "vec_id", params, parallelism=3)
    fewer = [n < whole.rounds()[fold] == 20 for fold, n in stopped.rounds().items()]
    by_fold = ops.exact_auc(stopped.predictions, "y", "prediction", by="fold").join(
        ops.exact_auc(whole.predictions, "y", "prediction", by="fold").withColumnRenamed("auc", "auc_of_all"), "fold")
    return by_fold.agg(F.count("*").alias("folds"), F.lit(sum(fewer)).cast("bigint").alias("stopped"),
                       F.count_if(F.abs(F.col("auc") - F.col("auc_of_all")) < 1e-12).alias("same_auc"))


@check("boruta_select", """
SELECT * FROM (VALUES ('element', 64, TRUE), ('noise', 1, TRUE), ('planted', 1, TRUE)) t(kind, features, as_expected)
WHERE (SELECT count(*) FROM embeddings) > 0""")
def boruta_select(spark, sf):
    """Enough rounds to confirm among 66 features: a copy of the label is, a hash never."""
    rows = _noise(_planted(spark, sf), ["noise"])
    found = plans.boruta_select(rows, [*VECTOR_FEATURES, "planted", "noise"], "y", "vec_id", max_iter=12, trees=20, depth=4)
    kind = F.when(F.col("feature").isin("planted", "noise"), F.col("feature")).otherwise("element")
    good = (F.when(F.col("feature") == "planted", F.col("status") == "confirmed")
            .when(F.col("feature") == "noise", F.col("status") != "confirmed")
            # An element is judged by its hits: confirmed or rejected only on many or few, and no better than the copy.
            .otherwise(F.col("status").isin("confirmed", "tentative", "rejected") & F.col("hits").between(0, 12)
                       & F.when(F.col("status") == "confirmed", F.col("hits") >= 8).when(F.col("status") == "rejected", F.col("hits") <= 4)
                       .otherwise(F.col("hits").between(1, 11))))
    return found.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).cast("int").alias("features"), F.min(good).alias("as_expected"))


@check("keep_confirmed", f"SELECT vec_id, {r('e3')} AS e3, y FROM ({VECTORS_SQL})")
def keep_confirmed(spark, sf):
    """Only confirmed columns are written and read back."""
    verdicts = spark.createDataFrame([(c, 12, "confirmed" if c == "e3" else "rejected" if i % 2 else "tentative")
                                      for i, c in enumerate(VECTOR_FEATURES)], "feature string, hits int, status string")
    path = f"{staging_root(spark)}/{uuid.uuid4().hex}.parquet"
    plans.keep_confirmed(vectors(spark, sf), verdicts, keep=["vec_id", "y"], path=path)
    return rounded(read_table(spark, path))
