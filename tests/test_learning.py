"""Resampling, evaluation, folds and model-driven jobs."""

import itertools
import json
from contextlib import ExitStack

import pytest
from pyspark.sql import functions as F

from helpers import plan, rows, same
from sparkfeat import operators as ops
from sparkfeat import plans
from sparkfeat.plans import boosting, scoring, selection
from sparkfeat.sources import stage


@pytest.fixture(scope="module")
def cells(spark):
    return spark.range(300).select(
        F.col("id").alias("key"), (F.col("id") * 2).alias("a"), (F.col("id") / 7).alias("b"),
        F.concat(F.lit("t"), F.col("id")).alias("c"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("holes"),
        (F.col("id") % 3 == 0).cast("int").alias("y"))


def test_shuffle_keeps_marginals_and_breaks_rows(cells):
    out = ops.shuffle_columns(cells, ["a", "b", "c", "holes"], "key", copies=2).cache()
    assert [f.dataType for f in out.drop("copy", "row").schema] == [cells.schema[c].dataType for c in ("a", "b", "c", "holes")]
    for copy in (1, 2):
        part = out.where(F.col("copy") == copy)
        assert [r[0] for r in rows(part.select("row"), "row")] == list(range(1, 301))
        for c in ("a", "b", "c", "holes"):
            assert sorted(map(str, (r[0] for r in part.select(c).collect()))) == sorted(
                map(str, (r[0] for r in cells.select(c).collect())))
        assert part.where(F.col("a") == F.col("b") * 14).count() < 20
    first, second = (rows(out.where(F.col("copy") == i).drop("copy"), "row") for i in (1, 2))
    assert first != second


def test_shuffle_depends_on_the_seed_only(cells):
    base = rows(ops.shuffle_columns(cells, ["a", "c"], "key", seed=1), "row")
    assert rows(ops.shuffle_columns(cells.repartition(7), ["a", "c"], "key", seed=1, buckets=3), "row") == base
    assert rows(ops.shuffle_columns(cells, ["a", "c"], "key", seed=2), "row") != base


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutations_are_bijections(spark, n):
    from sparkfeat.operators.augment import permuted

    numbers = spark.range(n).select("id", F.lit(n).cast("bigint").alias("size")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6))))
    found = {}
    for r in permuted(numbers, "id", "size", "7, k", "to").collect():
        found.setdefault(r["k"], []).append((r["id"], r["to"]))
    maps = [tuple(to for _, to in sorted(pairs)) for pairs in found.values()]
    assert all(sorted(m) == list(range(n)) for m in maps)
    if n >= 16:
        assert len(set(maps)) == 6 and all(sum(a == b for a, b in enumerate(m)) < 8 for m in maps)


def test_shuffle_moves_each_cell_once_by_itself(cells):
    """Whole rows to be numbered, then cells into their rows; counting the hash ranges takes two small ones."""
    tree = plan(ops.shuffle_columns(cells, ["a", "b"], "key")).split("\n\n")[0]
    assert tree.count("Exchange") - tree.count("BroadcastExchange") - 2 == 2


def test_shadows_travel_with_real_rows(cells):
    out = ops.with_shadows(cells, ["a", "c"], "key", keep=["y"])
    assert out.columns == ["key", "y", "a", "c", "shadow_a", "shadow_c"]
    assert rows(out.select("key", "y", "a", "c"), "key") == rows(cells.select("key", "y", "a", "c"), "key")
    assert sorted(r[0] for r in out.select("shadow_a").collect()) == sorted(r[0] for r in cells.select("a").collect())
    assert out.where("a = shadow_a").count() < 20


@pytest.mark.parametrize("times, positives, negatives", [(1, 100, 0), (2, 200, 200), (5, 500, 400)])
def test_augment_counts(spark, cells, times, positives, negatives):
    odd = spark.createDataFrame([(1000, 1, 1.0, -1), (1001, 1, 1.0, None)], "key long, a long, b double, y int")
    source = cells.select("key", "a", "b", "y").unionByName(odd)
    out = ops.augment(source, ["a", "b"], "y", "key", times=times)
    counts = {r["y"]: r["n"] for r in out.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 100 + positives, 0: 200 + negatives, -1: 1, None: 1}
    added = out.where("key IS NULL")
    # New positives only hold values of positives.
    assert added.where("y = 1 AND a % 6 <> 0").count() == 0
    assert out.schema["y"].dataType == source.schema["y"].dataType


def brute_auc(pairs):
    pos = [s for y, s in pairs if y > 0]
    neg = [s for y, s in pairs if y <= 0]
    wins = sum((p > q) + 0.5 * (p == q) for p, q in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("options", [{}, {"group_limit": 1, "slices": 4}])
def test_auc_matches_all_pairs(spark, options):
    df = spark.range(400).select((F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("y"),
                                 F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)).cast("double").alias("s"),
                                 (F.col("id") % 2).alias("g"))
    pairs = [(r["y"], r["s"], r["g"]) for r in df.collect()]
    assert same(ops.exact_auc(df, "y", "s", **options).first()["auc"], brute_auc([p[:2] for p in pairs]))
    for g, auc in rows(ops.exact_auc(df, "y", "s", by="g", **options)):
        assert same(auc, brute_auc([p[:2] for p in pairs if p[2] == g]))


def test_auc_edge_cases(spark):
    df = spark.createDataFrame([(1, 0.5), (1, None), (None, 0.1)], "y int, s double")
    assert ops.exact_auc(df, "y", "s").first()["auc"] is None
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double")
    assert ops.exact_auc(ties, "y", "s").first()["auc"] == 0.5


def test_neg_rmse_and_metric_row(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 2.0), (None, 1.0)], "y double, p double")
    value = ops.neg_rmse(df, "y", "p")
    assert same(value.first()[0], -(4.5 ** 0.5))
    assert rows(ops.metric_row(value, "rmse")) == [("rmse", value.first()[0], True)]


@pytest.mark.parametrize("k", [2, 5])
def test_folds_are_balanced_and_stable(spark, k):
    df = spark.range(1003).select(F.col("id").alias("key"), F.when(F.col("id") % 10 < 7, "big").when(
        F.col("id") % 10 < 9, "small").alias("label"), F.lit("x" * 10).alias("payload"))
    folded = ops.stratified_folds(df, "label", "key", k=k)
    counts = {}
    for label, fold, n in rows(folded.groupBy("label", "fold").count()):
        counts.setdefault(label, {})[fold] = n
    for sizes in counts.values():
        assert sorted(sizes) == list(range(k)) and max(sizes.values()) - min(sizes.values()) <= 1
    again = ops.stratified_folds(df.repartition(7), "label", "key", k=k, buckets=3)
    assert rows(again.select("key", "fold"), "key") == rows(folded.select("key", "fold"), "key")
    assert folded.count() == 1003
    other = ops.stratified_folds(df, "label", "key", k=k, seed=1)
    assert rows(other.select("key", "fold"), "key") != rows(folded.select("key", "fold"), "key")


def test_folds_do_not_shuffle_the_table(spark):
    df = spark.range(100).select(F.col("id").alias("key"), (F.col("id") % 2).alias("label"))
    text = plan(ops.stratified_folds(df, "label", "key")).split("\n\n")[0]
    assert text.count("Exchange") == text.count("BroadcastExchange")


def test_tiny_labels_get_folds(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "two")], "key int, label string")
    assert ops.stratified_folds(df, "label", "key", k=5).count() == 3


def test_hashed_folds(cells):
    sizes = [r[1] for r in rows(ops.hashed_folds(cells, "key", k=3).groupBy("fold").count())]
    assert len(sizes) == 3 and sum(sizes) == 300 and min(sizes) > 60


@pytest.fixture(scope="module")
def planted(spark):
    noise = [(F.xxhash64("id", F.lit(i)) / F.lit(1e18)).alias(f"n{i}") for i in range(4)]
    return spark.range(240).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("y"), *noise,
                                   (F.col("id") % 2).cast("double").alias("copy"))


def test_oof_scores_every_labelled_row_once(planted):
    folded = ops.stratified_folds(planted, "y", "key", k=2)
    out = plans.oof_predictions(folded, ["n0", "copy"], "y", "fold", "key", {"maxIter": 2, "maxDepth": 2}).cache()
    assert out.count() == out.select("key").distinct().count() == 240
    assert ops.exact_auc(out, "y", "prediction").first()["auc"] == 1.0


def test_oof_regression(planted):
    folded = ops.stratified_folds(planted, "y", "key", k=2)
    out = plans.oof_predictions(folded, ["copy"], "y", "fold", "key", {"maxIter": 1, "maxDepth": 1}, "regression")
    assert ops.neg_rmse(out, "y", "prediction").first()[0] == 0.0


@pytest.mark.parametrize("learner, params", [("trees", {"maxIter": 1, "maxDepth": 1}), ("linear", {})])
def test_fits_read_stored_vectors(planted, monkeypatch, learner, params):
    """A fit reads its rows several times: they are stored as vectors, not assembled by a function at each reading."""
    kind, seen = scoring._LEARNERS[learner, "binary"], []
    fit = kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, df, *more: (seen.append(plan(df)), fit(self, df, *more))[1])
    folded = ops.stratified_folds(planted, "y", "key", k=2)
    stop = {"stop_early": 0.01} if learner == "trees" else {}
    found = plans.out_of_fold(folded, ["n0", "copy"], "y", "fold", "key", params, learner=learner, **stop)
    assert len(seen) == 2 and not any("UDF" in text for text in seen)
    scored = plan(found.predictions)
    assert scored.count("UDF") and "rawPrediction" not in scored
    assert found.models[0].getRawPredictionCol() == "rawPrediction"
    assert ops.exact_auc(found.predictions, "y", "prediction").first()["auc"] == 1.0


def test_search_is_reproducible(planted):
    space = {"maxDepth": (1, 2), "stepSize": (0.1, 1.0)}
    args = dict(space=space, n_trials=2, folds=2, fixed={"maxIter": 1})
    found = rows(plans.random_search(planted, ["n0", "copy"], "y", "key", **args), "trial")
    assert len(found) == 2 and sum(r[3] for r in found) == 1
    assert set(json.loads(found[0][1])) == {"maxDepth", "stepSize", "maxIter"}
    assert rows(plans.random_search(planted, ["n0", "copy"], "y", "key", **args), "trial") == found


def test_search_stops_at_the_time_limit_and_takes_a_metric(planted):
    found = plans.random_search(planted, ["n0"], "y", "key", space={"maxDepth": (1, 1)}, n_trials=5, timeout=0,
                                folds=2, fixed={"maxIter": 1}, metric=lambda df: float(df.count()), maximize=False)
    assert [r[2] for r in rows(found)] == [240.0]


def test_draws_stay_inside_the_space():
    import random
    generator = random.Random(3)
    for _ in range(50):
        point = scoring.draw(scoring.SEARCH_SPACE, generator)
        assert 2 <= point["maxDepth"] <= 14 and 30 <= point["minInstancesPerNode"] <= 500
        assert 0 < point["stepSize"] <= 1 and 0 < point["subsamplingRate"] <= 1


def test_binomial_decisions():
    assert selection.upper_tail(0, 5) == 1.0 and selection.upper_tail(5, 5) == 1 / 32
    assert selection.decide(8, 8, 9, 0.05) == "confirmed" and selection.decide(7, 7, 9, 0.05) == "tentative"
    assert selection.decide(0, 8, 9, 0.05) == "rejected"


def test_loops_leave_no_files(spark, planted):
    from pathlib import Path

    from sparkfeat.sources import staging_root
    root = Path(staging_root(spark).removeprefix("file:"))
    plans.random_search(planted.withColumn("fold", F.col("key") % 2), ["n0"], "y", "key", "fold", space={"maxDepth": (1, 1)},
                        n_trials=1, fixed={"maxIter": 1}, metric=lambda df: float(df.count()))
    before = len(list(root.iterdir()))
    plans.random_search(planted.withColumn("fold", F.col("key") % 2), ["n0"], "y", "key", "fold", space={"maxDepth": (1, 1)},
                        n_trials=1, fixed={"maxIter": 1}, metric=lambda df: float(df.count()))
    plans.boruta_select(planted, ["n0", "copy"], "y", "key", max_iter=1, trees=2, depth=2)
    ops.exact_quantiles(planted, ["n0"], [0.5])
    assert len(list(root.iterdir())) == before


def test_boruta_confirms_the_planted_feature(planted, tmp_path):
    found = plans.boruta_select(planted, ["n0", "n1", "n2", "copy"], "y", "key", max_iter=8, trees=10, depth=3)
    verdicts = {r["feature"]: r["status"] for r in found.collect()}
    assert verdicts["copy"] == "confirmed" and len(verdicts) == 4
    kept = plans.keep_confirmed(planted, found, keep=["key", "y"], path=str(tmp_path / "kept"))
    assert "copy" in kept.columns and (tmp_path / "kept").exists()


@pytest.mark.parametrize("k", [1, 2, 5])
def test_folds_by_range_equal_folds_by_label(spark, k):
    df = spark.range(900).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 50 != 1, F.concat(F.lit("l"), F.col("id") % 120)).alias("label"))
    by_label = rows(ops.stratified_folds(df, "label", "key", k=k, small=True), "key")
    by_range = ops.stratified_folds(df, "label", "key", k=k, small=False, buckets=16)
    assert rows(by_range, "key") == by_label
    tree = plan(by_range).split("AdaptiveSparkPlan", 1)[-1]
    # The rows themselves move by label and range; by label alone only the counts of ranges do.
    exchanges = [line for line in tree.splitlines() if "hashpartitioning(" in line and "(label#" in line]
    assert exchanges and all("__range" in line for line in exchanges)


def test_learner_params():
    assert scoring.learner_params({"maxDepth": 9, "maxLeaves": 50, "featureSubsetStrategy": 0.5}) == {
        "maxDepth": 6, "featureSubsetStrategy": "0.500000"}
    assert scoring.learner_params({"maxDepth": 3, "maxLeaves": 50})["maxDepth"] == 3
    assert scoring.learner_params({"maxLeaves": 2})["maxDepth"] == 1
    assert scoring.learner_params({"l1": 0.25, "l2": 0.75}, "linear") == {"regParam": 1.0, "elasticNetParam": 0.25}
    assert scoring.learner_params({"l1": 0.0, "l2": 0.0}, "linear") == {"regParam": 0.0, "elasticNetParam": 0.0}


def test_penalties_shrink_weights(spark):
    df = spark.range(300).select(
        F.col("id").alias("key"), (F.col("id") % 3).alias("fold"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c")
    ).withColumn("y", 3 * F.col("a") + 0.2 * F.col("b")).cache()

    def weights(**penalties):
        found = plans.out_of_fold(df, ["a", "b", "c"], "y", "fold", "key", penalties, "regression", learner="linear")
        return found.models[0].coefficients.toArray(), found
    free, none = weights(), weights(l1=0.0, l2=0.0)[0]
    assert list(free[0]) == pytest.approx(list(none)) and free[0][0] == pytest.approx(3, abs=1e-3)
    assert min(free[1].rounds().values()) >= 0
    sparse, small = weights(l1=0.3)[0], weights(l2=1.0)[0]
    assert sparse[1] == sparse[2] == 0 < sparse[0] < 3
    assert 0 < small[0] < 2.5 and small[1] != 0
    with pytest.raises(ValueError):
        plans.out_of_fold(df, ["a"], "y", "fold", "key", learner="forest")
    with pytest.raises(ValueError):
        plans.out_of_fold(df, ["a"], "y", "fold", "key", learner="linear", stop_early=0.1)


def test_early_stop_takes_fewer_trees(spark):
    df = spark.range(400).select(F.col("id").alias("key"), (F.col("id") % 2).alias("fold"), F.rand(4).alias("noise"),
                                 F.pmod(F.xxhash64("id"), F.lit(2)).alias("y"))
    found = plans.out_of_fold(df, ["noise"], "y", "fold", "key", {"maxIter": 8, "maxDepth": 4}, stop_early=0.0)
    assert set(found.rounds()) == {0, 1} and max(found.rounds().values()) < 8
    assert found.predictions.count() == 400


def test_time_limit_ends_the_running_trial(spark):
    """A trial of a thousand trees is cancelled; the session goes on."""
    import time

    df = spark.range(200).select(F.col("id").alias("key"), (F.col("id") % 2).alias("y"), F.rand(1).alias("a"))
    started = time.monotonic()
    none = plans.random_search(df, ["a"], "y", "key", space={"maxDepth": (4, 5)}, fixed={"maxIter": 5000}, folds=2,
                               timeout=6.0, end_running=True)
    assert none.count() == 0 and time.monotonic() - started < 60
    done = plans.random_search(df, ["a"], "y", "key", space={"maxDepth": (1, 2)}, fixed={"maxIter": 1}, folds=2, n_trials=1,
                               timeout=600.0, end_running=True)
    assert [r["is_best"] for r in done.collect()] == [True]
    with pytest.raises(Exception):
        plans.random_search(df, ["a"], "y", "key", space={"maxDepth": (1, 2)}, fixed={"maxIter": -1}, n_trials=1, end_running=True)


@pytest.mark.parametrize("n", [0, 1, 3, 63, 64, 65, 127, 1000])
def test_rows_kept_of_a_cell_are_as_of_single_draws(spark, n):
    draws = spark.range(20000)
    for rate in (0.01, 0.5, 0.77):
        found = draws.select(boosting.kept_of(F.lit(n), rate, F.col("id"), F.lit(7)).alias("k")).agg(
            F.avg("k"), F.var_samp("k"), F.min("k"), F.max("k")).first()
        spread = n * rate * (1 - rate)
        assert abs(found[0] - n * rate) <= 5 * (spread / 20000) ** 0.5 and found[1] == pytest.approx(spread, rel=0.15)
        assert 0 <= found[2] <= found[3] <= n
    assert draws.select(boosting.kept_of(F.lit(n), 1.0, F.col("id")).alias("k")).distinct().collect()[0][0] == n


@pytest.fixture(scope="module")
def repeated(spark):
    """Rows of few different values, so that many share all their bins."""
    def below(i, n):
        return F.pmod(F.xxhash64("key", F.lit(i)), F.lit(n))

    df = spark.range(0, 3000, 1, 1).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("fold")).select(
        "key", "fold", below(1, 9).cast("double").alias("a"), (below(2, 7) * 1.7 - 3).alias("b"), below(3, 1000).alias("z"))
    return df.withColumns({"y": (F.col("a") * F.col("b") + F.col("z") / 60 > 5).cast("int"),
                           "t": F.round(F.col("a") * F.col("b") / 4 + F.col("z") / 900)}).cache()


@pytest.fixture
def cells_wanted(monkeypatch):
    monkeypatch.setattr(boosting, "LEAST_ROWS", 0)
    monkeypatch.setattr(boosting, "ROWS_A_CELL", 2)


@pytest.mark.parametrize("task, label, stop, params", [
    ("binary", "y", 0.03, {"maxIter": 6, "maxDepth": 3, "stepSize": 0.8, "minInstancesPerNode": 70}),
    ("binary", "y", None, {"maxIter": 2, "minInstancesPerNode": 800}),
    ("regression", "t", 0.02, {"maxIter": 4, "maxDepth": 2, "stepSize": 0.7, "minInstancesPerNode": 40, "minInfoGain": 0.01})])
def test_boosting_of_cells_equals_that_of_rows(repeated, cells_wanted, task, label, stop, params):
    """Nothing is drawn here, so that the scores have to be those of Spark ML's boosting, row for row."""
    out = plans.out_of_fold(repeated, ["a", "b"], label, "fold", "key", params, task, parallelism=2, stop_early=stop)
    prepared = stage(scoring._prepared(repeated, ["a", "b"], label, "fold", "key"))
    found = stage(boosting.counted(prepared, 2, 32, task == "binary"))
    assert found.agg(F.sum("__n")).first()[0] == 3000 > 4 * found.count()
    for fold in (0, 1):
        with ExitStack() as files:
            scored = boosting.boosted(found, scoring._model(task, params, scoring.SEED, "trees"), fold, task == "binary", stop, files)
            by_cell = sorted((r["__label"], r["__score"]) for r in scored.collect() for _ in range(r["__n"]))
        by_row = sorted((float(r[0]), r[1]) for r in out.predictions.where(F.col("fold") == fold).select(label, "prediction").collect())
        assert [p[0] for p in by_cell] == [p[0] for p in by_row]
        assert [p[1] for p in by_cell] == pytest.approx([p[1] for p in by_row], abs=1e-9)


def _no_fit(self, df, *more):
    raise AssertionError("learned from rows")


def test_search_learns_from_cells(spark, repeated, cells_wanted, monkeypatch):
    """With few features a search reads its rows to count them, not for each level of each tree; the seed alone decides."""
    from pathlib import Path

    from sparkfeat.sources import staging_root
    args = dict(folds=2, fixed={"maxIter": 2}, n_trials=1, parallelism=2, stop_early=0.01,
                space={"maxDepth": (2, 3), "maxLeaves": (4, 8), "stepSize": (0.3, 1.0), "minInstancesPerNode": (30, 60),
                       "subsamplingRate": (0.4, 0.9), "featureSubsetStrategy": (0.6, 1.0)})
    by_rows = plans.random_search(repeated, ["a", "b"], "y", "key", metric=scoring.auc_metric, **args).collect()
    root = Path(staging_root(spark).removeprefix("file:"))
    monkeypatch.setattr(scoring._LEARNERS["trees", "binary"], "fit", _no_fit)
    found = rows(plans.random_search(repeated, ["a", "b"], "y", "key", fold_col="fold", **args), "trial")
    before = len(list(root.iterdir()))
    assert rows(plans.random_search(repeated.repartition(5), ["a", "b"], "y", "key", fold_col="fold", **args), "trial") == found
    assert len(list(root.iterdir())) == before
    assert [r[1] for r in found] == [r["params"] for r in by_rows]
    assert all(abs(r[2] - other["score"]) < 0.05 for r, other in zip(found, by_rows)) and min(r[2] for r in found) > 0.8
    planted = repeated.withColumn("copy", F.col("y").cast("double"))
    assert max(r[2] for r in rows(plans.random_search(planted, ["a", "copy"], "y", "key", fold_col="fold", **args))) == 1.0
    values = plans.random_search(repeated, ["a", "b"], "t", "key", fold_col="fold", task="regression", **args).collect()
    assert all(-0.9 * repeated.agg(F.stddev("t")).first()[0] < r["score"] < 0 for r in values)


def test_search_learns_from_rows_where_cells_do_not_serve(repeated, cells_wanted, monkeypatch):
    """Hardly shared cells, searched bins, a metric by key, parameters that cells do not know and labels out of range."""
    monkeypatch.setattr(scoring._LEARNERS["trees", "binary"], "fit", _no_fit)
    args = dict(space={"maxDepth": (1, 2)}, folds=2, fixed={"maxIter": 1}, n_trials=1)
    spread = repeated.withColumn("own", F.col("key") * 1.0).withColumn("other", F.xxhash64("key") * 1.0)
    for features, label, more in [
            (["own", "other"], "y", {}), (["a"], "y", {"metric": lambda df: 1.0}), (["a"], "t", {}),
            (["a"], "y", {"space": {"maxBins": (9, 32)}}), (["a"], "y", {"fixed": {"lossType": "logistic"}})]:
        with pytest.raises(AssertionError, match="learned from rows"):
            plans.random_search(spread, features, label, "key", "fold", **{**args, **more})
    with pytest.raises(ValueError):
        plans.random_search(repeated, ["a"], "y", "key", "fold", **{**args, "fixed": {"maxIter": -1}})


def test_bins_hold_each_of_few_values_and_heavy_ones_apart(spark, cells_wanted):
    df = spark.range(4000).select(
        F.col("id").alias("key"), F.lit(0).alias("fold"), (F.col("id") % 2).alias("y"), F.lit(5.0).alias("same"),
        F.when(F.col("id") == 7, -2.5).otherwise(F.when(F.col("id") % 3 == 0, -0.0).otherwise(0.0)).alias("few"),
        F.when(F.col("id") % 5 < 2, 0.0).otherwise((F.col("id") - 2000) / 7).alias("heavy"))
    found = {}
    for c in ("same", "few", "heavy"):
        cells = boosting.counted(scoring._prepared(df, [c], "y", "fold", "key"), 1, 32, True)
        found[c] = sorted(r[0] for r in cells.groupBy("__bins").agg(F.sum("__n")).select("sum(__n)").collect())
    assert found["same"] == [4000] and found["few"] == [1, 3999]
    assert found["heavy"][-1] == 1600 and 18 <= len(found["heavy"]) <= 32 and max(found["heavy"][:-1]) < 200
    infinite = df.withColumn("few", F.lit(float("inf")))
    assert boosting.counted(scoring._prepared(infinite, ["few"], "y", "fold", "key"), 1, 32, True) is None


def test_metrics_of_counted_rows(spark):
    df = spark.range(60).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 7).cast("double").alias("prediction"),
                                (F.col("id") % 4).alias("n"))
    single = df.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).where("n > 0 AND one <= n")
    for metric in (scoring.auc_metric, scoring.neg_rmse_metric):
        assert same(metric(df, count="n"), metric(single))
