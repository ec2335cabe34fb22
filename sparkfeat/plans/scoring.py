"""Out-of-fold predictions and seeded hyper-parameter search with Spark ML trees and linear models."""

from __future__ import annotations

import itertools
import json
import math
import random
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass
from functools import reduce
from multiprocessing import TimeoutError as WaitedTooLong
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.functions.nulls import clean, column
from sparkfeat.operators.evaluate import auc_metric, neg_rmse_metric
from sparkfeat.operators.folds import FOLDS, SEED, hashed_folds, stratified_folds
from sparkfeat.plans import boosting
from sparkfeat.sources.staging import stage, staged

# Trees here need a number in every cell; missing ones go far outside the usual range, where
# a split can tell them apart.
MISSING = -1e9

# The searched ranges, and the time limit of a search in seconds.
SEARCH_SPACE = {
    "maxDepth": (2, 14),
    "maxLeaves": (2, 50),
    "stepSize": (0.0, 1.0),
    "minInstancesPerNode": (30, 500),
    "subsamplingRate": (0.0, 1.0),
    "featureSubsetStrategy": (0.0, 1.0),
}
PENALTY_SPACE = {"l1": (0.0, 1.0), "l2": (0.0, 1.0)}
TIME_LIMIT = (60 * 3) * 60
_SMALLEST_SHARE = 0.01

_LEARNERS = {
    ("trees", "binary"): GBTClassifier, ("trees", "regression"): GBTRegressor,
    ("linear", "binary"): LogisticRegression, ("linear", "regression"): LinearRegression,
}


def _prepared(df: DataFrame, features: Sequence[str], label: str, fold_col: str, key: str) -> DataFrame:
    """Key, label, fold and the gap-free features, as a vector, of the labelled rows.

    Written divided by fold, so that training on k - 1 folds and scoring one read only the
    files of those folds. A fit reads its rows several times; the vectors are made once, here.
    """
    cells = [F.coalesce(clean(df, c).cast("double"), F.lit(MISSING)).alias(f"__f{i}")
             for i, c in enumerate(features)]
    rows = df.select(column(key).alias("__key"), column(label).cast("double").alias("__label"),
                     column(fold_col).cast("int").alias("__fold"), *cells)
    assembler = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol="__features")
    return assembler.transform(rows.where(F.col("__label").isNotNull())).select("__key", "__label", "__fold", "__features")


def learner_params(params: Mapping, learner: str = "trees") -> dict:
    """``params`` in the learner's own terms.

    Spark's trees have no limit on leaves, but a tree of depth d has at most 2^d of them:
    ``maxLeaves`` lowers ``maxDepth`` to the least depth that has room for so many. Shares of
    features become text. For linear models ``l1`` and ``l2`` are the weights of the two penalties
    (``l1 * |w| + l2 / 2 * w^2``), which Spark takes as their sum and the share of the first.
    """
    own = dict(params)
    if learner == "linear":
        if "l1" in own or "l2" in own:
            l1, l2 = float(own.pop("l1", 0.0)), float(own.pop("l2", 0.0))
            own |= {"regParam": l1 + l2, "elasticNetParam": l1 / (l1 + l2) if l1 + l2 else 0.0}
        return own
    leaves = own.pop("maxLeaves", None)
    if leaves is not None:
        own["maxDepth"] = min(own.get("maxDepth", 30), max(1, math.ceil(math.log2(leaves))))
    if isinstance(own.get("featureSubsetStrategy"), float):
        own["featureSubsetStrategy"] = f"{own['featureSubsetStrategy']:.6f}"
    return own


def _model(task: str, params: Mapping, seed: int, learner: str):
    if (learner, task) not in _LEARNERS:
        raise ValueError(f"unknown task {task!r} or learner {learner!r}: use 'binary' or 'regression', 'trees' or 'linear'")
    settings = {"featuresCol": "__features", "labelCol": "__label", **learner_params(params, learner)}
    if learner == "trees":
        settings.setdefault("seed", seed)
    return _LEARNERS[learner, task](**settings)


@dataclass
class OutOfFold:
    """Predictions for rows that the model did not learn from, and the model of each fold."""

    predictions: DataFrame
    models: dict

    def rounds(self) -> dict[int, int]:
        """How many trees, or passes of a linear model, each fold took."""
        return {fold: model.getNumTrees if hasattr(model, "getNumTrees") else model.summary.totalIterations
                for fold, model in self.models.items()}


def _fit_folds(rows: DataFrame, params: Mapping, task: str, seed: int, parallelism: int,
               learner: str = "trees", stop_early: float | None = None) -> OutOfFold:
    if stop_early is not None and learner != "trees":
        raise ValueError("only trees stop by a held-out fold")
    fold_numbers = sorted(row["__fold"] for row in rows.select("__fold").distinct().collect())

    def fitted(fold: int):
        model = _model(task, params, seed, learner)
        held_out = F.col("__fold") == fold
        if stop_early is None:
            return model.fit(rows.where(~held_out))
        model.setParams(validationIndicatorCol="__held_out", validationTol=stop_early)
        return model.fit(rows.withColumn("__held_out", held_out))

    # Only the submission of Spark jobs is threaded, as in Spark ML's own cross-validation.
    with ThreadPool(max(1, min(parallelism, len(fold_numbers)))) as pool:
        models = pool.map(inheritable_thread_target(rows.sparkSession)(fitted), fold_numbers)

    score = vector_to_array("probability")[1] if task == "binary" else F.col("prediction")
    scored = [
        # Without the raw column the probability comes straight from the features.
        model.transform(rows.where(F.col("__fold") == fold), {model.rawPredictionCol: ""} if task == "binary" else {})
        .select("__key", "__label", "__fold", score.alias("__score"))
        for fold, model in zip(fold_numbers, models)
    ]
    return OutOfFold(reduce(DataFrame.unionByName, scored), dict(zip(fold_numbers, models)))


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, fold_col: str, key: str,
                params: Mapping | None = None, task: str = "binary", seed: int = SEED,
                parallelism: int = 1, learner: str = "trees", stop_early: float | None = None) -> OutOfFold:
    """One prediction per labelled row, from a model that never learned from the row's fold, and the models.

    ``learner`` is ``"trees"`` (gradient boosting) or ``"linear"`` (with the ``l1`` and ``l2``
    penalties of :func:`learner_params`). With ``stop_early`` the trees of a fold end when the error on
    the held-out fold gains less than that tolerance, and as many as were best there are kept;
    ``maxIter`` is the most. The held-out fold then had a say in their number, as is usual in
    searches; keep a test set apart for an unbiased score.
    """
    rows = stage(_prepared(df, features, label, fold_col, key), partition_by=["__fold"])
    found = _fit_folds(rows, params or {}, task, seed, parallelism, learner, stop_early)
    named = found.predictions.select(F.col("__key").alias(key), F.col("__label").alias(label),
                                     F.col("__fold").alias(fold_col), F.col("__score").alias("prediction"))
    return OutOfFold(named, found.models)


def oof_predictions(df: DataFrame, features: Sequence[str], label: str, fold_col: str, key: str,
                    params: Mapping | None = None, task: str = "binary", seed: int = SEED,
                    parallelism: int = 1, learner: str = "trees", stop_early: float | None = None) -> DataFrame:
    """The predictions of :func:`out_of_fold`.

    Output: key, label, fold and ``prediction`` (the probability of label 1, or the value).
    ``parallelism`` is the number of folds trained at the same time, each of which caches its
    own training rows.
    """
    return out_of_fold(df, features, label, fold_col, key, params, task, seed, parallelism, learner, stop_early).predictions


def draw(space: Mapping[str, tuple], generator: random.Random) -> dict:
    """One random point of the space: integers for integer bounds, shares kept above zero."""
    point = {}
    for name, (low, high) in space.items():
        if isinstance(low, int) and isinstance(high, int):
            point[name] = generator.randint(low, high)
        else:
            point[name] = min(max(generator.uniform(low, high), _SMALLEST_SHARE), float(high))
    return point


def _within(spark: SparkSession, seconds: float, work: Callable[[], object]) -> tuple[bool, object]:
    """Whether ``work`` ended in time, and its result. Else the Spark jobs it runs, and those it still starts, are cancelled."""
    tag, context = f"trial-{uuid.uuid4().hex}", spark.sparkContext

    def tagged():
        # A tag of the session would miss the jobs of Spark ML, which are not queries.
        context.addJobTag(tag)
        try:
            return work()
        finally:
            context.removeJobTag(tag)

    with ThreadPool(1) as pool:
        running = pool.apply_async(inheritable_thread_target(spark)(tagged))
        try:
            return True, running.get(max(seconds, 0.0))
        except WaitedTooLong:
            while not running.ready():
                context.cancelJobsWithTag(tag)
                running.wait(0.2)
            return False, None


@contextmanager
def _cells(rows: DataFrame, features: Sequence[str], names: set, bins: int | None, task: str) -> Iterator[DataFrame | None]:
    """Rows counted by their bins, written, if boosting of cells knows all parameters and rows share cells; else None."""
    cells = None
    if bins and names <= boosting.KNOWN:
        cells = boosting.counted(rows, len(features), bins, task == "binary")
    if cells is None:
        yield None
        return
    with staged(cells) as written:
        yield written


def _score_cells(cells: DataFrame, params: Mapping, task: str, seed: int, parallelism: int, stop_early: float | None) -> float:
    """The score of a trial whose folds are boosted from cells: that of its rows, as rows of a cell are alike."""
    fold_numbers = sorted(row["__fold"] for row in cells.select("__fold").distinct().collect())
    with ExitStack() as files:

        def fitted(fold: int):
            return boosting.boosted(cells, _model(task, params, seed, "trees"), fold, task == "binary", stop_early, files)

        with ThreadPool(max(1, min(parallelism, len(fold_numbers)))) as pool:
            scored = pool.map(inheritable_thread_target(cells.sparkSession)(fitted), fold_numbers)
        measure = auc_metric if task == "binary" else neg_rmse_metric
        return measure(reduce(DataFrame.unionByName, scored), "__label", "__score", "__n")


def random_search(df: DataFrame, features: Sequence[str], label: str, key: str,
                  fold_col: str | None = None, space: Mapping[str, tuple] | None = None,
                  n_trials: int | None = None, timeout: float = TIME_LIMIT, task: str = "binary",
                  metric: Callable[[DataFrame], float] | None = None, maximize: bool = True,
                  folds: int = FOLDS, seed: int = SEED, fixed: Mapping | None = None,
                  parallelism: int = 1, stratify_by: str | None = None, learner: str = "trees",
                  stop_early: float | None = None, end_running: bool = False) -> DataFrame:
    """Seeded draws from ``space``, each scored once on its out-of-fold predictions.

    Output: one row per finished trial (trial, params as JSON, score, is_best). The score is
    the exact AUC, or minus the RMSE for a regression, unless ``metric`` gives another
    function of the frame (key, label, prediction). No trial starts after ``timeout`` seconds;
    with ``end_running`` the one that runs then is ended as well, its Spark jobs cancelled, and does not
    count. ``n_trials`` bounds their number as well. Without ``fold_col`` the folds are stratified by
    ``stratify_by``, which may be a class apart from a continuous label; without that by the label of
    a binary task, and for a regression they are plain hash folds. ``learner`` and
    ``stop_early`` are those of :func:`out_of_fold`; the space is that of the learner unless another is given.

    Trees learn from rows counted by their bins where a count stands for many rows (see ``boosting``), and
    from the rows themselves where it does not, where ``metric`` needs a row for each key and where ``maxBins`` is searched.
    """
    if space is None:
        space = SEARCH_SPACE if learner == "trees" else PENALTY_SPACE
    if fold_col is None:
        fold_col = "fold"
        strata = stratify_by or (label if task == "binary" else None)
        labelled = df.where(column(label).isNotNull())
        df = (hashed_folds(labelled, key, folds, seed, fold_col) if strata is None
              else stratified_folds(labelled, strata, key, folds, seed, fold_col))
    score_of = metric or (auc_metric if task == "binary" else neg_rmse_metric)
    generator = random.Random(seed)
    started, trials = time.monotonic(), []
    names = {*space, *(fixed or {})}
    by_bins = learner == "trees" and metric is None and "maxBins" not in space
    bins = (fixed or {}).get("maxBins", boosting.BINS) if by_bins else None
    with (staged(_prepared(df, features, label, fold_col, key), partition_by=["__fold"]) as rows,
          _cells(rows, features, names, bins, task) as cells):

        def trial(params: dict):
            if cells is not None:
                return _score_cells(cells, params, task, seed, parallelism, stop_early)
            scored = _fit_folds(rows, params, task, seed, parallelism, learner, stop_early).predictions
            return score_of(scored.select(F.col("__key").alias("key"), F.col("__label").alias("label"),
                                          F.col("__score").alias("prediction")))

        for number in itertools.count() if n_trials is None else range(n_trials):
            if number and time.monotonic() - started > timeout:
                break
            params = {**(fixed or {}), **draw(space, generator)}
            if end_running:
                left = timeout - (time.monotonic() - started)
                in_time, score = _within(df.sparkSession, left, lambda: trial(params))
                if not in_time:
                    break
            else:
                score = trial(params)
            trials.append((number, json.dumps(params, sort_keys=True), score))
    known = [score for _, _, score in trials if score is not None]
    best = (max(known) if maximize else min(known)) if known else None
    first_best = next((n for n, _, s in trials if s is not None and s == best), None)
    return df.sparkSession.createDataFrame(
        [(n, p, s, n == first_best) for n, p, s in trials],
        "trial int, params string, score double, is_best boolean")
