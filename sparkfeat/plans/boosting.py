"""Gradient boosting of counted rows, for tables with few features for their rows.

A tree sees of a feature no more than which of ``maxBins`` bins a row lies in. Rows of one fold and label
that share all their bins are alike to every tree of every trial: they are counted once, into a cell, and trees learn
from the cells with their counts as weights. Few features have few cells, however many rows there are.

The trees are Spark ML's. What boosting does around them (pseudo-residuals, a draw of rows for each tree, fewest rows of
a leaf, the end by the held-out fold) is that of Spark ML's ``GBTClassifier`` and ``GBTRegressor``, by rows and not by cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from contextlib import ExitStack

from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.operators.quantiles import ACCURACY
from sparkfeat.sources.staging import staged

#: Rows are counted from so many of them on (fewer are quicker as they are), if a cell stands for so many of them, and
#: not tried with more features than these.
LEAST_ROWS = 1_000_000
ROWS_A_CELL = 20
MOST_FEATURES = 12
#: What a task draws from in a fraction of a second.
TASK_CELLS, TASK_ROWS = 20_000, 4_000_000
#: Bins of a feature unless ``maxBins`` says otherwise, as in Spark ML.
BINS = 32
#: Parameters of the learner that boosting of cells knows.
KNOWN = frozenset({"maxIter", "maxDepth", "maxLeaves", "stepSize", "minInstancesPerNode", "subsamplingRate",
                   "featureSubsetStrategy", "maxBins", "minInfoGain", "seed"})
_DIGITS = 32
_MOST_SEEN = 100_000


def _edges(flat: DataFrame, names: Sequence[str], bins: int, found) -> list[list[float]]:
    """The values at which the bins of each feature begin, but for the first bin."""
    few = [n for n in names if found[f"distinct_{n}"] <= 2 * bins]
    values = flat.agg(*[F.collect_set(n).alias(n) for n in few]).first().asDict() if few else {}
    edges = []
    for n in names:
        low, ranks = found[f"low_{n}"], found[f"ranks_{n}"]
        if len(values.get(n, ranks)) <= bins and n in values:
            edges.append(sorted(values[n])[1:])
        else:
            # A value that fills several ranks gets a bin of its own.
            after = {math.nextafter(a, math.inf) for a, b in zip([low, *ranks], ranks) if a == b}
            edges.append(sorted({q for q in ranks if q > low} | after))
    return edges


def counted(rows: DataFrame, width: int, bins: int, binary: bool) -> DataFrame | None:
    """Cells (fold, label, bins, count, id) of prepared rows with ``width`` features, or None if rows hardly share cells.

    Also None where the learner itself has to judge the rows: labels other than 0 and 1, infinite values, no rows.
    """
    if not 1 <= width <= MOST_FEATURES or rows.count() < LEAST_ROWS:
        return None
    names, cells = [f"__v{i}" for i in range(width)], vector_to_array("__features")
    # Minus zero is zero.
    flat = rows.select("__label", "__fold", *[F.when(cells[i] == 0, F.lit(0.0)).otherwise(cells[i]).alias(n) for i, n in enumerate(names)])
    probs = [j / bins for j in range(1, bins)]
    found = flat.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("__label").isin(0.0, 1.0)).alias("other"),
        *[part for n in names for part in (
            F.min(n).alias(f"low_{n}"), F.max(n).alias(f"high_{n}"), F.approx_count_distinct(n).alias(f"distinct_{n}"),
            F.percentile_approx(n, probs, ACCURACY).alias(f"ranks_{n}"))]).first()
    if not found["n"] or binary and found["other"] or not all(
            math.isfinite(found[f"{end}_{n}"]) for end in ("low", "high") for n in names):
        return None
    splits = [[-math.inf, *(inner or [found[f"low_{n}"]]), math.inf] for n, inner in zip(names, _edges(flat, names, bins, found))]
    own = [f"__b{i}" for i in range(width)]
    binned = Bucketizer(splitsArray=splits, inputCols=names, outputCols=own).transform(flat)
    # The bucketizer marks bins as classes without order, which trees would take them for.
    binned = binned.withColumns({b: F.col(b).alias(b, metadata={}) for b in own})
    cell = ["__fold", "__label", *own]
    number = binned.agg(F.approx_count_distinct(F.xxhash64(*cell)).alias("n")).first()["n"]
    if number * ROWS_A_CELL > found["n"]:
        return None
    counts = binned.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")).withColumn("__id", F.xxhash64(*cell))
    counts = counts.repartition(1 + max(number // TASK_CELLS, found["n"] // TASK_ROWS), "__id")
    return VectorAssembler(inputCols=own, outputCol="__bins").transform(counts).select("__fold", "__label", "__bins", "__n", "__id")


def kept_of(n: Column, rate: float, *draw: Column) -> Column:
    """How many of ``n`` rows stay if each does with probability ``rate`` by itself; ``draw`` tells draws apart.

    Each row has a random binary fraction and stays if that is below the rate. Row by row is not needed: of
    the rows that agree with the rate so far, those with a one as their next digit are as many as there are
    ones in so many random bits. These agree on, or are past it; where the rate has a one, the others stay.
    """
    if rate >= 1.0:
        return n
    share = format(min(round(rate * 2**_DIGITS), 2**_DIGITS - 1), f"0{_DIGITS}b")

    def digit(state: Column, code: Column) -> Column:
        rest = state["rest"]

        def more(total: Column, word: Column) -> Column:
            left = rest - word * 64
            random = F.xxhash64(*draw, code, word)
            beyond = F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.least(left, F.lit(63)).cast("int"))
            return total + F.bit_count(F.when(left >= 64, random).otherwise(random.bitwiseAND(F.bitwise_not(beyond))))

        ones = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.floor(rest / 64)), F.lit(0), more).cast("bigint")
        return F.struct((state["kept"] + F.when(code % 2 == 1, rest - ones).otherwise(0)).cast("bigint").alias("kept"), ones.alias("rest"))

    codes = F.array(*[F.lit(2 * place + int(bit)) for place, bit in enumerate(share)])
    start = F.struct(F.lit(0).cast("bigint").alias("kept"), n.cast("bigint").alias("rest"))
    return F.aggregate(codes, start, digit)["kept"]


def _loss(binary: bool) -> tuple[Column, Column, Column]:
    """The value to learn first, the error of a row and what is left to learn of it (minus the gradient)."""
    raw = F.col("__raw")
    if not binary:
        return F.col("__label"), (F.col("__label") - raw) * (F.col("__label") - raw), 2 * (F.col("__label") - raw)
    side = 2 * F.col("__label") - 1
    margin = 2 * side * raw
    error = 2 * (F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))))
    return side, error, 4 * side / (1 + F.exp(margin))


def boosted(cells: DataFrame, model, fold: int, binary: bool, stop_early: float | None, files: ExitStack) -> DataFrame:
    """(label, count, score) of the cells of ``fold``, by trees that learned from the other folds.

    ``model`` is the Spark ML learner that holds the parameters. ``files`` keeps the result until it closes.
    """
    rounds, step, rate, seed = model.getMaxIter(), model.getStepSize(), model.getSubsamplingRate(), model.getSeed()
    if not (rounds >= 1 and 0 < step <= 1 and 0 < rate <= 1):
        raise ValueError("maxIter has to be 1 at least, stepSize and subsamplingRate above 0 and 1 at most")
    fewest, held_out = model.getMinInstancesPerNode(), F.col("__fold") == fold
    first, error, gradient = _loss(binary)
    number = cells.count()
    # Enough for Spark ML to look at all cells for the values of the bins.
    shared = {"featuresCol": "__bins", "labelCol": "__target", "weightCol": "__kept", "numTrees": 1, "bootstrap": False,
              "subsamplingRate": 1.0, "maxBins": max(model.getMaxBins(), math.isqrt(min(number, _MOST_SEEN)) + 1),
              "minInfoGain": model.getMinInfoGain(), "featureSubsetStrategy": model.getFeatureSubsetStrategy()}
    opened: dict[int, ExitStack] = {}

    def drawn(frame: DataFrame, target: Column, tree: int) -> DataFrame:
        """The frame with what tree number ``tree`` learns from, written."""
        kept = F.when(held_out, F.lit(0)).otherwise(kept_of(F.col("__n"), rate, F.col("__id"), F.lit(seed), F.lit(tree), F.lit(fold)))
        opened[tree] = ExitStack()
        return opened[tree].enter_context(staged(frame.withColumns({"__target": target, "__kept": kept.cast("double")})))

    def learned(state: DataFrame, rows: float, tree: int) -> DataFrame:
        """The state with one more tree in the raw value."""
        if not rows:
            return state
        # A leaf needs so many rows, whatever number of cells they are; half a row keeps clear of rounding.
        room = rows >= 2 * fewest
        forest = RandomForestRegressor(
            **shared, seed=seed + tree, maxDepth=model.getMaxDepth() if room else 0,
            minWeightFractionPerNode=(fewest - 0.5) / rows if room else 0.0)
        fitted = forest.fit(state.where(F.col("__kept") > 0))
        value = F.col("__raw") + F.col("prediction") * F.lit(step if tree else 1.0)
        return fitted.transform(state).withColumn("__raw", value).drop("prediction")

    try:
        state = drawn(cells.withColumn("__raw", F.lit(0.0)), first, 0)
        rows = state.agg(F.sum("__kept").alias("rows")).first()["rows"]
        best, least = 0, math.inf
        frames = {0: state}
        for tree in range(rounds):
            state = drawn(learned(state, rows, tree), gradient, tree + 1)
            frames[tree + 1] = state
            now = state.agg(F.sum("__kept").alias("rows"), F.try_divide(
                F.sum(F.when(held_out, error * F.col("__n"))), F.sum(F.when(held_out, F.col("__n")))).alias("error")).first()
            rows = now["rows"]
            if stop_early is None or tree == 0:
                best, least = tree + 1, now["error"]
            elif least - now["error"] < stop_early * max(now["error"], 0.01):
                break
            elif now["error"] < least:
                best, least = tree + 1, now["error"]
            for old in [number for number in frames if number not in (best, tree + 1)]:
                opened[old].close()
                del frames[old]
        raw = F.col("__raw")
        score = 1 / (1 + F.exp(-2 * raw)) if binary else raw
        scored = frames[best].where(held_out).select("__label", "__n", score.alias("__score"))
        return files.enter_context(staged(scored))
    finally:
        for stack in opened.values():
            stack.close()
