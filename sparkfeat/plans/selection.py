"""All-relevant feature selection against shuffled shadow features.

Follows Kursa and Rudnicki, "Feature Selection with the Boruta Package", Journal of
Statistical Software 36(11), 2010.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.nulls import clean, column
from sparkfeat.operators.augment import with_shadows
from sparkfeat.operators.project import select_supported
from sparkfeat.plans.scoring import MISSING
from sparkfeat.sources.staging import staged
from sparkfeat.sources.tables import write_table

CONFIRMED, TENTATIVE, REJECTED = "confirmed", "tentative", "rejected"
_FEWEST_SHADOWS = 5


def upper_tail(hits: int, runs: int) -> float:
    """Probability of at least ``hits`` heads in ``runs`` fair throws."""
    return sum(comb(runs, i) for i in range(hits, runs + 1)) / 2**runs


def decide(hits: int, runs: int, tests: int, alpha: float) -> str:
    """Verdict on one feature, corrected for the number of features tested."""
    if upper_tail(hits, runs) * tests <= alpha:
        return CONFIRMED
    if upper_tail(runs - hits, runs) * tests <= alpha:
        return REJECTED
    return TENTATIVE


def _importances(rows: DataFrame, inputs: Sequence[str], task: str, trees: int, depth: int,
                 seed: int) -> dict[str, float]:
    forest = RandomForestClassifier if task == "binary" else RandomForestRegressor
    model = forest(featuresCol="__features", labelCol="__label", numTrees=trees, maxDepth=depth, seed=seed)
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="__features")
    fitted = model.fit(assembler.transform(rows))
    return dict(zip(inputs, fitted.featureImportances.toArray()))


def _shadowed(rows: DataFrame, real: Sequence[str], copies: int, seed: int) -> tuple[DataFrame, list[str]]:
    """The real columns and shuffled shadows, ``copies`` permutations from one pass; the shadows' names."""
    # A very short list gets further shadows so that the best of them means something.
    shadowed = (list(real) * _FEWEST_SHADOWS)[:max(len(real), _FEWEST_SHADOWS)]
    names = {f"s{i}": name for i, name in enumerate(shadowed)}
    wide = rows.select("__key", "__label", *real, *[F.col(n).alias(s) for s, n in names.items()])
    mixed = with_shadows(wide, list(names), "__key", keep=["__label", *real], seed=seed, copies=copies)
    return mixed.withColumn("__copy", F.col("copy") if copies > 1 else F.lit(1)), [f"shadow_{s}" for s in names]


def _hits(table: DataFrame, real: Sequence[str], shadows: Sequence[str], task: str, trees: int, depth: int,
          seed: int) -> set[str]:
    """Columns more important than the best of the shadows."""
    found = _importances(table, [*real, *shadows], task, trees, depth, seed)
    best_shadow = max(found[s] for s in shadows)
    return {name for name in real if found[name] > best_shadow}


def boruta_select(df: DataFrame, features: Sequence[str], label: str, key: str, max_iter: int = 100,
                  alpha: float = 0.05, seed: int = 0, trees: int = 100, depth: int = 5,
                  task: str = "binary", rounds_at_once: int = 4) -> DataFrame:
    """One row (feature, hits, status) per feature.

    Each round has shuffled shadows of the features still in play, fits a forest on both and
    counts a hit for features more important than the best shadow. The shadows of
    ``rounds_at_once`` rounds come from one shuffling pass and are written once. Rejected features
    leave the table with the next pass; the rounds end when no feature is undecided.
    """
    names = {c: f"f{i}" for i, c in enumerate(features)}
    numbers = df.where(column(label).isNotNull()).select(
        column(key).alias("__key"), column(label).cast("double").alias("__label"),
        *[F.coalesce(clean(df, c).cast("double"), F.lit(MISSING)).alias(n) for c, n in names.items()])
    hits, status = dict.fromkeys(features, 0), dict.fromkeys(features, TENTATIVE)
    def undecided() -> bool:
        return any(verdict == TENTATIVE for verdict in status.values())

    run = 0
    with staged(numbers) as rows:
        while run < max_iter and undecided():
            real = [c for c in features if status[c] != REJECTED]
            copies = min(rounds_at_once, max_iter - run)
            mixed, shadows = _shadowed(rows, [names[c] for c in real], copies, seed + run + 1)
            # The forest reads its input several times: shuffle once, read the files of one copy.
            with staged(mixed, partition_by=["__copy"]) as table:
                for copy in range(1, copies + 1):
                    run += 1
                    hit = _hits(table.where(F.col("__copy") == copy), [names[c] for c in real], shadows, task, trees,
                                depth, seed + run)
                    for c in real:
                        hits[c] += names[c] in hit
                        if status[c] == TENTATIVE:
                            status[c] = decide(hits[c], run, len(features), alpha)
                    if not undecided():
                        break
    lines = [(c, int(hits[c]), status[c]) for c in features]
    return df.sparkSession.createDataFrame(lines, "feature string, hits int, status string")


def keep_confirmed(df: DataFrame, verdicts: DataFrame, keep: Sequence[str] = (),
                   path: str | None = None) -> DataFrame:
    """The table with confirmed features only (plus ``keep``), written to ``path`` if given."""
    rows = verdicts.select("feature", (F.col("status") == CONFIRMED).alias("support")).collect()
    selected = select_supported(df, [r["feature"] for r in rows], [r["support"] for r in rows], keep)
    if path is not None:
        write_table(selected, path)
    return selected
