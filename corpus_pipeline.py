"""A corpus pipeline: quality, exact and near duplicates, benchmark passages, tokens.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
frame. Each works on all that its predecessor kept, and all but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from sparkfeat.llm.queries import vocabulary_path
from sparkfeat.sources.staging import stage, staging_root

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go. It learns from the given labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = quality.score(docs.select(*COLUMNS), quality.fit(docs, labels))
    return scored.where("score >= 0.3").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    name = f"pipeline_index_{uuid.uuid4().hex}"
    verdict = exact_dedup.deduplicate(docs, name, path=f"{staging_root(spark)}/{name}", keep=COLUMNS)
    return verdict.where("kept").select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest doc_id stays."""
    return near_dedup.near_duplicates(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.decontaminate(docs, items, keep=COLUMNS)
    return found.where("NOT contaminated").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded."""
    return bpe.encode(docs, vocabulary_path())


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage),
          ("near_dedup", near_stage), ("benchmark", benchmark_stage), ("tokens", token_stage)]

#: The classifier and the tokenizer have no SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES, ORACLES = {"pipeline": run}, {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
