"""Exact duplicates by a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch of documents is reduced to
one row per digest, anti-joined with the index by sort-merge, and what is new is appended. Both
sides of later joins find the index already partitioned and sorted.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.llm.common import join_groups, lower_ascii, whole_ids
from sparkfeat.sources.staging import stage

_SCHEMA = "digest binary, keep_id bigint, keep_row bigint, group_size bigint, batch string"


def open_index(spark: SparkSession, name: str, path: str | None = None, buckets: int = 64) -> None:
    """Make the index table ``name`` known to the session; files at ``path`` are taken over."""
    place = f"LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_SCHEMA}) USING parquet "
              f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS {place}")


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``id, row, digest`` and ``kept_0`` ... for the columns in ``keep``: SHA-256 of the text with A-Z lower-cased; null text counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.unhex(F.sha2(lower_ascii(text), 256)).alias("digest"),
                       *[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)])


def deduplicate(docs: DataFrame, index: str, id_col: str = "doc_id", text_col: str = "text",
                buckets: int = 64, path: str | None = None, keep: Sequence[str] = (), batch: str | None = None) -> DataFrame:
    """Deduplicate a batch against the index and within itself, and append what is new.

    Returns ``id_col, keep_id, group_size, kept, text_sha256``, a row for each input row, dropped
    ones too, and the row's columns in ``keep``. Of equal texts in a batch the row with the largest id stays (of rows that repeat an
    id, one; a null id only if all are null). If the index has the text from an earlier batch, no
    row of this one stays and ``keep_id`` is the earlier id. ``group_size`` counts the rows of the
    batch that brought the text. ``path`` is where a new index lies, by default the warehouse; an index
    keeps the number of buckets it was made with. An empty batch gives no rows; other columns are ignored.

    Name the ``batch`` if it may have to be repeated: what an earlier run of the same name and rows has appended is
    then its own, so that the repeated run gives the same verdicts and appends only what is missing. Batches come one after
    the other; two at once may both bring a digest. Ids are whole numbers.
    """
    spark = docs.sparkSession
    whole_ids(docs, id_col)
    open_index(spark, index, path, buckets)
    batch = batch or uuid.uuid4().hex
    keep = [c for c in keep if c != id_col]
    rows = stage(text_digests(docs, id_col, text_col, keep))
    groups = stage(rows.groupBy("digest").agg(
        F.max(F.struct(F.col("id"), F.col("row"))).alias("keep"), F.count("*").alias("rows")).select(
        "digest", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "rows"))
    fresh = groups.hint("merge").join(spark.table(index).select("digest"), "digest", "left_anti").select(
        "digest", "keep_id", "keep_row", F.col("rows").alias("group_size"), F.lit(batch).alias("batch"))
    # Rows of a digest come together here anyway, so each bucket gets one sorted file.
    stage(fresh).repartition(buckets, "digest").write.format("parquet").mode("append").bucketBy(
        buckets, "digest").sortBy("digest").saveAsTable(index)

    # Row numbers may differ in a repeated run, so that the row that stays is the one of this run.
    known = groups.select("digest", "keep_row").hint("merge").join(
        spark.table(index).select("digest", "keep_id", "group_size", "batch"), "digest")
    return join_groups(rows, known, "digest").select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])
