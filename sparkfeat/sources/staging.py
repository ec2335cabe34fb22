"""Intermediate tables in the cluster's shared folder, and size-checked broadcasts.

An operator that looks twice at a computed frame (a fitted mapping, ranges with their
offsets) writes it once and reads the files back. The result has no lineage to recompute,
so a lost executor costs a re-read and never a different answer.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
_ROW_OVERHEAD = 32
_LOCAL_ROOTS: dict[str, str] = {}
_OPEN: ContextVar[list[str] | None] = ContextVar("open staging scope", default=None)


def staging_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, per application.

    Only a local session, where driver and executors are one process, falls back to a
    temporary folder; the session's own checkpoint folder is left as it is. A ``file:`` folder
    is taken as given: it may be a mount that all machines share, which only its owner knows.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _LOCAL_ROOTS.get(context.applicationId) or tempfile.mkdtemp(prefix="sparkfeat-")
        _LOCAL_ROOTS[context.applicationId] = root
    return f"{root.rstrip('/')}/{context.applicationId}"


def _write(df: DataFrame, partition_by: Sequence[str]) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    columns = [F.col(f"`{name}`") for name in df.columns]
    return spark.read.schema(df.schema).parquet(path).select(*columns), path


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system; PySpark reaches them only through its JVM gateway."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Compute ``df`` once into the staging folder and return a frame that reads it back.

    The files stay until the surrounding :func:`staging_scope` ends, or :func:`clear_staging`.
    """
    frame, path = _write(df, partition_by)
    scope = _OPEN.get()
    if scope is not None:
        scope.append(path)
    return frame


def stage_bucketed(df: DataFrame, buckets: int, by: Sequence[str], sort: Sequence[str] = ()) -> DataFrame:
    """Like :func:`stage`, with the rows in ``buckets`` files by hash of ``by``, each sorted by ``by`` and ``sort``.

    Groupings and windows by ``by`` (and more columns) read the result without an exchange. Only a table of
    the catalog can say so; its entry lasts until the frame knows its files.
    """
    spark = df.sparkSession
    name, path = f"staged_{uuid.uuid4().hex}", f"{staging_root(spark)}/{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).bucketBy(buckets, *by).sortBy(*by, *sort).saveAsTable(name)
    frame = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    scope = _OPEN.get()
    if scope is not None:
        scope.append(path)
    return frame


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, all that operators staged inside the block.

    Results must be consumed (written, collected) inside. A scope within a scope joins it.
    """
    if _OPEN.get() is not None:
        yield
        return
    paths: list[str] = []
    token = _OPEN.set(paths)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in paths:
            _delete(spark, path)


@contextmanager
def staged(df: DataFrame, partition_by: Sequence[str] = ()) -> Iterator[DataFrame]:
    """Like :func:`stage`, for work that ends inside the block: its files are removed after it."""
    frame, path = _write(df, partition_by)
    try:
        yield frame
    finally:
        _delete(df.sparkSession, path)


def clear_staging(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; frames that still read them stop working."""
    _delete(spark, staging_root(spark))


def _width(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        # The JSON text is longer than the binary form of the numeric arrays staged here.
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)).cast("long")
    return F.lit(16).cast("long")


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size of ``df``, from its actual values."""
    row = sum((_width(field) for field in df.schema.fields), F.lit(_ROW_OVERHEAD).cast("long"))
    return int(df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()["bytes"])


def checked_broadcast(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if its measured size allows, else leave the join to Spark.

    Pass a staged frame: measuring reads the frame once.
    """
    bound = BROADCAST_BYTES if limit is None else limit
    return F.broadcast(df) if measured_bytes(df) <= bound else df
