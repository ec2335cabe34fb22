"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Timestamps with a zone are read as UTC wall-clock time. The adaptive settings are Spark's
# defaults, named here because wide joins lean on them to split hot partitions. Recording the
# Python call site of every column costs more than planning the wide aggregates does.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder, **extra: str) -> SparkSession.Builder:
    """Add the library's settings, then ``extra``, to a session builder."""
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", **extra: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkfeat")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    spark = configure(builder, **extra).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
