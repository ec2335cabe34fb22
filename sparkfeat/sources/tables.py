"""Reading and writing tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkfeat.sources.records import csv_records


def _format_of(path: str) -> str:
    return "parquet" if path.rstrip("/").endswith(".parquet") else "csv"


# Standard CSV: a quote in a quoted field is doubled, blanks around a field belong to it, and only
# an unquoted empty field is missing.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               multi_line: bool = True, split_bytes: int | None = None) -> DataFrame:
    """Read a CSV table with a header row (or parquet, by extension); wildcards are allowed.

    Without ``schema`` the CSV types are inferred, which reads the text one extra time:
    give a schema for large inputs. A quoted field may hold line ends. Spark's own reader takes a task for
    each such file; files of more than ``split_bytes`` (by default the size of an input partition) are read by
    many tasks, see :func:`csv_records`, and their rows come in no particular order. ``multi_line=False`` is for text
    known to have a line for each row.
    """
    if _format_of(path) == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    if multi_line and _largest_file(spark, path) > _split_bytes(spark, split_bytes):
        return _read_records(spark, path, schema)
    reader = spark.read.options(**_CSV, multiLine=multi_line)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


def _split_bytes(spark: SparkSession, asked: int | None) -> int:
    if asked is not None:
        return asked
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return int(size[:-1] if size.endswith("b") else size)


def _largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file; only the listing is read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def _read_records(spark: SparkSession, path: str, schema: StructType | str | None) -> DataFrame:
    records = csv_records(spark, path)
    names = spark.read.options(**_CSV, multiLine=True).csv(path).columns if schema is None else None
    reader = spark.read.options(**{**_CSV, "header": False})
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    # The JVM reader takes a frame of texts, a record each; PySpark's has no name for it.
    texts = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    table = DataFrame(reader._jreader.csv(texts), spark)
    return table if names is None else table.toDF(*names)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``df`` as a folder of part files: CSV with a header, or parquet by extension."""
    writer = df.write.mode(mode)
    if _format_of(path) == "parquet":
        writer.parquet(path)
    else:
        writer.options(**_CSV).csv(path)
