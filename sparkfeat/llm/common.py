"""Small helpers of the corpus operators."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.sources.staging import stage


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def whole_ids(frame: DataFrame, id_col: str) -> None:
    """Raises unless the ids are whole numbers."""
    kind = frame.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} is {kind}: this operator needs whole numbers as ids")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII alone takes the quicker full lower-casing."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def parts_for(frame: DataFrame, text: str, bytes_each: int) -> int:
    """How many parts of about ``bytes_each`` bytes of text the frame makes, at least 1."""
    total = frame.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / bytes_each))


#: Groups of over 1/HOT_SHARE of the rows: there are fewer than HOT_SHARE of them, so that a
#: broadcast of them is bounded whatever the number of rows.
HOT_SHARE = 256


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Inner join of staged rows with what is known of their group (one row for each ``key``).

    The few groups with a large share of the rows, as counted here, are broadcast, so that their
    rows stay where they are; the others meet in a sort-merge join.
    """
    total = rows.count()
    large = F.broadcast(stage(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > total).select(key)))
    rest = rows.join(large, key, "left_anti").join(groups.hint("merge"), key)
    return rows.join(F.broadcast(groups.join(large, key)), key).unionByName(rest)
