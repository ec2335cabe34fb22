"""The given tables, and the views over them that play the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AS_OF = "2002-01-01"
# Moves a value off a rounding tie, so that engines which add in different orders agree.
NUDGE = "0.0000131"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column for comparison with another engine."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({
        name: F.expr(f"round(`{name}` + CAST({NUDGE} AS DOUBLE), {digits})") for name in doubles})


def r(expression: str, digits: int = 4) -> str:
    """The SQL side of :func:`rounded`."""
    return f"round(CAST({expression} AS DOUBLE) + {NUDGE}, {digits})"


_TXN = """
SELECT o_orderkey AS txn_id, o_custkey AS card_id, {date} AS purchase_date,
 year(o_orderdate)*12+month(o_orderdate)-24020 AS month_lag, o_totalprice AS purchase_amount,
 CASE WHEN o_orderkey%11=0 THEN NULL ELSE CAST(o_orderkey%7 AS INT) END AS installments,
 CASE o_orderstatus WHEN 'F' THEN 'Y' WHEN 'O' THEN 'N' ELSE o_orderstatus END AS authorized_flag,
 CASE WHEN o_orderkey%13=0 THEN NULL WHEN o_orderkey%3=0 THEN 1 ELSE 0 END AS category_1,
 CASE WHEN o_orderkey%6=0 THEN NULL ELSE CAST(o_orderkey%6 AS DOUBLE) END AS category_2,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B' WHEN '3-MEDIUM' THEN 'C' ELSE NULL END AS category_3,
 CASE WHEN s_suppkey%2=0 THEN 1 ELSE 0 END AS category_4, c_nationkey AS city_id, n_regionkey AS state_id,
 s_suppkey AS merchant_id, s_nationkey AS merchant_group_id, c_mktsegment AS subsector_id,
 s_acctbal/3 AS merchant_profit3, s_acctbal/6 AS merchant_profit6, s_acctbal/12 AS merchant_profit12,
 1+s_suppkey%3 AS active_months_lag3, 1+s_suppkey%6 AS active_months_lag6, 1+s_suppkey%12 AS active_months_lag12
FROM (SELECT *, o_orderkey % (SELECT count(*) FROM {supplier}) AS o_suppkey FROM {orders})
     JOIN {customer} ON o_custkey=c_custkey JOIN {nation} ON c_nationkey=n_nationkey
     JOIN {supplier} ON s_suppkey=o_suppkey
"""

TXN_SQL = _TXN.format(date="o_orderdate + to_hours(CAST(o_orderkey%24 AS INT))", orders="orders",
                      customer="customer", nation="nation", supplier="supplier")


def txn(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order in the shape of a card transaction; key ``txn_id``."""
    names = ("orders", "customer", "nation", "supplier")
    text = _TXN.replace("{date}", "o_orderdate + make_dt_interval(0, CAST(o_orderkey%24 AS INT), 0, 0)")
    return spark.sql(text, **{name: table(spark, folder, name) for name in names})


def monthly_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Amount per card and month: at most one row per month in a card."""
    return txn(spark, folder).groupBy("card_id", "month_lag").agg(
        F.sum("purchase_amount").alias("purchase_amount"))


MONTHLY_SQL = (f"SELECT card_id, month_lag, sum(purchase_amount) AS purchase_amount "
               f"FROM ({TXN_SQL}) GROUP BY card_id, month_lag")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their quality label; NULL where nobody labelled them."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id", "left")


LABELLED_SQL = ("SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality "
                "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")

VECTOR_FEATURES = [f"e{i}" for i in range(64)]


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """All embedding elements as feature columns, and a two-class label ``y``."""
    elements = {name: F.col("embedding")[i].cast("double") for i, name in enumerate(VECTOR_FEATURES)}
    return (table(spark, folder, "embeddings").withColumns(elements)
            .select("vec_id", *VECTOR_FEATURES, (F.col("label") < 5).cast("int").alias("y")))


VECTORS_SQL = ("SELECT vec_id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(64))
    + ", CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM embeddings")
