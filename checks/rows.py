"""Row-level operators: sources, projections, calendar, text, row statistics, imputation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.views import AS_OF, LABELLED_SQL, TXN_SQL, labelled_documents, r, rounded, table, txn, vectors
from sparkfeat import operators as ops
from sparkfeat import plans
from sparkfeat.functions import contains_flag, first_parts, sku_family
from sparkfeat.sources import read_table, stage, staging_root, write_table

QUERIES, ORACLES = {}, {}


def check(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


@check("csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf):
    path = f"{staging_root(spark)}/{uuid.uuid4().hex}"
    write_table(table(spark, sf, "customer"), path)
    return ops.cast_columns(read_table(spark, path), ["c_custkey"], "bigint")


@check("exclude_columns", "SELECT p_partkey, p_type, p_size, p_retailprice FROM part")
def exclude_columns(spark, sf):
    return ops.select_features(table(spark, sf, "part"), ["p_name", "p_brand"])


_PROBES = ["installments", "category_2", "category_3"]
_LEFTOVER = ["txn_id", "card_id", "purchase_amount"]


@check("split_all_null_complete", f"""
SELECT txn_id, card_id, installments, category_2, category_3, {r('purchase_amount')} AS purchase_amount
FROM ({TXN_SQL}) WHERE installments IS NOT NULL OR category_2 IS NOT NULL OR category_3 IS NOT NULL""")
def split_all_null_complete(spark, sf):
    complete, _ = ops.split_all_null(txn(spark, sf), _PROBES, _LEFTOVER)
    return complete.select("txn_id", "card_id", *_PROBES, F.round(
        F.col("purchase_amount") + 0.0000131, 4).alias("purchase_amount"))


@check("split_all_null_leftover", f"""
SELECT txn_id, card_id, {r('purchase_amount')} AS purchase_amount
FROM ({TXN_SQL}) WHERE installments IS NULL AND category_2 IS NULL AND category_3 IS NULL""")
def split_all_null_leftover(spark, sf):
    return rounded(ops.split_all_null(txn(spark, sf), _PROBES, _LEFTOVER)[1])


@check("map_flags", f"""
SELECT txn_id, CASE authorized_flag WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END AS authorized_flag
FROM ({TXN_SQL})""")
def map_flags(spark, sf):
    rows = txn(spark, sf).select("txn_id", "authorized_flag")
    return ops.map_values(rows, ["authorized_flag"], {"Y": 1, "N": 0})


@check("patch_value", """
SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'patched' ELSE o_orderpriority END AS o_orderpriority
FROM orders""")
def patch_value(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return ops.patch_value(rows, "o_orderkey", 7, "o_orderpriority", "patched")


@check("cast_float32", """
SELECT o_orderkey, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS o_totalprice FROM orders""")
def cast_float32(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ops.cast_columns(ops.cast_columns(rows, ["o_totalprice"], "float"), ["o_totalprice"], "double")


@check("replace_values", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '5-LOW' THEN 'LOW'
 ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def replace_values(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return ops.replace_values(rows, ["o_orderpriority"], {"1-URGENT": "URGENT", "5-LOW": "LOW"})


def _int_type(low: str, high: str) -> str:
    return (f"CASE WHEN {low} > -128 AND {high} < 127 THEN 'tinyint' "
            f"WHEN {low} > -32768 AND {high} < 32767 THEN 'smallint' "
            f"WHEN {low} > -2147483648 AND {high} < 2147483647 THEN 'int' ELSE 'bigint' END")


# The narrow type depends on the data, so the values are compared as the widest type and the
# chosen types are compared by the report below.
@check("narrow_types", """
SELECT p_partkey, p_size, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS p_retailprice,
 p_name, p_brand, p_type FROM part""")
def narrow_types(spark, sf):
    narrowed = ops.narrow_types(table(spark, sf, "part"), float_columns="all")
    widest = {"p_partkey": "bigint", "p_size": "int", "p_retailprice": "double"}
    return narrowed.withColumns({c: F.col(c).cast(t) for c, t in widest.items()})


_WIDTH = "CASE new_type WHEN 'tinyint' THEN 1 WHEN 'smallint' THEN 2 WHEN 'int' THEN 4 WHEN 'float' THEN 4 ELSE 8 END"


@check("narrowing_report", f"""
WITH b AS (SELECT count(*) AS n, min(l_orderkey) AS a0, max(l_orderkey) AS b0, min(l_partkey) AS a1,
  max(l_partkey) AS b1, min(l_suppkey) AS a2, max(l_suppkey) AS b2, min(l_linenumber) AS a3,
  max(l_linenumber) AS b3 FROM lineitem),
c AS (SELECT 'l_orderkey' AS "column", 'bigint' AS old_type, {_int_type('a0', 'b0')} AS new_type, n FROM b
  UNION ALL SELECT 'l_partkey', 'bigint', {_int_type('a1', 'b1')}, n FROM b
  UNION ALL SELECT 'l_suppkey', 'bigint', {_int_type('a2', 'b2')}, n FROM b
  UNION ALL SELECT 'l_linenumber', 'int', {_int_type('a3', 'b3')}, n FROM b
  UNION ALL SELECT 'l_quantity', 'double', 'float', n FROM b
  UNION ALL SELECT 'l_extendedprice', 'double', 'float', n FROM b
  UNION ALL SELECT 'l_discount', 'double', 'float', n FROM b
  UNION ALL SELECT 'l_tax', 'double', 'float', n FROM b),
d AS (SELECT "column", old_type, new_type, n, CASE old_type WHEN 'int' THEN 4 ELSE 8 END AS w, {_WIDTH} AS v FROM c)
SELECT "column", old_type, new_type, CAST(n * w AS BIGINT) AS old_bytes, CAST(n * v AS BIGINT) AS new_bytes,
 CAST(100.0 * (w - v) / w AS DOUBLE) AS saved_pct FROM d""")
def narrowing_report(spark, sf):
    return ops.narrowing_report(table(spark, sf, "lineitem"), float_columns="all")


@check("time_features", f"""
SELECT txn_id, purchase_date, CAST(year(purchase_date) AS INT) AS year, CAST(week(purchase_date) AS INT) AS weekofyear,
 CAST(month(purchase_date) AS INT) AS month, CAST(isodow(purchase_date) - 1 AS INT) AS dayofweek,
 CAST(CASE WHEN isodow(purchase_date) >= 6 THEN 1 ELSE 0 END AS INT) AS weekend,
 CAST(hour(purchase_date) AS INT) AS hour FROM ({TXN_SQL})""")
def time_features(spark, sf):
    return ops.time_features(txn(spark, sf).select("txn_id", "purchase_date"), "purchase_date")


@check("month_diff", f"""
SELECT txn_id, CAST(floor(floor((1009843200 - epoch(purchase_date)) / 86400) / 30) + month_lag AS INT) AS month_diff
FROM ({TXN_SQL})""")
def month_diff(spark, sf):
    return ops.month_diff(txn(spark, sf), "purchase_date", "month_lag", AS_OF).select("txn_id", "month_diff")


@check("one_hot", f"""
SELECT txn_id, {', '.join(f"CASE WHEN category_2 = {v} THEN 1 ELSE 0 END AS category_2_{v:.0f}" for v in (1.0, 2.0, 3.0, 4.0, 5.0))},
 CASE WHEN category_2 IS NULL THEN 1 ELSE 0 END AS category_2_N,
 CASE WHEN category_3 = 'A' THEN 1 ELSE 0 END AS category_3_A, CASE WHEN category_3 = 'B' THEN 1 ELSE 0 END AS category_3_B,
 CASE WHEN category_3 = 'C' THEN 1 ELSE 0 END AS category_3_C,
 CASE WHEN category_3 IS NULL THEN 1 ELSE 0 END AS category_3_N FROM ({TXN_SQL})""")
def one_hot(spark, sf):
    rows = txn(spark, sf).select("txn_id", "category_2", "category_3")
    rows = ops.one_hot(ops.one_hot(rows, "category_2", [1.0, 2.0, 3.0, 4.0, 5.0]), "category_3", ["A", "B", "C"])
    renamed = rows.withColumnsRenamed({f"category_2_{v}.0": f"category_2_{v}" for v in range(1, 6)})
    return renamed.drop("category_2", "category_3")


_CELLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# A row's identity is its event; the cells are four numbers drawn from it, some of them missing.
_EVENT_CELLS = """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS a,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS b,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * 2 - 100 END AS c,
 CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) END AS d,
 CASE WHEN event_id % 35 = 0 THEN NULL ELSE value / 3 END AS e FROM {events}"""


@check("row_statistics", f"""
WITH t AS (SELECT event_id, list_filter([a, b, c, d, e], lambda x: x IS NOT NULL) AS v FROM ({_EVENT_CELLS.format(events='events')})),
s AS (SELECT event_id, v, len(v) AS n, list_aggregate(v, 'stddev_pop') AS sd FROM t)
SELECT event_id, {r("coalesce(list_sum(v), 0)")} AS sum, {r("list_min(v)")} AS min, {r("list_max(v)")} AS max,
 {r("list_avg(v)")} AS mean, {r("CASE WHEN n >= 2 THEN list_aggregate(v, 'stddev_samp') END")} AS std,
 {r("CASE WHEN n < 3 THEN NULL WHEN sd = 0 THEN 0 ELSE list_aggregate(v, 'skewness') END")} AS skew,
 {r("CASE WHEN n < 4 THEN NULL WHEN sd = 0 THEN 0 ELSE list_aggregate(v, 'kurtosis') END")} AS kurt,
 {r("list_aggregate(v, 'median')")} AS med FROM s""")
def row_statistics(spark, sf):
    cells = spark.sql(_EVENT_CELLS, events=table(spark, sf, "events"))
    return rounded(ops.row_statistics(cells, list("abcde")).drop(*"abcde"))


@check("row_statistics_wide", f"""
WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, {r("list_sum(v)")} AS sum, {r("list_min(v)")} AS min, {r("list_max(v)")} AS max, {r("list_avg(v)")} AS mean,
 {r("list_aggregate(v, 'stddev_samp')")} AS std, {r("list_aggregate(v, 'skewness')")} AS skew,
 {r("list_aggregate(v, 'kurtosis')")} AS kurt, {r("list_aggregate(v, 'median')")} AS med FROM t""")
def row_statistics_wide(spark, sf):
    names = [f"e{i}" for i in range(64)]
    cells = table(spark, sf, "embeddings").select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    return rounded(ops.row_statistics(cells, names).drop(*names))


@check("global_quantiles", f"""
WITH cells AS (SELECT l_quantity AS v FROM lineitem UNION ALL SELECT l_extendedprice FROM lineitem
 UNION ALL SELECT l_discount FROM lineitem UNION ALL SELECT l_tax FROM lineitem),
q AS (SELECT quantile_cont(v, 0.01) AS q1, quantile_cont(v, 0.05) AS q2, quantile_cont(v, 0.95) AS q3,
 quantile_cont(v, 0.99) AS q4 FROM cells)
SELECT l_orderkey, l_linenumber, {r('q1')} AS quan_1, {r('q2')} AS quan_2, {r('q3')} AS quan_3, {r('q4')} AS quan_4
FROM lineitem, q""")
def global_quantiles(spark, sf):
    rows = ops.with_global_quantiles(table(spark, sf, "lineitem"), _CELLS)
    return rounded(rows.select("l_orderkey", "l_linenumber", "quan_1", "quan_2", "quan_3", "quan_4"))


# All embedding elements of a vector: table-wide quantiles next to its row statistics.
_E = [f"e{i}" for i in range(64)]


@check("row_features", f"""
WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c AS (SELECT unnest(v) AS x FROM t),
q AS (SELECT quantile_cont(x, 0.01) AS q1, quantile_cont(x, 0.05) AS q2, quantile_cont(x, 0.95) AS q3,
 quantile_cont(x, 0.99) AS q4 FROM c)
SELECT vec_id, {r("list_sum(v)")} AS sum, {r("list_min(v)")} AS min, {r("list_max(v)")} AS max, {r("list_avg(v)")} AS mean,
 {r("list_aggregate(v, 'stddev_samp')")} AS std, {r("list_aggregate(v, 'skewness')")} AS skew,
 {r("list_aggregate(v, 'kurtosis')")} AS kurt, {r("list_aggregate(v, 'median')")} AS med,
 {r('q1')} AS quan_1, {r('q2')} AS quan_2, {r('q3')} AS quan_3, {r('q4')} AS quan_4 FROM t, q""")
def row_features(spark, sf):
    return rounded(plans.row_features(vectors(spark, sf).drop("y"), _E).drop(*_E))


@check("fill_mean", f"""
WITH t AS ({TXN_SQL})
SELECT txn_id, {r("coalesce(installments, (SELECT avg(installments) FROM t))")} AS installments,
 {r("coalesce(category_2, (SELECT avg(category_2) FROM t))")} AS category_2 FROM t""")
def fill_mean(spark, sf):
    rows = txn(spark, sf).select("txn_id", "installments", "category_2")
    return rounded(ops.fill_mean(rows, ["installments", "category_2"]))


@check("fill_quantile", f"""
WITH t AS (SELECT txn_id, installments, CASE WHEN txn_id % 9 = 0 THEN NULL ELSE purchase_amount END AS amount FROM ({TXN_SQL}))
SELECT txn_id, {r("coalesce(installments, (SELECT quantile_cont(CAST(installments AS DOUBLE), 0.5) FROM t))")} AS installments,
 {r("coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM t))")} AS amount FROM t""")
def fill_quantile(spark, sf):
    amount = F.when(F.col("txn_id") % 9 != 0, F.col("purchase_amount")).alias("amount")
    rows = txn(spark, sf).select("txn_id", "installments", amount)
    return rounded(ops.fill_quantile(rows, ["installments", "amount"]))


@check("fill_quantile_history", f"""
WITH t AS (SELECT txn_id, CASE WHEN txn_id % 9 = 0 THEN NULL ELSE purchase_amount END AS amount FROM ({TXN_SQL}))
SELECT txn_id, {r("coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM t))")} AS amount,
 (SELECT count(amount) FROM t) AS known FROM t""")
def fill_quantile_history(spark, sf):
    """Filled by the kept state of old transactions merged with that of the new ones."""
    amount = F.when(F.col("txn_id") % 9 != 0, F.col("purchase_amount")).alias("amount")
    rows = stage(txn(spark, sf).select("txn_id", "month_lag", amount))
    states = [ops.quantile_state(rows.where(part), ["amount"]) for part in ("month_lag < 0", "NOT month_lag < 0")]
    state = stage(ops.merge_quantile_states(*states))
    filled = ops.fill_quantile(rows, ["amount"], state=state).select("txn_id", "amount")
    return rounded(filled.withColumn("known", F.lit(state.first()["n"]).cast("bigint")))


_BRANCH = """
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN lower(c_mktsegment)
 ELSE concat_ws('_', lower(c_mktsegment), c_nationkey, c_custkey % 7) END AS branch FROM {customer}"""


@check("first_parts", f"""
SELECT c_custkey, CASE WHEN len(string_split(branch, '_')) > 1
 THEN array_to_string(list_slice(string_split(branch, '_'), 1, 2), '_') ELSE branch END AS branch
FROM ({_BRANCH.format(customer='customer')})""")
def first_parts_query(spark, sf):
    rows = spark.sql(_BRANCH, customer=table(spark, sf, "customer"))
    return rows.select("c_custkey", first_parts(F.col("branch"), "_", 2).alias("branch"))


_SKU = """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('SKU_', 'SERVER_', upper(p_type)) WHEN 1 THEN 'PRO_N'
 WHEN 2 THEN NULL WHEN 3 THEN 'PRO' ELSE upper(p_type) END AS sku FROM {part}"""


@check("sku_family", f"""
WITH h AS (SELECT p_partkey, CASE WHEN contains(sku, 'SERVER') THEN 'SERVER' ELSE substr(sku, 1, 4) END AS sku
 FROM ({_SKU.format(part='part')}))
SELECT p_partkey, CASE WHEN sku = 'PRO_' THEN 'PROF' ELSE sku END AS sku FROM h""")
def sku_family_query(spark, sf):
    rows = spark.sql(_SKU, part=table(spark, sf, "part"))
    return rows.select("p_partkey", sku_family(F.col("sku")).alias("sku"))


@check("contains_flag", """
SELECT doc_id, CASE WHEN contains(lower(text), 'li') THEN 1 ELSE 0 END AS has_li FROM documents""")
def contains_flag_query(spark, sf):
    return table(spark, sf, "documents").select("doc_id", contains_flag(F.col("text"), "li").alias("has_li"))


_VERSION = "SELECT p_partkey, concat_ws('.', p_partkey % 3 + 1, p_size, p_partkey) AS version FROM {part}"


def _version_sql(width: str) -> str:
    pads = " || ".join(
        f"lpad(s[{i}], greatest(length(s[{i}]), {width.format(i=i)})::INT, '0')" for i in (1, 2, 3))
    return f"""
WITH v AS (SELECT p_partkey, string_split(version, '.') AS s FROM ({_VERSION.format(part='part')})),
m AS (SELECT max(length(s[1])) AS m1, max(length(s[2])) AS m2, max(length(s[3])) AS m3 FROM v)
SELECT p_partkey, CAST({pads} AS DOUBLE) AS version FROM v, m"""


@check("version_number", _version_sql("m{i} - length(s[{i}])"))
def version_number(spark, sf):
    return ops.version_number(spark.sql(_VERSION, part=table(spark, sf, "part")), ["version"])


@check("version_number_fixed", _version_sql("m{i}"))
def version_number_fixed(spark, sf):
    rows = spark.sql(_VERSION, part=table(spark, sf, "part"))
    return ops.version_number(rows, ["version"], fixed_width=True)


@check("segment_widths", f"""
WITH v AS (SELECT string_split(version, '.') AS s FROM ({_VERSION.format(part='part')}))
SELECT CAST(max(length(s[1])) AS INT) AS w0, CAST(max(length(s[2])) AS INT) AS w1, CAST(max(length(s[3])) AS INT) AS w2 FROM v""")
def segment_widths(spark, sf):
    widths = ops.segment_widths(spark.sql(_VERSION, part=table(spark, sf, "part")), ["version"])
    return spark.createDataFrame([tuple(widths["version"])], "w0 int, w1 int, w2 int")


_LOOKUP = f"""
WITH m AS (SELECT source, {r("avg(quality)")} AS q FROM ({LABELLED_SQL}) WHERE quality IS NOT NULL 
 GROUP BY source HAVING count(*) * 400 > 17 * (SELECT count(*) FROM labels WHERE quality IS NOT NULL))
SELECT doc_id, coalesce(q, -1.0) AS q FROM documents d LEFT JOIN m ON d.source = m.source"""


def _source_means(spark, sf):
    labelled = labelled_documents(spark, sf).where("quality IS NOT NULL")
    groups = labelled.groupBy("source").agg(F.avg("quality").alias("q"), F.count("*").alias("n"))
    # Whatever the scale, some sources have too few labels for a mean.
    enough = groups.where(F.col("n") * 400 > 17 * labelled.count())
    return stage(rounded(enough.select("source", "q")))


@check("lookup_default", _LOOKUP)
def lookup_default(spark, sf):
    return ops.lookup(table(spark, sf, "documents"), _source_means(spark, sf), "source", "q", default=-1.0).select("doc_id", "q")


@check("lookup_large", _LOOKUP)
def lookup_large(spark, sf):
    """The same by the join for mappings that are too large to broadcast."""
    return ops.lookup(table(spark, sf, "documents"), _source_means(spark, sf), "source", "q", default=-1.0,
                      small=False).select("doc_id", "q")


# A file is written by one task. Small tables make one file, large ones more of them.
CSV_FILE_BYTES = 256 << 20

_AWKWARD = """
SELECT doc_id, concat('  ', CASE WHEN doc_id % 3 = 0 THEN concat('say "', text, '", ', {char}(92), 'n back', {char}(92), ' ')
 WHEN doc_id % 3 = 1 THEN concat(text, {char}(10), {char}(13), {char}(10), '"') ELSE concat(text, ' ') END) AS text,
 lang, source, n_chars FROM {documents}"""


@check("csv_roundtrip_text", _AWKWARD.format(char="chr", documents="documents"))
def csv_roundtrip_text(spark, sf):
    """Texts with quotes, line ends, outer blanks and backslashes come back as they were."""
    query = _AWKWARD.replace("{char}", "char")
    documents = spark.sql(query, documents=table(spark, sf, "documents"))
    path = f"{staging_root(spark)}/{uuid.uuid4().hex}"
    write_table(documents, path)
    return read_table(spark, path, schema=documents.schema)


@check("csv_multi_line", _AWKWARD.format(char="chr", documents="documents"))
def csv_multi_line(spark, sf):
    """Files whose records span lines, as large as a task should write, each read in byte ranges by many tasks."""
    documents = spark.sql(_AWKWARD.replace("{char}", "char"), documents=table(spark, sf, "documents"))
    total = documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    path = f"{staging_root(spark)}/{uuid.uuid4().hex}"
    write_table(documents.coalesce(total // CSV_FILE_BYTES + 1), path)
    return read_table(spark, path, schema=documents.schema, split_bytes=0)


@check("fill_quantile_wide", f"""
WITH t AS (SELECT vec_id, unnest(range(64)) AS i, CASE WHEN (vec_id + unnest(range(64))) % 5 = 0 THEN NULL
 ELSE CAST(unnest(embedding) AS DOUBLE) END AS x FROM embeddings),
m AS (SELECT i, quantile_cont(x, 0.5) AS q FROM t GROUP BY i)
SELECT vec_id, CAST(i AS INT) AS i, {r("coalesce(x, q)")} AS x FROM t JOIN m USING (i)""")
def fill_quantile_wide(spark, sf):
    gaps = {c: F.when((F.col("vec_id") + i) % 5 != 0, F.col(c)) for i, c in enumerate(_E)}
    filled = ops.fill_quantile(vectors(spark, sf).withColumns(gaps), _E)
    cells = filled.select("vec_id", F.posexplode(F.array(*_E)).alias("i", "x"))
    return rounded(cells)
