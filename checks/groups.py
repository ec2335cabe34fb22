"""Aggregates by entity, windows and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import (
    AS_OF, LABELLED_SQL, MONTHLY_SQL, TXN_SQL, labelled_documents, monthly_amounts, r, rounded, table, txn,
)
from sparkfeat import operators as ops
from sparkfeat import plans
from sparkfeat.plans import cards
from sparkfeat.sources import stage

QUERIES, ORACLES = {}, {}


def check(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


MERCHANT_COLS = ["merchant_group_id", "category_4", "merchant_profit3", "merchant_profit6", "merchant_profit12",
                 "active_months_lag3", "active_months_lag6", "active_months_lag12"]
DISTINCT_COLS = ["hour", "weekofyear", "dayofweek", "year", "subsector_id", "merchant_id"]

# -- the SQL side of a card profile -------------------------------------------------------

_LEVELS = [("category_2_1.0", "category_2 = 1"), ("category_2_2.0", "category_2 = 2"),
           ("category_2_3.0", "category_2 = 3"), ("category_2_4.0", "category_2 = 4"),
           ("category_2_5.0", "category_2 = 5"), ("category_2_N", "category_2 IS NULL"),
           ("category_3_A", "category_3 = 'A'"), ("category_3_B", "category_3 = 'B'"),
           ("category_3_C", "category_3 = 'C'"), ("category_3_N", "category_3 IS NULL")]

ROWS_SQL = f"""
SELECT t.*, CAST(year(purchase_date) AS INT) AS year, CAST(week(purchase_date) AS INT) AS weekofyear,
 CAST(month(purchase_date) AS INT) AS month, CAST(isodow(purchase_date) - 1 AS INT) AS dayofweek,
 CASE WHEN isodow(purchase_date) >= 6 THEN 1 ELSE 0 END AS weekend, CAST(hour(purchase_date) AS INT) AS hour,
 CAST(floor(floor((1009843200 - epoch(purchase_date)) / 86400) / 30) + month_lag AS INT) AS month_diff,
 {', '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END AS "{n}"' for n, c in _LEVELS)},
 {', '.join(f"CASE WHEN {c} IS NOT NULL THEN avg(purchase_amount) OVER (PARTITION BY {c}) END AS {c}_mean"
            for c in ("category_1", "category_2", "category_3", "category_4"))}
FROM ({TXN_SQL}) t"""


def _sql_aggregate(name: str, how: str) -> str:
    col = f'"{name}"'
    if name == "purchase_date":
        return f"{how}({col})"
    return {
        "sum": r(f"coalesce(sum({col}), 0)"), "mean": r(f"avg({col})"), "max": r(f"max({col})"),
        "min": r(f"min({col})"), "std": r(f"stddev_samp({col})"),
        "nunique": f"CAST(count(DISTINCT {col}) AS BIGINT)", "count": f"CAST(count({col}) AS BIGINT)",
    }[how]


# The statistics of each column, written out apart from the library's own spec, so
# that one checks the other.
_M5 = ["sum", "mean", "max", "min", "std"]
_PROFILE = [
    ("category_1", ["sum", "mean"]),
    *[(n, ["mean", "sum"]) for n, _ in _LEVELS],
    ("state_id", ["nunique"]),
    ("city_id", ["nunique"]),
    ("purchase_amount", _M5),
    ("installments", _M5),
    ("month", ["mean", "max", "min", "std", "nunique"]),
    ("purchase_date", ["min", "max"]),
    ("month_lag", ["nunique", "mean", "max", "min", "std"]),
    ("month_diff", ["mean", "max", "min", "std"]),
    ("weekend", ["sum", "mean"]),
    ("merchant_group_id", ["nunique"]),
    ("category_4", ["sum", "mean"]),
    ("merchant_profit3", _M5),
    ("merchant_profit6", _M5),
    ("merchant_profit12", _M5),
    ("active_months_lag3", _M5),
    ("active_months_lag6", _M5),
    ("active_months_lag12", _M5),
    *[(c, ["nunique"]) for c in DISTINCT_COLS],
    *[(f"category_{i}_mean", ["mean", "max", "min", "std"]) for i in (1, 2, 3, 4)],
]
_OUTPUTS = [(f"{c}_{how}", c, how) for c, hows in _PROFILE for how in hows]
PROFILE_SQL = f"""
SELECT card_id, CAST(count(*) AS BIGINT) AS transactions_count,
 {', '.join(f'{_sql_aggregate(c, how)} AS "{out}"' for out, c, how in _OUTPUTS)}
FROM ({ROWS_SQL}) GROUP BY card_id"""


def _plain(df):
    """Aggregates as rounded doubles, like the SQL side; counts and keys as they are."""
    whole = {"card_id", "transactions_count"}
    casts = {f.name: F.col(f"`{f.name}`").cast("double") for f in df.schema.fields
             if f.dataType.typeName() in ("integer", "long") and f.name not in whole
             and not f.name.endswith(("_nunique", "_count", "_span", "_uptonow_max", "_uptonow_min"))}
    return rounded(df.withColumns(casts))


def rows(spark, sf):
    return cards.transaction_rows(txn(spark, sf), AS_OF, flags=["authorized_flag"])


@check("entity_profile", PROFILE_SQL)
def entity_profile(spark, sf):
    with_means = ops.with_group_mean(stage(rows(spark, sf)), cards.CATEGORIES, "purchase_amount")
    spec = cards.profile_spec(MERCHANT_COLS, DISTINCT_COLS)
    return _plain(ops.by_whole_keys(with_means, "card_id", lambda part, together: ops.entity_profile(
        part, "card_id", spec, together=together)))


@check("distinct_profile", f"""
SELECT card_id, count(DISTINCT merchant_id) AS merchant_id_nunique, count(DISTINCT month_lag) AS month_lag_nunique,
 count(DISTINCT category_3) AS category_3_nunique, count(DISTINCT installments) AS installments_nunique
FROM ({TXN_SQL}) GROUP BY card_id""")
def distinct_profile(spark, sf):
    return ops.distinct_profile(txn(spark, sf), "card_id", ["merchant_id", "month_lag", "category_3", "installments"])


_RAW_DATES_SQL = f"""
SELECT card_id, CAST(count(*) AS BIGINT) AS transactions_count, min(purchase_date) AS lo, max(purchase_date) AS hi
FROM ({TXN_SQL}) GROUP BY card_id"""
_RECENCY = """CAST(floor((epoch(hi) - epoch(lo)) / 86400) AS INT)"""


@check("recency_features", f"""
SELECT card_id, transactions_count, {r('epoch(lo)')} AS purchase_date_min, {r('epoch(hi)')} AS purchase_date_max,
 {_RECENCY} AS purchase_date_span, {r(f'{_RECENCY} / transactions_count')} AS purchase_date_avg_span,
 CAST(floor((1009843200 - epoch(hi)) / 86400) AS INT) AS purchase_date_uptonow_max,
 CAST(floor((1009843200 - epoch(lo)) / 86400) AS INT) AS purchase_date_uptonow_min FROM ({_RAW_DATES_SQL})""")
def recency_features(spark, sf):
    profile = ops.entity_profile(txn(spark, sf), "card_id", {"purchase_date": ["min", "max"]})
    return rounded(ops.recency_features(profile, AS_OF))


def _ratio_columns() -> str:
    parts = [f"{r('amt / NULLIF(months, 0)')} AS avg_purchase_amount_per_act_month",
             f"{r('months / NULLIF(floor(span / 30) + 1, 0)')} AS card_active_ratio"]
    for w in (3, 6, 12):
        active = "(months / NULLIF(floor(span / 30) + 1, 0))"
        parts += [
            f"{r(f'act{w} / {w}')} AS merchant_active_ratio{w}",
            f"{r(f'{active} / NULLIF(act{w} / {w}, 0)')} AS card_merch_act_ratio{w}",
            f"{r(f'(amt / NULLIF(months, 0)) / NULLIF(pro{w} + 1e-15, 0)')} AS card_merch_gain_ratio{w}",
            f"{r(f'mean_amt / NULLIF(pro{w} + 1e-15, 0)')} AS card_merch_biasgain_ratio{w}",
            f"{r(f'months / NULLIF(act{w}, 0)')} AS energy_ratio{w}"]
    return ", ".join(parts)


@check("ratio_features", f"""
WITH a AS (SELECT card_id, sum(purchase_amount) AS amt, avg(purchase_amount) AS mean_amt,
 CAST(count(DISTINCT month_lag) AS DOUBLE) AS months,
 floor((epoch(max(purchase_date)) - epoch(min(purchase_date))) / 86400) AS span,
 {', '.join(f'avg(active_months_lag{w}) AS act{w}, avg(merchant_profit{w}) AS pro{w}' for w in (3, 6, 12))}
FROM ({TXN_SQL}) GROUP BY card_id)
SELECT card_id, {_ratio_columns()} FROM a""")
def ratio_features(spark, sf):
    spec = {"purchase_amount": ["sum", "mean"], "month_lag": ["nunique"], "purchase_date": ["min", "max"]}
    for w in (3, 6, 12):
        spec |= {f"active_months_lag{w}": ["mean"], f"merchant_profit{w}": ["mean"]}
    profile = ops.entity_profile(txn(spark, sf), "card_id", spec)
    full = ops.ratio_features(ops.recency_features(profile, AS_OF))
    ratios = [c for c in full.columns if "ratio" in c or c.startswith("avg_purchase")]
    return rounded(full.select("card_id", *ratios))


_INNER, _OUTER = ["count", "sum", "mean", "min", "max", "std"], ["mean", "std"]


def _two_level_sql(source: str) -> str:
    first = ", ".join(
        f"{fn} AS {m}_{how}" for m in ("purchase_amount", "installments") for how, fn in (
            ("count", f"count({m})"), ("sum", f"coalesce(sum({m}), 0)"), ("mean", f"avg({m})"),
            ("min", f"min({m})"), ("max", f"max({m})"), ("std", f"stddev_samp({m})")))
    second = ", ".join(
        f"{r(f'{fn}({m}_{how})')} AS {m}_{how}_{out}" for m in ("purchase_amount", "installments")
        for how in _INNER for out, fn in (("mean", "avg"), ("std", "stddev_samp")))
    return (f"SELECT card_id, {second} FROM (SELECT card_id, month_lag, {first} FROM ({source}) "
            f"GROUP BY card_id, month_lag) GROUP BY card_id")


MONTHLY_PROFILE_SQL = _two_level_sql(TXN_SQL)


@check("monthly_profile", MONTHLY_PROFILE_SQL)
def monthly_profile(spark, sf):
    return rounded(cards.monthly_profile(txn(spark, sf)))


def _successive_sql(f1: str, f2: str) -> str:
    return (f"SELECT card_id, {r('avg(m)')} AS {f1}_{f2}_mean, {r('min(m)')} AS {f1}_{f2}_min, "
            f"{r('max(m)')} AS {f1}_{f2}_max, {r('stddev_samp(m)')} AS {f1}_{f2}_std FROM ("
            f"SELECT card_id, {f1}, avg({f2}) AS m FROM t WHERE {f1} IS NOT NULL GROUP BY card_id, {f1}) GROUP BY card_id")


@check("successive_aggregate", f"WITH t AS ({TXN_SQL}) {_successive_sql('merchant_id', 'purchase_amount')}")
def successive_aggregate(spark, sf):
    return rounded(ops.successive_aggregate(txn(spark, sf), "card_id", "merchant_id", "purchase_amount"))


# The pairs, written out apart from the library's.
_PAIRS = [
    ("category_1", "purchase_amount"),
    ("category_2", "purchase_amount"),
    ("category_3", "purchase_amount"),
    ("installments", "purchase_amount"),
    ("city_id", "purchase_amount"),
    ("category_1", "installments"),
    ("category_2", "installments"),
    ("category_3", "installments"),
    ("category_2", "merchant_profit3"),
    ("category_2", "merchant_profit6"),
    ("category_2", "merchant_profit12"),
    ("category_4", "merchant_profit3"),
    ("category_4", "merchant_profit6"),
    ("category_4", "merchant_profit12"),
]
_SUCCESSIVE_JOIN = "(" + _successive_sql(*_PAIRS[0]) + ") s0" + "".join(
    f" LEFT JOIN ({_successive_sql(*p)}) s{i} USING (card_id)" for i, p in enumerate(_PAIRS) if i)
SUCCESSIVE_SQL = f"WITH t AS ({TXN_SQL}) SELECT * FROM {_SUCCESSIVE_JOIN}"


@check("successive_features", SUCCESSIVE_SQL)
def successive_features(spark, sf):
    return rounded(ops.successive_features(txn(spark, sf), "card_id", cards.SUCCESSIVE_PAIRS))


_CARDS = """
SELECT c_custkey AS card_id, c_nationkey % 5 AS feature_1, c_mktsegment AS feature_2, c_custkey % 2 AS feature_3,
 CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS outliers FROM {customer}"""


@check("card_mix", f"""
WITH h AS (SELECT card_id, avg(purchase_amount) AS m, count(*) AS n FROM ({TXN_SQL}) GROUP BY card_id),
c AS (SELECT c.*, h.m, h.n FROM ({_CARDS.format(customer='customer')}) c LEFT JOIN h USING (card_id)),
t AS (SELECT * FROM c WHERE card_id % 4 <> 0)
SELECT card_id, CAST(n AS BIGINT) AS hist_transactions_count, {r('m')} AS hist_purchase_amount_mean,
 {', '.join(f'{r(f"(SELECT avg(outliers) FROM t WHERE t.feature_{i} = c.feature_{i})")} AS feature_{i}_outliers, '
            f'{r(f"(SELECT avg(m) FROM t WHERE t.feature_{i} = c.feature_{i})")} AS feature_{i}_hist_purchase_amount_mean'
            for i in (1, 2, 3))} FROM c""")
def card_mix(spark, sf):
    """From transactions over a prefixed profile, joined to the cards, to mixed features of train and test."""
    history = cards.card_features(txn(spark, sf), MERCHANT_COLS, AS_OF, ["authorized_flag"], DISTINCT_COLS,
                                  stage_rows=True, prefix="hist_")
    wanted = history.select("card_id", "hist_transactions_count", "hist_purchase_amount_mean")
    table_of_cards = stage(spark.sql(_CARDS, customer=table(spark, sf, "customer")).join(wanted, "card_id", "left"))
    train, test = cards.mix_features(table_of_cards.where("card_id % 4 != 0"), table_of_cards.where("card_id % 4 = 0"))
    features = [f"feature_{i}_{mix}" for i in (1, 2, 3) for mix in cards.MIXES]
    return rounded(train.unionByName(test).select("card_id", "hist_transactions_count", "hist_purchase_amount_mean", *features))


@check("card_features", f"""
WITH t AS ({TXN_SQL}), p AS ({PROFILE_SQL}), m AS ({MONTHLY_PROFILE_SQL}), s AS (SELECT * FROM {_SUCCESSIVE_JOIN}),
a AS (SELECT card_id, count(*) AS n, epoch(min(purchase_date)) AS lo, epoch(max(purchase_date)) AS hi,
 sum(purchase_amount) AS amt, avg(purchase_amount) AS mean_amt, CAST(count(DISTINCT month_lag) AS DOUBLE) AS months,
 floor((epoch(max(purchase_date)) - epoch(min(purchase_date))) / 86400) AS span,
 {', '.join(f'avg(active_months_lag{w}) AS act{w}, avg(merchant_profit{w}) AS pro{w}' for w in (3, 6, 12))}
FROM t GROUP BY card_id),
x AS (SELECT card_id, {r('lo')} AS purchase_date_min, {r('hi')} AS purchase_date_max, CAST(span AS INT) AS purchase_date_span,
 {r('span / n')} AS purchase_date_avg_span, CAST(floor((1009843200 - hi) / 86400) AS INT) AS purchase_date_uptonow_max,
 CAST(floor((1009843200 - lo) / 86400) AS INT) AS purchase_date_uptonow_min, {_ratio_columns()} FROM a)
SELECT * FROM (SELECT * EXCLUDE (purchase_date_min, purchase_date_max) FROM p) JOIN x USING (card_id)
 LEFT JOIN m USING (card_id) LEFT JOIN s USING (card_id)""")
def card_features(spark, sf):
    return _plain(cards.card_features(txn(spark, sf), MERCHANT_COLS, AS_OF, ["authorized_flag"], DISTINCT_COLS,
                                      stage_rows=True))


@check("value_counts", 'SELECT props, count(*) AS "count" FROM events GROUP BY props')
def value_counts(spark, sf):
    return ops.value_counts(table(spark, sf, "events"), "props")


def _prior_sql(formula: str) -> str:
    return (f"WITH t AS ({TXN_SQL}), g AS (SELECT avg(purchase_amount) AS g FROM t) "
            f"SELECT state_id, {r(formula)} AS purchase_amount_smoothed FROM t, g GROUP BY state_id, g")


@check("group_mean_prior", _prior_sql("(avg(purchase_amount) * count(*) + g) / count(*)"))
def group_mean_prior(spark, sf):
    return rounded(ops.smoothed_group_mean(txn(spark, sf), "state_id", "purchase_amount"))


@check("group_mean_prior_weighted", _prior_sql("(avg(purchase_amount) * count(*) + g * 100) / (count(*) + 100)"))
def group_mean_prior_weighted(spark, sf):
    return rounded(ops.smoothed_group_mean(txn(spark, sf), "state_id", "purchase_amount", prior_weight=100))


@check("group_transform_mean", f"""
SELECT txn_id, {', '.join(f"{r(f'CASE WHEN {c} IS NOT NULL THEN avg(purchase_amount) OVER (PARTITION BY {c}) END')} AS {c}_mean"
                          for c in ("category_1", "category_2", "category_3", "category_4"))} FROM ({TXN_SQL})""")
def group_transform_mean(spark, sf):
    result = ops.with_group_mean(txn(spark, sf), cards.CATEGORIES, "purchase_amount")
    return rounded(result.select("txn_id", *[f"{c}_mean" for c in cards.CATEGORIES]))


_LAG = "lag(purchase_amount) OVER (PARTITION BY card_id ORDER BY month_lag)"


@check("lag_ratio", f"""
SELECT card_id, month_lag, {r('q')} AS purchase_ratio FROM (
 SELECT card_id, month_lag, {_LAG} / NULLIF(purchase_amount, 0) AS q FROM ({MONTHLY_SQL})) WHERE q IS NOT NULL""")
def lag_ratio(spark, sf):
    result = cards.purchase_ratio(txn(spark, sf))
    return rounded(result.select("card_id", "month_lag", "purchase_ratio"))


@check("lag_difference", f"""
SELECT card_id, month_lag, {r('q')} AS purchase_change FROM (
 SELECT card_id, month_lag, {_LAG} - purchase_amount AS q FROM ({MONTHLY_SQL})) WHERE q IS NOT NULL""")
def lag_difference(spark, sf):
    result = ops.lag_difference(monthly_amounts(spark, sf), "card_id", "month_lag", "purchase_amount",
                                "purchase_change", bounded_groups=True)
    return rounded(result.select("card_id", "month_lag", "purchase_change"))


@check("lag_ratio_hot_keys", f"""
SELECT event_id, {r('q')} AS value_ratio FROM (
 SELECT event_id, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) / NULLIF(value, 0) AS q FROM events)
WHERE q IS NOT NULL""")
def lag_ratio_hot_keys(spark, sf):
    """Five event types, each a fifth of the table: too large for one task each at scale."""
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    result = ops.lag_ratio(events, "event_type", "event_id", "value", group_limit=1_000, slices=8)
    return rounded(result.select("event_id", "value_ratio"))


@check("factorize", f"""
WITH t AS ({TXN_SQL}), f AS (SELECT category_3 AS c, min(txn_id) AS m FROM t WHERE category_3 IS NOT NULL GROUP BY category_3),
n AS (SELECT c, CAST(row_number() OVER (ORDER BY m, c) - 1 AS INT) AS code FROM f)
SELECT txn_id, coalesce(code, -1) AS category_3_code FROM t LEFT JOIN n ON category_3 = c""")
def factorize(spark, sf):
    return ops.factorize(txn(spark, sf), "category_3", "txn_id").select("txn_id", "category_3_code")


def _rare_sql(relation: str, col: str, key: str, share: int) -> str:
    return f"""
WITH l AS (SELECT {key} AS k, coalesce(CAST({col} AS VARCHAR), 'nan') AS v FROM {relation}),
c AS (SELECT v, CASE WHEN count(*) < (SELECT count(*) // {share} FROM l) THEN 'others' ELSE v END AS b, min(k) AS m FROM l GROUP BY v),
g AS (SELECT b, row_number() OVER (ORDER BY min(m), b) - 1 AS code FROM c GROUP BY b)
SELECT k AS {key}, CAST(code AS INT) AS {col}_code FROM l JOIN c USING (v) JOIN g USING (b)"""


@check("bucket_rare", _rare_sql("events", "props", "event_id", 100))  # a hundredth of the rows
def bucket_rare(spark, sf):
    events = table(spark, sf, "events")
    return ops.bucket_rare(events, "props", events.count() // 100, "event_id").select("event_id", "props_code")


@check("bucket_rare_null_level", _rare_sql(f"({TXN_SQL})", "installments", "txn_id", 7))
def bucket_rare_null_level(spark, sf):
    rows = txn(spark, sf).select("txn_id", "installments")
    return ops.bucket_rare(rows, "installments", rows.count() // 7, "txn_id").select("txn_id", "installments_code")


# Documents of the fixtures' last source are treated as never labelled, so that a category
# without a mean exists.
_UNSEEN = "source = (SELECT max(source) FROM documents)"
_TARGET_SQL = f"""
WITH t AS (SELECT doc_id, source, CASE WHEN {_UNSEEN} THEN NULL ELSE quality END AS quality FROM ({LABELLED_SQL})),
m AS (SELECT source, avg(quality) AS m FROM t WHERE quality IS NOT NULL GROUP BY source)
SELECT doc_id, {{value}} AS source_mean FROM t LEFT JOIN m USING (source)"""


def _half_labelled(spark, sf):
    documents = labelled_documents(spark, sf)
    last = documents.agg(F.max("source")).scalar()
    return documents.withColumn("quality", F.when(F.col("source") != last, F.col("quality")))


@check("target_encode", _TARGET_SQL.format(value=r("coalesce(m, (SELECT avg(m) FROM m))")))
def target_encode(spark, sf):
    result = ops.target_encode(_half_labelled(spark, sf), "source", "quality", "source_mean")
    return rounded(result.select("doc_id", "source_mean"))


@check("target_encode_nofallback", _TARGET_SQL.format(value=r("m")))
def target_encode_nofallback(spark, sf):
    result = ops.target_encode(_half_labelled(spark, sf), "source", "quality", "source_mean", fallback=False)
    return rounded(result.select("doc_id", "source_mean"))


@check("mean_encode", f"""
WITH tr AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0),
a AS (SELECT o_orderpriority, avg(o_totalprice) AS m1, avg(o_custkey) AS m2 FROM tr GROUP BY o_orderpriority),
b AS (SELECT o_orderstatus, avg(o_totalprice) AS m1, avg(o_custkey) AS m2 FROM tr GROUP BY o_orderstatus)
SELECT o_orderkey, {r('a.m1')} AS o_orderpriority_o_totalprice, {r('a.m2')} AS o_orderpriority_o_custkey,
 {r('b.m1')} AS o_orderstatus_o_totalprice, {r('b.m2')} AS o_orderstatus_o_custkey
FROM orders LEFT JOIN a USING (o_orderpriority) LEFT JOIN b USING (o_orderstatus)""")
def mean_encode(spark, sf):
    orders = table(spark, sf, "orders")
    train, test = orders.where("o_orderkey % 5 <> 0"), orders.where("o_orderkey % 5 = 0")
    cols, mixes = ["o_orderpriority", "o_orderstatus"], ["o_totalprice", "o_custkey"]
    parts = ops.mean_encode(train, [test], cols, mixes)
    names = [f"{c}_{m}" for c in cols for m in mixes]
    return rounded(parts[0].unionByName(parts[1]).select("o_orderkey", *names))


# A parts table in the shape of the machine table: text to clean, gaps, rare levels, versions.
_MACHINES = """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey % 3 = 0 AS INT) END AS detected,
 concat_ws('_', lower(p_type), p_size, p_partkey % 5) AS branch,
 CASE WHEN p_partkey % 6 = 0 THEN concat('X_SERVER_', p_type) ELSE upper(p_type) END AS sku, p_name AS battery,
 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS price,
 CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS size, p_name AS suite,
 concat_ws('.', p_partkey % 3 + 1, p_size, p_partkey) AS version, p_brand AS brand FROM {part}"""


@check("machine_features", f"""
WITH t AS ({_MACHINES.format(part='part')}),
c AS (SELECT suite, count(*) AS n, min(p_partkey) AS m FROM t GROUP BY suite),
g AS (SELECT CASE WHEN n < (SELECT count(*) * 31 // 2000 FROM t) THEN 'others' ELSE suite END AS kept, min(m) AS m FROM c GROUP BY 1),
code AS (SELECT kept, CAST(row_number() OVER (ORDER BY m, kept) - 1 AS INT) AS code FROM g),
v AS (SELECT p_partkey, string_split(version, '.') AS s FROM t),
w AS (SELECT max(length(s[1])) AS m1, max(length(s[2])) AS m2, max(length(s[3])) AS m3 FROM v),
b AS (SELECT brand, avg(detected) AS m FROM t WHERE detected IS NOT NULL GROUP BY brand)
SELECT t.p_partkey, detected,
 array_to_string(list_slice(string_split(branch, '_'), 1, 2), '_') AS branch,
 CASE WHEN contains(sku, 'SERVER') THEN 'SERVER' WHEN substr(sku, 1, 4) = 'PRO_' THEN 'PROF' ELSE substr(sku, 1, 4) END AS sku,
 CASE WHEN contains(lower(battery), 'li') THEN 1 ELSE 0 END AS battery,
 {r("coalesce(price, (SELECT avg(price) FROM t))")} AS price,
 {r("coalesce(size, (SELECT quantile_cont(CAST(size AS DOUBLE), 0.5) FROM t))")} AS size, code AS suite,
 {r("CAST(" + " || ".join(f"lpad(s[{i}], greatest(length(s[{i}]), m{i} - length(s[{i}]))::INT, '0')" for i in (1, 2, 3)) + " AS DOUBLE)")} AS version,
 {r("coalesce(b.m, (SELECT avg(m) FROM b))")} AS brand
FROM t JOIN c USING (suite) JOIN code ON kept = CASE WHEN n < (SELECT count(*) * 31 // 2000 FROM t) THEN 'others' ELSE suite END
 JOIN v ON v.p_partkey = t.p_partkey CROSS JOIN w LEFT JOIN b ON b.brand = t.brand""")
def machine_features(spark, sf):
    machines = spark.sql(_MACHINES, part=table(spark, sf, "part"))
    return rounded(plans.machine_features(
        machines, "p_partkey", "detected", branch_cols=["branch"], sku_cols=["sku"], battery_cols=["battery"],
        mean_cols=["price"], median_cols=["size"], rare_thresholds={"suite": machines.count() * 31 // 2000}, version_cols=["version"],
        target_cols=["brand"]))
