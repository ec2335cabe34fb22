"""Aggregates, windows and encoders on hand-sized tables."""

import pytest
from pyspark.sql import functions as F

from helpers import plan, rows, same
from sparkfeat import operators as ops
from sparkfeat.operators import profile
from sparkfeat.plans import cards


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(
        [("a", None, 1), ("a", None, 1), (None, 1.0, 2), ("b", 2.0, 3), ("c", float("nan"), None), ("c", 4.0, 4)],
        "k string, x double, d int")


def test_profile_missing_values(sample):
    result = ops.entity_profile(sample, "k", {"x": ["sum", "mean", "std", "nunique", "count"], "d": ["nunique"]})
    assert rows(result, "k") == [
        ("a", 2, 0.0, None, None, 0, 0, 1), ("b", 1, 2.0, 2.0, None, 1, 1, 1), ("c", 2, 4.0, 4.0, None, 1, 1, 1)]
    assert result.columns == ["k", "transactions_count", "x_sum", "x_mean", "x_std", "x_nunique", "x_count", "d_nunique"]


def test_profile_of_only_distinct_counts(sample):
    result = ops.entity_profile(sample, "k", {"d": ["nunique"]}, count_name=None)
    assert rows(result, "k") == [("a", 1), ("b", 1), ("c", 1)]


def test_bit_mask_distinct_count(spark):
    df = spark.createDataFrame([("a", 1), ("a", 12), ("a", 1), ("b", None)], "k string, month int")
    assert rows(ops.entity_profile(df, "k", {"month": ["nunique"]}, None), "k") == [("a", 2), ("b", 0)]
    with pytest.raises(Exception, match="declared range"):
        ops.entity_profile(df, "k", {"month": ["nunique"]}, None, domains={"month": (1, 5)}).collect()


def test_profile_plan_has_no_extra_exchange_for_the_distinct_join(sample):
    text = plan(ops.entity_profile(sample, "k", {"x": ["mean", "nunique"], "d": ["nunique"]}))
    # One exchange for the plain aggregates, two for the distinct ones, none for the join.
    tree = text.split("\n\n")[0]
    assert tree.count("Exchange") - tree.count("BroadcastExchange") == 3


def test_approximate_distinct(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    assert abs(ops.distinct_profile(df, "k", ["v"], approximate=True).first()["v_nunique"] - 1000) < 100


def test_two_level(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), ("a", 2, 9.0), ("a", None, 50.0), ("b", 1, None)],
                               "k string, s int, x double")
    result = ops.two_level_profile(df, "k", "s", ["x"], ["sum", "count"], ["mean", "std"])
    got = rows(result, "k")
    assert got[0][1] == 7.5 and same(got[0][2], 2.1213203435596424) and got[0][3] == 1.5
    assert got[1] == ("b", 0.0, None, 0.0, None)


def test_successive_features_keep_the_first_pairs_keys(spark):
    df = spark.createDataFrame(
        [("a", 1, "x", 2.0), ("a", 1, "y", 4.0), ("a", 2, None, 9.0), ("b", None, "x", 5.0), ("c", 3, None, None)],
        "k string, f int, g string, v double")
    fused = rows(ops.successive_features(df, "k", [("f", "v"), ("g", "v"), ("f", "f")]), "k")
    # b has no value of the first field and is lost; c keeps its row without a mean.
    assert [r[0] for r in fused] == ["a", "c"]
    assert fused[0][1:5] == (6.0, 3.0, 9.0, fused[0][4]) and same(fused[0][4], 4.242640687119285)
    assert fused[0][5:8] == (3.0, 2.0, 4.0)
    assert fused[0][9:12] == (1.5, 1.0, 2.0)
    assert fused[1][1:9] == (None,) * 8
    alone = rows(ops.successive_aggregate(df, "k", "g", "v"), "k")
    assert alone[0] == fused[0][:1] + fused[0][5:9] and [r[0] for r in alone] == ["a", "b"]


def test_successive_features_scan_once_and_do_not_join(spark):
    df = spark.createDataFrame([("a", 1, 2, 3.0)], "k string, f int, g int, v double")
    text = plan(ops.successive_features(df, "k", [("f", "v"), ("g", "v")]))
    tree = text.split("\n\n")[0]
    assert "Join" not in tree and tree.count("Exchange") == 2 and tree.count("Scan") == 1


def test_value_counts_name_the_missing_level(spark):
    df = spark.createDataFrame([(1,), (None,), (1,), (2,)], "c int")
    assert [tuple(r) for r in ops.value_counts(df, "c").collect()] == [("1", 2), ("2", 1), ("nan", 1)]


def test_smoothed_mean_literal_and_weighted(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), (None, 8.0)], "k string, v double")
    prior = 4.0
    assert rows(ops.smoothed_group_mean(df, "k", "v"), "k") == [("a", (2 + prior) / 2), ("b", (3 + prior) / 1)]
    assert rows(ops.smoothed_group_mean(df, "k", "v", prior_weight=2), "k") == [
        ("a", (2 + prior * 2) / 4), ("b", (3 + prior * 2) / 3)]


def test_group_mean_leaves_null_categories_null(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, None, 9.0)], "i int, c string, v double")
    result = ops.with_group_mean(df, ["c"], "v")
    assert [r[3] for r in rows(result, "i")] == [2.0, 2.0, None]
    assert "Window" not in plan(result)


@pytest.mark.parametrize("options", [
    {"bounded_groups": True}, {}, {"group_limit": 2, "slices": 4}, {"group_limit": 1, "slices": 1},
])
def test_lag_ratio_and_difference(spark, options):
    df = spark.createDataFrame(
        [("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 0.0), ("a", 4, 5.0), ("b", 1, 7.0), ("b", 2, None), ("b", 3, 1.0),
         (None, 1, 1.0), (None, 2, 1.0)], "k string, o int, v double")
    ratio = ops.lag_ratio(df, "k", "o", "v", **options).select("k", "o", "v_ratio")
    assert rows(ratio, "k", "o") == [("a", 2, 0.5), ("a", 4, 0.0)]
    minus = ops.lag_difference(df, "k", "o", "v", **options).select("k", "o", "v_difference")
    assert rows(minus, "k", "o") == [("a", 2, -2.0), ("a", 3, 4.0), ("a", 4, -5.0)]


def test_sliced_lag_equals_the_window_on_one_hot_key(spark):
    df = spark.range(2_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("k"),
                                   F.col("id").alias("o"), F.xxhash64("id").alias("v"))
    window = ops.with_previous(df, "k", "o", "v", bounded_groups=True)
    cut = ops.with_previous(df, "k", "o", "v", group_limit=100, slices=9)
    assert rows(cut.select("o", "previous"), "o") == rows(window.select("o", "previous"), "o")


def test_sliced_lag_moves_rows_once(spark):
    """The rows are in their slices already: nothing but the broadcast of the carried rows is exchanged, and no table stays."""
    before = spark.catalog.listTables()
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"), F.col("id").alias("v"))
    cut = ops.with_previous(df, "k", "o", "v", group_limit=100, slices=9)
    tree = plan(cut, "simple")
    assert tree.count("Exchange") == tree.count("BroadcastExchange") == 1
    assert cut.where("previous = o - 2").count() == 998 and cut.where("previous IS NULL").count() == 2
    assert len(spark.catalog.listTables()) == len(before)



@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_factorize(spark, monkeypatch, limit):
    monkeypatch.setattr("sparkfeat.operators.ranking.running_total.__defaults__", (
        (), "before", limit, 3 if limit == 1 else None, None))
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b"), (5, "c")], "i int, c string")
    assert [r[2] for r in rows(ops.factorize(df, "c", "i"), "i")] == [0, -1, 1, 0, 2]


def test_bucket_rare(spark):
    values = ["x", "y", "x", None, "z", None, "y", "w"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    # x, y and the missing level stay; z and w become others.
    assert [r[2] for r in rows(ops.bucket_rare(df, "c", 2, "i"), "i")] == [0, 1, 0, 2, 3, 2, 1, 3]
    # A real level named like the bucket falls together with it.
    named = spark.createDataFrame(list(enumerate(["others", "z", "others", "y", "y"])), "i int, c string")
    assert [r[2] for r in rows(ops.bucket_rare(named, "c", 2, "i"), "i")] == [0, 0, 0, 1, 1]


def test_target_encoding_fallback_is_the_plain_mean_of_means(spark):
    df = spark.createDataFrame(
        [(1, "a", 1), (2, "a", 1), (3, "a", 0), (4, "b", 0), (5, "c", None), (6, None, None)], "i int, c string, y int")
    encoded = rows(ops.target_encode(df, "c", "y", "e").select("i", "e"), "i")
    fallback = (2 / 3 + 0.0) / 2
    assert [same(e, w) for (_, e), w in zip(encoded, [2 / 3] * 3 + [0.0, fallback, fallback])] == [True] * 6
    bare = rows(ops.target_encode(df, "c", "y", "e", fallback=False).select("i", "e"), "i")
    assert [e for _, e in bare][4:] == [None, None]


def test_mean_encode_fits_on_the_first_frame_only(spark):
    train = spark.createDataFrame([(1, "p", 1.0), (1, "q", 3.0), (2, "p", 5.0)], "f int, g string, m double")
    test = spark.createDataFrame([(1, "q"), (9, "p")], "f int, g string")
    first, second = ops.mean_encode(train, [test], ["f", "g"], ["m"])
    assert rows(first.select("f", "g", "f_m", "g_m"), "f", "g") == [(1, "p", 2.0, 3.0), (1, "q", 2.0, 3.0), (2, "p", 5.0, 3.0)]
    assert rows(second, "f") == [(1, "q", 2.0, 3.0), (9, "p", None, 3.0)]


def test_profile_spec_rules():
    spec = cards.profile_spec(["merchant_group_id", "category_4", "most_recent_sales_range", "merchant_profit3"])
    assert spec["merchant_group_id"] == ["nunique"]
    assert spec["category_4"] == spec["most_recent_sales_range"] == ["sum", "mean"]
    assert spec["merchant_profit3"] == ["sum", "mean", "max", "min", "std"]
    assert sum(len(v) for k, v in cards.BASE_SPEC.items()) == 52


def test_ratios_survive_zero_divisors(spark):
    row = {"month_lag_nunique": 2, "purchase_date_span": -1, "purchase_amount_sum": 6.0, "purchase_amount_mean": 3.0}
    for w in (3, 6, 12):
        row |= {f"active_months_lag{w}_mean": 0.0, f"merchant_profit{w}_mean": 0.0}
    df = spark.createDataFrame([row])
    out = ops.ratio_features(df).first()
    assert out["card_active_ratio"] is None  # -1 // 30 + 1 is 0
    assert out["card_merch_act_ratio3"] is None and out["energy_ratio6"] is None
    assert out["card_merch_gain_ratio12"] == 3.0 / 1e-15


SPEC = {"x": ["sum", "mean", "std", "nunique"], "f": ["nunique"], "g": ["nunique", "count"]}


def _by_key(df):
    return ops.by_whole_keys(df, "k", lambda part, together: ops.entity_profile(part, "k", SPEC, together=together).join(
        ops.successive_features(part, "k", [("f", "x"), ("g", "x"), ("f", "f")], together=together), "k", "left"))


def _plain_profile(df):
    return ops.entity_profile(df, "k", SPEC).join(
        ops.successive_features(df, "k", [("f", "x"), ("g", "x"), ("f", "f")]), "k", "left")


@pytest.mark.parametrize("most", [250_000, 40])
def test_rows_brought_together_by_key_give_the_same_profile(spark, monkeypatch, most):
    """With few rows for a task the largest keys are profiled apart."""
    monkeypatch.setattr(profile, "ROWS_IN_TASK", (20, most))
    df = spark.range(600).selectExpr(
        "if(id % 7 = 0, null, if(id < 300, 'hot', concat('k', id % 31))) AS k", "if(id % 5 = 0, null, id % 4) AS f",
        "if(id % 3 = 0, null, cast(id % 6 as string)) AS g", "if(id % 11 = 0, double('nan'), id / 8) AS x")
    got, want = rows(_by_key(df), "k"), rows(_plain_profile(df), "k")
    assert len(got) == len(want) == 32
    assert all(same(a, b) for mine, theirs in zip(got, want) for a, b in zip(mine, theirs))
    assert rows(_by_key(df.where("k is null")), "k") == []


def test_wide_aggregates_of_staged_rows_are_not_shuffled(spark):
    """One buffer for each row would be sent: keys have few rows, and a buffer is many times as long as a row."""
    import checks.groups as groups
    for query in (groups.entity_profile, groups.card_features):
        tree = plan(query(spark, "/root/testdata/sf0.001")).split("\n\n")[0]
        assert tree.count("Exchange") - tree.count("BroadcastExchange") == 0
