"""Row-level operators on hand-sized tables with nulls, ties and odd values."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import plan, rows, same
from sparkfeat import operators as ops
from sparkfeat.functions import contains_flag, days_between, epoch_seconds, first_parts, sku_family
from sparkfeat.sources import read_table, write_table


def test_csv_round_trip_infers_types(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b,c")], "k int, x double, s string")
    write_table(df, str(tmp_path / "t"))
    back = read_table(spark, str(tmp_path / "t"))
    assert [f.dataType.simpleString() for f in back.schema] == ["int", "double", "string"]
    assert rows(back, "k") == [(1, 2.5, "a"), (2, None, "b,c")]


def test_csv_with_schema_and_wildcard(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "k int, s string").coalesce(1).write.csv(str(tmp_path / "a"), header=True)
    back = read_table(spark, str(tmp_path / "*" / "*.csv"), "k string, s string")
    assert rows(back) == [("1", "x")]


def test_parquet_by_extension(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write_table(spark.range(3).toDF("k"), path)
    assert read_table(spark, path).count() == 3


def test_feature_columns_keep_order(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "b int, card_id int, a int, target int, outliers int")
    assert ops.feature_columns(df) == ["b", "a"]
    assert ops.select_supported(df, ["b", "a"], [False, True], keep=["card_id"]).columns == ["card_id", "a"]


def test_split_all_null(spark):
    df = spark.createDataFrame(
        [(1, None, None), (2, 1.0, None), (3, float("nan"), None), (4, None, "x")], "k int, a double, b string")
    complete, leftover = ops.split_all_null(df, ["a", "b"], ["k"])
    assert [r[0] for r in rows(complete, "k")] == [2, 4]
    assert rows(leftover, "k") == [(1,), (3,)]
    everything, rest = ops.split_all_null(df, [], ["k"])
    assert everything.count() == 0 and rest.count() == 4


def test_map_values_gives_null_outside_the_mapping(spark):
    df = spark.createDataFrame([("Y",), ("N",), ("Z",), (None,)], "f string")
    assert [r[0] for r in ops.map_values(df, ["f"], {"Y": 1, "N": 0}).collect()] == [1, 0, None, None]


def test_replace_and_patch(spark):
    df = spark.createDataFrame([(1, "PRO_"), (2, "PRO_X")], "k int, s string")
    assert rows(ops.replace_values(df, ["s"], {"PRO_": "PROF"}), "k") == [(1, "PROF"), (2, "PRO_X")]
    assert rows(ops.patch_value(df, "k", 2, "s", "new"), "k") == [(1, "PRO_"), (2, "new")]


def test_one_hot_with_null_level(spark):
    df = spark.createDataFrame([(1.0,), (None,), (9.0,)], "c double")
    out = ops.one_hot(df, "c", [1.0, 2.0])
    assert out.columns == ["c", "c_1.0", "c_2.0", "c_N"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 0, 0), (0, 0, 1), (0, 0, 0)]


def test_time_features_of_a_sunday_and_of_null(spark):
    df = spark.createDataFrame([("2024-01-07 05:30:00",), (None,), ("no date",)], "t string")
    result = [tuple(r)[1:] for r in ops.time_features(df, "t").collect()]
    assert result[0] == (2024, 1, 1, 6, 1, 5)
    assert result[1] == result[2] == (None, None, None, None, 0, None)


def test_days_are_floored(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-06' AS a, timestamp_ntz'2024-01-07 05:00:00' AS b, 3 AS lag")
    assert df.select(days_between(F.col("a"), F.col("b"))).first()[0] == -2
    assert ops.month_diff(df, "b", "lag", "2024-01-06").first()["month_diff"] == 2


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_seconds_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.25' AS a, timestamp_ntz'1969-12-31 23:59:59' AS b, "
                       "CAST(NULL AS timestamp_ntz) AS c")
        got = df.select(*[epoch_seconds(F.col(c)) for c in "abc"]).first()
        assert tuple(got) == (1710037800.25, -1.0, None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_narrowing_bounds_are_strict(spark):
    df = spark.createDataFrame(
        [(127, 126, 1, 2**63 - 1, 65504.0, float("inf"), None), (0, -127, 40000, 0, 0.0, 1.0, None)],
        "a int, b bigint, c int, d bigint, e double, f double, g double")
    narrowed = ops.narrow_types(df, float_columns="all")
    assert [f.dataType.simpleString() for f in narrowed.schema] == [
        "smallint", "tinyint", "int", "bigint", "float", "double", "double"]
    assert [f.dataType.simpleString() for f in ops.narrow_types(df, float_columns=["f"]).schema][4] == "double"
    report = {r["column"]: r for r in ops.narrowing_report(df).collect()}
    assert (report["b"]["old_bytes"], report["b"]["new_bytes"], report["b"]["saved_pct"]) == (16, 2, 87.5)


def test_narrowing_skips_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert ops.narrow_types(df, float_columns="all").schema["x"].dataType.simpleString() == "float"
    assert ops.narrow_types(df).schema["x"].dataType.simpleString() == "double"


STATS = [
    ((1.0, 2.0, 2.5, 7.0, 9.0, 20.0), (41.5, 1.0, 20.0, 41.5 / 6, 7.130334260514486, 1.5197288095800785,
                                       2.2829963762755447, 4.75)),
    ((3.0,) * 6, (18.0, 3.0, 3.0, 3.0, 0.0, 0.0, 0.0, 3.0)),
    ((1.0, None, 2.0, None, None, None), (3.0, 1.0, 2.0, 1.5, 0.7071067811865476, None, None, 1.5)),
    ((None,) * 6, (0.0, None, None, None, None, None, None, None)),
    ((1.0, 2.0, 4.0, None, float("nan"), None), (7.0, 1.0, 4.0, 7 / 3, math.sqrt(7 / 3), 0.9352195295828237,
                                                 None, 2.0)),
    ((5.0, None, None, None, None, None), (5.0, 5.0, 5.0, 5.0, None, None, None, 5.0)),
    ((0.1, 0.1, 0.1, 0.1, None, None), (0.4, 0.1, 0.1, 0.1, 0.0, 0.0, 0.0, 0.1)),
]


@pytest.mark.parametrize("narrow", [16, 2])
def test_row_statistics(spark, monkeypatch, narrow):
    monkeypatch.setattr("sparkfeat.operators.rowstats.NARROW", narrow)
    cols = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([(i, *cells) for i, (cells, _) in enumerate(STATS)],
                               "k int, " + ", ".join(f"{c} double" for c in cols))
    result = ops.row_statistics(df, cols)
    for row, (_, expected) in zip(rows(result.drop(*cols), "k"), STATS):
        assert all(same(a, e) for a, e in zip(row[1:], expected)), (row, expected)
    assert "Exchange" not in plan(result) and "EvalPython" not in plan(result)


def test_global_quantiles_pool_all_cells(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.5, 7.0), (9.0, 20.0)], "a double, b double")
    row = ops.with_global_quantiles(df, ["a", "b"]).first()
    assert [same(row[f"quan_{i}"], v) for i, v in enumerate([1.05, 1.25, 17.25, 19.45], 1)] == [True] * 4


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_exact_quantiles_match_the_built_in(spark, limit):
    df = spark.range(5_000).select(
        (F.xxhash64("id") / F.lit(1e12)).alias("x"), (F.col("id") % 7).alias("hot"),
        F.when(F.col("id") % 3 > 0, F.col("id") * F.col("id")).alias("y"), F.lit(None).cast("double").alias("none"))
    probs = [0.0, 0.01, 0.5, 0.731, 1.0]
    found = ops.exact_quantiles(df, ["x", "hot", "y", "none"], probs, group_limit=limit)
    for name in ("x", "hot", "y"):
        expected = df.select(F.percentile(name, probs)).first()[0]
        assert all(same(a, e) for a, e in zip(found[name], expected)), name
    assert found["none"] == [None] * 5


def test_exact_quantiles_recover_from_a_wrong_bracket(spark, monkeypatch):
    from sparkfeat.operators import quantiles
    monkeypatch.setattr(quantiles, "_merge", lambda intervals: [(-5.0, -4.0)])
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    assert quantiles.exact_quantiles(df, ["x"], [0.25, 0.5]) == {"x": [25.0, 50.0]}


def test_quantile_states_merge_and_are_kept(spark, tmp_path):
    """History and new rows: their merged states bracket the exact quantiles of both, without a sketch pass."""
    df = spark.range(20_000).select("id", (F.xxhash64("id") / F.lit(1e12)).alias("x"), (F.col("id") % 7).alias("hot"),
                                    F.lit(None).cast("double").alias("none"))
    columns, probs = ["x", "hot", "none"], [0.0, 0.01, 0.5, 0.731, 1.0]
    parts = [df.where("id < 15000"), df.where("id >= 15000 AND id < 19990"), df.where("id >= 19990")]
    for i, part in enumerate(parts):
        ops.quantile_state(part, columns).write.parquet(str(tmp_path / f"state{i}"))
    merged = ops.merge_quantile_states(*[spark.read.parquet(str(tmp_path / f"state{i}")) for i in range(3)]).cache()
    assert dict(map(tuple, merged.select("series", "n").collect())) == {"x": 20_000, "hot": 20_000}
    assert ops.exact_quantiles(df, columns, probs, state=merged) == ops.exact_quantiles(df, columns, probs)
    close = ops.exact_quantiles(df, columns, probs, state=merged, approximate=True)
    ranks = df.select(*[(F.count_if(F.col("x") <= v) / 20_000).alias(f"q{i}") for i, v in enumerate(close["x"])]).first()
    assert all(abs(r - p) < 0.004 for r, p in zip(ranks, probs)) and close["none"] == [None] * 5
    with pytest.raises(ValueError, match="other rows"):
        ops.exact_quantiles(parts[0], columns, probs, state=merged)
    with pytest.raises(ValueError, match="other rows"):
        ops.exact_quantiles(df.withColumn("none", F.lit(1.0)), columns, probs, state=merged)
    pooled = ops.quantile_state(df, ["x", "hot"], pooled=True)
    row = ops.with_global_quantiles(df, ["x", "hot"], state=pooled).first()
    assert row == ops.with_global_quantiles(df, ["x", "hot"]).first()
    holes = df.withColumn("x", F.when(F.col("id") % 5 > 0, F.col("x")))
    filled = ops.fill_quantile(holes, ["x"], state=ops.quantile_state(holes, ["x"])).where("id % 5 = 0").first()["x"]
    assert filled == ops.exact_quantiles(holes, ["x"], [0.5])["x"][0]


def test_approximate_quantile_is_close(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    assert abs(ops.exact_quantiles(df, ["x"], [0.5], approximate=True)["x"][0] - 500) <= 1


def test_fill_mean_and_quantile(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (2, None, 2), (3, float("nan"), 4), (4, 4.0, None)],
                               "k int, x double, n int")
    assert [r[1:] for r in rows(ops.fill_mean(df, ["x", "n"]), "k")] == [
        (1.0, 1.0), (2.5, 2.0), (2.5, 4.0), (4.0, 7 / 3)]
    assert [r[1:] for r in rows(ops.fill_quantile(df, ["x", "n"]), "k")] == [
        (1.0, 1.0), (2.5, 2.0), (2.5, 4.0), (4.0, 2.0)]
    empty = df.where("k = 2").select("k", "x")
    assert rows(ops.fill_quantile(ops.fill_mean(empty, ["x"]), ["x"])) == [(2, None)]


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("rs1_release_sec", "PRO_N", "LiOn"), ("single", "XSERVERX", "nimh"), ("a_b", "PRO", None), (None, None, "nan")],
        "branch string, sku string, battery string")
    out = df.select(first_parts(F.col("branch"), "_", 2), sku_family(F.col("sku")),
                    contains_flag(F.col("battery"), "li"))
    assert [tuple(r) for r in out.collect()] == [
        ("rs1_release", "PROF", 1), ("single", "SERVER", 0), ("a_b", "PRO", 0), (None, None, 0)]


def test_first_parts_takes_the_delimiter_literally(spark):
    df = spark.createDataFrame([("a.b.c",), ("a.b",)], "s string")
    assert [r[0] for r in df.select(first_parts(F.col("s"), ".", 5)).collect()] == ["a_b_c", "a_b"]


def test_version_number(spark):
    df = spark.createDataFrame([(1, "1.12.123"), (2, "2.3.4"), (3, "1.12"), (4, None), (5, "1.x.2")],
                               "k int, v string")
    # Longest segments are 1, 2 and 3 digits, so 4 becomes 04: three minus its own length.
    assert rows(ops.version_number(df, ["v"]), "k") == [
        (1, 112123.0), (2, 2304.0), (3, 112000.0), (4, None), (5, None)]
    assert rows(ops.version_number(df, ["v"], fixed_width=True), "k") == [
        (1, 112123.0), (2, 203004.0), (3, 112000.0), (4, None), (5, None)]


def test_lookup_keeps_rows_and_uses_the_default(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, c string")
    mapping = spark.createDataFrame([("a", 10), (None, 99)], "c string, v int")
    assert rows(ops.lookup(df, mapping, "c", "v", default=-1), "k") == [(1, "a", 10), (2, "b", -1), (3, None, -1)]
    assert rows(ops.lookup(df, mapping, "c", {"v": "w"}), "k") == [(1, "a", 10), (2, "b", None), (3, None, None)]


def test_lookup_broadcasts_only_small_mappings(spark, monkeypatch):
    df = spark.range(10).select(F.col("id").alias("k"))
    mapping = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    assert "BroadcastHashJoin" in plan(ops.lookup(df, mapping, "k", "v"))
    monkeypatch.setattr("sparkfeat.operators.lookups.BROADCAST_BYTES", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = ops.lookup(df, mapping, "k", "v")
        assert "BroadcastHashJoin" not in plan(large)
        assert large.where("v = 1").count() == 10
        holes = spark.range(100).select(F.col("id").alias("i"), F.when(F.col("id") < 5, F.col("id")).alias("k"))
        joined = ops.lookup(holes, mapping, "k", "v", default=0)
        # Rows without a key must not share one partition.
        assert "__spread" in plan(joined).split("Join")[1]
        assert rows(joined.select("i", "v"), "i") == [(i, int(i < 5)) for i in range(100)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
