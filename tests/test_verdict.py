"""Wide tables, small labels, standard CSV, exact names and intermediate files."""

import os
import urllib.parse

import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from sparkfeat import operators as ops
from sparkfeat import plans
from sparkfeat.operators.profile import CALENDAR_DOMAINS
from sparkfeat.sources import read_table, staging_root, staging_scope, write_table


@pytest.fixture(scope="module")
def wide(spark):
    """100 category columns of two levels over 12 rows, and a value."""
    cats = [f"c{i}" for i in range(100)]
    frame = spark.range(12).select(
        "id", (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"),
        *[((F.col("id") + i) % 2).alias(c) for i, c in enumerate(cats)])
    return frame.cache(), cats


def test_a_hundred_categories(wide):
    frame, cats = wide
    counts = ops.distinct_profile(frame, "k", cats).collect()
    assert len(counts) == 3 and all(r[f"{c}_nunique"] == 2 for r in counts for c in cats)
    means = ops.with_group_mean(frame, cats, "v").orderBy("id").first()
    assert [means["c0_mean"], means["c99_mean"]] == [5.0, 5.0]
    encoded = ops.mean_encode(frame, [], cats, ["v"])[0].orderBy("id").first()
    assert [encoded["c0_v"], encoded["c1_v"], encoded["c99_v"]] == [5.0, 5.0, 5.0]
    target = ops.target_encode_columns(frame, cats, "v").orderBy("id").collect()
    assert [target[0]["c98"], target[1]["c98"]] == [5.0, 6.0]


def test_five_hundred_columns_of_quantiles(spark):
    names = [f"q{i}" for i in range(500)]
    frame = spark.range(5).select("id", *[
        F.when((F.col("id") + i) % 5 != 0, (F.col("id") + i).cast("double")).alias(n) for i, n in enumerate(names)])
    filled = ops.fill_quantile(frame, names).orderBy("id").first()
    assert [filled["q0"], filled["q1"], filled["q499"]] == [2.5, 1.0, 499.0]


def test_calendar_names_are_just_names(spark):
    frame = spark.createDataFrame([(1, 201801, 1.2), (1, 201802, 1.7), (1, 201801, 1.2)], "k int, month int, hour double")
    spec = {"month": ["nunique"], "hour": ["nunique"]}
    assert rows(ops.entity_profile(frame, "k", spec, None)) == [(1, 2, 2)]
    with pytest.raises(ValueError, match="whole numbers"):
        ops.entity_profile(frame, "k", spec, None, domains=CALENDAR_DOMAINS)


def test_folds_of_small_labels(spark):
    many = spark.range(4000).select("id", (F.col("id") / 4).cast("int").alias("label"))
    sizes = [r["count"] for r in ops.stratified_folds(many, "label", "id", k=5).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 700
    single = spark.range(100).select("id", (F.col("id") * 1.5).alias("label"))
    sizes = [r["count"] for r in ops.stratified_folds(single, "label", "id", k=5).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 5


def test_standard_csv(spark, tmp_path):
    text = 'a,b\n"say ""hi"", ok"," lead\nsecond line "\n"back\\slash",trail  \n'
    (tmp_path / "t.csv").write_text(text)
    want = [("back\\slash", "trail  "), ('say "hi", ok', " lead\nsecond line ")]
    frame = read_table(spark, str(tmp_path / "t.csv"), "a string, b string")
    assert rows(frame, "a") == want
    write_table(frame, str(tmp_path / "out"))
    assert rows(read_table(spark, str(tmp_path / "out"), "a string, b string"), "a") == want


def test_names_with_dots_as_keys(spark):
    frame = spark.createDataFrame([(1, 2, 3.0), (1, 3, 5.0), (2, 2, 1.0)], "`k.k` int, `s.s` int, `v.v` double")
    assert rows(ops.entity_profile(frame, "k.k", {"v.v": ["sum", "nunique"]}), "k.k") == [(1, 2, 8.0, 2), (2, 1, 1.0, 1)]
    assert len(ops.two_level_profile(frame, "k.k", "s.s", ["v.v"], ["sum"], ["mean"]).collect()) == 2
    assert len(ops.successive_features(frame, "k.k", [("s.s", "v.v")]).collect()) == 2
    assert rows(ops.replace_values(frame, ["s.s"], {2: 9}).select("`s.s`"), "s.s") == [(3,), (9,), (9,)]


def test_overlapping_treatments_are_refused(spark):
    frame = spark.createDataFrame([(1, "a", 1)], "id int, suite string, y int")
    with pytest.raises(ValueError, match="suite"):
        plans.machine_features(frame, "id", "y", rare_thresholds={"suite": 1}, target_cols=["suite"])


def test_floats_are_narrowed_only_on_request(spark):
    frame = spark.createDataFrame([(1, 0.1)], "a bigint, b double")
    assert dict(ops.narrow_types(frame).dtypes) == {"a": "tinyint", "b": "double"}
    assert dict(ops.narrow_types(frame, float_columns="all").dtypes) == {"a": "tinyint", "b": "float"}


def _files(spark):
    root = urllib.parse.urlparse(staging_root(spark)).path
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_a_scope_leaves_no_files(spark):
    frame = spark.range(200).select(
        F.col("id"), (F.col("id") % 7).alias("k"), F.col("id").alias("o"), (F.col("id") % 13).cast("double").alias("v"),
        (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).alias("fold"), F.col("id").cast("string").alias("s"))
    before = _files(spark)
    with staging_scope(spark):
        with staging_scope(spark):
            ops.exact_auc(frame, "y", "v").collect()
        ops.lag_ratio(frame, "k", "o", "v", group_limit=10, slices=3).collect()
        ops.factorize(frame, "s", "o").collect()
        ops.bucket_rare(frame, "s", 2, "o").collect()
        ops.target_encode(frame, "k", "y").collect()
        ops.with_group_mean(frame, ["k"], "v").collect()
        ops.stratified_folds(frame.drop("fold"), "y", "id").collect()
        ops.smoothed_group_mean(frame, "k", "v").collect()
        ops.exact_quantiles(frame, ["v"], [0.5])
        plans.oof_predictions(frame, ["v"], "y", "fold", "id", {"maxIter": 1, "maxDepth": 2}).collect()
        assert _files(spark) != before
    assert _files(spark) == before


def test_a_local_session_keeps_its_checkpoint_folder(spark):
    folder = spark.sparkContext.getCheckpointDir()
    staging_root(spark)
    assert spark.sparkContext.getCheckpointDir() == folder


def test_shadows_of_several_rounds_come_from_one_pass(spark):
    frame = spark.range(50).select(F.col("id").alias("key"), (F.col("id") * 2).alias("a"), (F.col("id") * 3).alias("b"))
    one = ops.with_shadows(frame, ["a", "b"], "key")
    four = ops.with_shadows(frame, ["a", "b"], "key", copies=4)
    assert plan(four).count("Exchange hashpartitioning") == plan(one).count("Exchange hashpartitioning")
    got = four.collect()
    assert len(got) == 200 and {r["copy"] for r in got} == {1, 2, 3, 4}
    assert all(r["a"] == 2 * r["key"] and r["b"] == 3 * r["key"] for r in got)
    for copy in range(1, 5):
        mine = [r for r in got if r["copy"] == copy]
        assert sorted(r["shadow_a"] for r in mine) == [2 * i for i in range(50)]
        assert sum(r["shadow_a"] == r["a"] for r in mine) < 15
    assert len({tuple(r["shadow_a"] for r in sorted(got, key=lambda r: r["key"]) if r["copy"] == c) for c in range(1, 5)}) == 4


def test_large_null_key_lookup(spark):
    frame = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("k"))
    mapping = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k bigint, name string")
    small, large = (rows(ops.lookup(frame, mapping, "k", "name", default="-", small=s).select("id", "name"), "id") for s in (True, False))
    assert small == large
