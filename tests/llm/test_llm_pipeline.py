"""The pipeline and the queries on the smallest tables, against plain versions."""

import collections
import hashlib

import numpy as np
import pytest

import corpus_pipeline
from checks.compare import differences, duckdb_connection
from conftest import SMALL
from sparkfeat.llm import near_dedup, quality, queries
from test_llm_small import brute_repeats, brute_windows


@pytest.fixture(scope="module")
def connection():
    return duckdb_connection(SMALL)


@pytest.fixture(scope="module")
def documents(connection):
    return connection.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def test_stage_names_and_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "benchmark", "tokens"]
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 13


def test_exact_dedup_query(spark, connection):
    assert differences(queries.op7_exact_dedup(spark, SMALL), connection, queries.ORACLES["op7_exact_dedup"]) is None


def test_repeats_query(spark, documents):
    got = queries.op10_repeats(spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(documents)


def test_benchmark_query(spark, connection, documents):
    items = connection.execute("SELECT item_id, text FROM benchmark").fetchall()
    got = queries.op6_decontaminate(spark, SMALL).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == brute_windows(documents, items)


def _near_classes(rows):
    shingler = near_dedup.Shingler()
    sets = [shingler.shingles(shingler.words(t)) for _, t in rows]
    having = collections.defaultdict(list)
    for i, (values, _) in enumerate(sets):
        for v in values.tolist():
            having[v].append(i)
    pairs = {(a, b) for held in having.values() for k, a in enumerate(held) for b in held[k + 1:]}
    forest = near_dedup._Forest(len(rows))
    for a, b in pairs:
        both = np.union1d(sets[a][0], sets[b][0])
        x, y = np.zeros(len(both)), np.zeros(len(both))
        x[np.searchsorted(both, sets[a][0])], y[np.searchsorted(both, sets[b][0])] = sets[a][1], sets[b][1]
        if near_dedup.probability_jaccard(x, y) >= 0.8:
            forest.join(a, b)
    for i in range(len(rows)):  # texts without words are one text
        if not len(sets[i][0]):
            forest.join(i, next(j for j in range(len(rows)) if not len(sets[j][0])))
    return [forest.find(i) for i in range(len(rows))]


def test_pipeline_equals_a_plain_version(spark, connection, documents):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    weights = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(docs, weights).where("score >= 0.3").collect()}
    rows = [r for r in documents if r[0] in good]
    last = {}
    for i, t in rows:
        last[(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))] = i
    rows = [r for r in rows if r[0] in set(last.values())]
    first = {}
    for (i, _), c in zip(rows, _near_classes(rows), strict=True):
        first.setdefault(c, i)
    rows = [r for r in rows if r[0] in set(first.values())]
    dirty = {w[0] for w in brute_windows(rows, connection.execute("SELECT item_id, text FROM benchmark").fetchall()) if w[5]}
    library = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    want = []
    for i, t in rows:
        if i not in dirty:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert 0 < len(want) < len(documents)


def test_stages_stand_odd_rows(spark):
    from test_llm_small import odd, table
    docs = table(spark, odd()).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    for frame in (docs, docs.where("false")):
        for name, function in corpus_pipeline.STAGES:
            out = function(spark, frame, SMALL)
            out.collect()
            if name != "tokens":
                assert out.columns == corpus_pipeline.COLUMNS


def test_dedup_stages_keep_rows_not_ids(spark):
    from test_llm_small import table
    long = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcd"]
    rows = [(None, long[0]), (1, long[1]), (1, long[1]), (2, long[2]), (2, long[1]), (3, long[3]), (None, long[3])]
    docs = table(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    exact = corpus_pipeline.exact_stage(spark, docs, SMALL).collect()
    near = corpus_pipeline.near_stage(spark, docs, SMALL).collect()
    assert sorted(((r[0], r[1]) for r in exact), key=repr) == sorted([(None, long[0]), (2, long[1]), (2, long[2]), (3, long[3])], key=repr)
    assert sorted(((r[0], r[1]) for r in near), key=repr) == sorted([(None, long[0]), (1, long[1]), (2, long[2]), (3, long[3])], key=repr)
    assert all(r["n_chars"] == len(r["text"]) and r["lang"] == "en" for r in exact + near)
