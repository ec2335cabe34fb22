"""Corpus operators on small tables, against plain versions and for odd input."""

import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest

from sparkfeat.llm import bpe, common, decontaminate, exact_dedup, hmm, html, licenses, line_dedup, near_dedup, patience, quality, repeats
from sparkfeat.llm import components
from sparkfeat.llm.components import _star, connected_components
from sparkfeat.llm.queries import vocabulary_path

DOCS = "doc_id bigint, text string, digest string, row int, `my.id` int, chunk int, n int, id string"
_CLASH = ("x", 1, 2, 3, 4, "y")


def table(spark, rows, parts=3):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(*r, *_CLASH) for r in rows], DOCS).repartition(parts)


def odd(seed=1):
    """Null, empty, blank and long texts, repeated rows and null ids, copies and near copies."""
    random.seed(seed)
    words = [f"w{i}" for i in range(300)] + ["été", "ÜBER", "the", "The"]
    texts = [" ".join(random.choices(words, k=k)) for k in (1, 3, 4, 5, 6, 30, 60, 200, 4000)]
    out = [(i, t) for i, t in enumerate(texts)] + [(20 + i, t) for i, t in enumerate(texts[4:])]
    out += [(40 + i, f"{t} tail {i}") for i, t in enumerate(texts[5:])] + [(50 + i, t.upper()) for i, t in enumerate(texts[4:])]
    return out + [(60, None), (61, ""), (62, " \n\t"), (63, None), (7, texts[7]), (7, "another text"), (None, texts[6]), (None, None), (64, "\x00 a\x00b")]


def collected(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


def empty(spark):
    return table(spark, [])


# Exact dedup


def test_exact_groups_and_ties(spark):
    rows = odd()
    got = exact_dedup.deduplicate(table(spark, rows), "t_exact_ties", buckets=4)
    groups = collections.defaultdict(list)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        groups[(t or "").translate(fold)].append(i)
    want = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        want += [(i, max(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert collected(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    assert got.where("kept").count() == len(groups)
    assert got.where("kept AND NOT doc_id <=> keep_id").count() == 0


def test_exact_index_persists(spark):
    first = exact_dedup.deduplicate(table(spark, [(1, "a b"), (2, "c")]), "t_exact_batches", buckets=4)
    assert first.where("kept").count() == 2
    second = collected(exact_dedup.deduplicate(table(spark, [(3, "A B"), (4, "d"), (5, "D")]), "t_exact_batches", buckets=4),
                       "doc_id", "keep_id", "kept")
    assert second == [(3, 1, False), (4, 5, False), (5, 5, True)]
    assert spark.table("t_exact_batches").count() == 3
    plan = spark.table("t_exact_batches")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan or "bucket" in plan.lower()


def test_exact_batch_may_be_repeated(spark):
    rows = odd()
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    first = exact_dedup.deduplicate(table(spark, rows, 3), "t_exact_again", buckets=4, batch="monday")
    want, kept = collected(first, *columns), first.where("kept").count()
    again = exact_dedup.deduplicate(table(spark, rows, 7), "t_exact_again", buckets=4, batch="monday")
    assert collected(again, *columns) == want and again.where("kept").count() == kept
    # A run that died before it had appended everything.
    size = spark.table("t_exact_again").count()
    part = spark.table("t_exact_again").limit(5)
    part.write.format("parquet").bucketBy(4, "digest").sortBy("digest").saveAsTable("t_exact_part")
    third = exact_dedup.deduplicate(table(spark, rows, 5), "t_exact_part", buckets=4, batch="monday")
    assert collected(third, *columns) == want and third.where("kept").count() == kept
    assert spark.table("t_exact_part").count() == size
    other = exact_dedup.deduplicate(table(spark, rows), "t_exact_again", buckets=4, batch="tuesday")
    assert other.where("kept").count() == 0


def test_exact_needs_whole_ids(spark):
    with pytest.raises(ValueError, match="whole numbers"):
        exact_dedup.deduplicate(spark.createDataFrame([("a", "b")], "doc_id string, text string"), "t_exact_ids")


def test_exact_batch_on_an_index_of_larger_groups(spark):
    first = table(spark, [(2 * i + k, f"pair {i}") for i in range(700) for k in (0, 1)])
    exact_dedup.deduplicate(first, "t_exact_hot", buckets=4).count()
    rows = [(5000 + i, f"pair {i}") for i in range(400)]
    second = exact_dedup.deduplicate(table(spark, rows), "t_exact_hot", buckets=4)
    assert collected(second, "doc_id", "keep_id", "kept") == sorted([(5000 + i, 2 * i + 1, False) for i in range(400)], key=repr)


def test_hot_groups_are_counted_in_the_rows(spark):
    rows = spark.createDataFrame([(1,)] * 9 + [(k,) for k in range(2, 800)], "k int")
    groups = spark.createDataFrame([(k, 1000) for k in range(3000)], "k int, group_size int")
    got = common.join_groups(rows, groups, "k")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 807 and "Limit" not in plan and "Sort" not in plan


def test_exact_plan_has_no_python(spark):
    got = exact_dedup.deduplicate(table(spark, [(1, "a")]), "t_exact_plan", buckets=4)
    assert "Python" not in got._jdf.queryExecution().toString()
    assert exact_dedup.deduplicate(empty(spark), "t_exact_empty", buckets=4).count() == 0


# BPE


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    random.seed(5)
    rows = odd() + [(100, "a<|startoftext|>b <|endoftext|><|endoftext|>"), (101, "it's Don't 'REs aaaaaaaaaaaa hahahaha's"),
                    (102, "ΑΣ Σ İstanbul ǅ é é x​y z　 漢字 😀😀 １２３ \x85c"), (103, "< |startoftext|>")]
    rows += [(200 + i, "".join(random.choices(["a", "b", "th", "e", " ", "'s", "1", "é", "Σ", "\n", "!", "—"], k=200))) for i in range(40)]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = bpe.encode(table(spark, rows), vocabulary_path())
    assert collected(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.encode(empty(spark), vocabulary_path(), keep_text=True).count() == 0


# Decontamination


def brute_windows(docs, items, window=10):
    fold = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
    words = lambda t: (t or "").encode().translate(fold).split()
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[j:j + k])].add(str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k]) in windows:
                    found |= windows[tuple(w[j:j + k])]
                    hit |= set(range(j, j + k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    random.seed(2)
    letters = ["a", "b", "c", "é", "D"]
    docs = [(i, " ".join(random.choices(letters, k=random.randint(0, 60)))) for i in range(60)] + odd()
    items = [(i, " ".join(random.choices(letters, k=k))) for i, k in enumerate((10, 11, 14, 12, 3, 2, 40))] + [(9, None), (10, ""), (11, docs[3][1]), (11, docs[3][1])]
    got = decontaminate.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert collected(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_windows(docs, items)


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(empty(spark), items).count() == 0
    assert decontaminate.decontaminate(table(spark, odd()), items).where("contaminated").count() == 0


# Repeats


def brute_repeats(rows, length=50):
    last, first, out = 1 << 62, {}, []
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            k = b[s:s + length]
            first[k] = min(first.get(k, last), last if i is None else i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < (last if i is None else i):
                gone[s:s + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 9000)
    random.seed(seed)
    base = ["".join(random.choices("ab ", k=400)) for _ in range(4)]
    rows = odd(seed)
    for i in range(50):
        text = ""
        for _ in range(random.randint(0, 4)):
            piece, at = random.choice(base), random.randint(0, 380)
            text += piece[at:at + random.randint(10, 120)]
        rows.append((random.choice([i, i, 7, None]), text or None))
    rows += [(100 + i, "x" * n) for i, n in enumerate((49, 50, 51, 900))] + [(200, "é" * 60), (201, "é" * 61)]
    got = repeats.remove_repeats(table(spark, rows), with_text=True)
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_repeats_hold_no_numbers_for_each_string():
    """Runs of a chunk and its removed bytes take a few bytes a byte of text, not several numbers."""
    random.seed(1)
    text = "".join(random.choices("abcdefgh ", k=3_000_000)).encode()
    tracemalloc.start()
    try:
        runs = repeats._runs([text, text])
        assert tracemalloc.get_traced_memory()[1] < 10 * 2 * len(text)
        frame = pd.DataFrame({"row": [0, 1], "id": [1, 2], "place": [1, 2], "data": [text, text], "runs": runs})
        chunk = repeats._Chunk(frame)
        chunk.contexts(np.sort(chunk.hash[:1000]), 1)
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        removed = chunk.removed({})
        assert tracemalloc.get_traced_memory()[1] - before < 4 * 2 * len(text)
    finally:
        tracemalloc.stop()
    assert removed[len(text):].any() and not removed[:len(text)].any()


def test_repeats_of_a_shard_are_found_by_ranges_of_anchors():
    """What takes numbers for each byte of a shard's contexts is held for a range; each string still meets its like."""
    random.seed(2)
    text = "".join(random.choices("abcdefgh ", k=1_000_000)).encode()
    edited = b"".join(b"#" + text[i + 1:i + 100] for i in range(0, len(text), 100))
    frames = [pd.DataFrame({"row": [0], "id": [i], "place": [i], "data": [t], "runs": repeats._runs([t])})
              for i, t in enumerate((text, edited))]
    chunks = [repeats._Chunk(frame) for frame in frames]
    for chunk in chunks:
        chunk.contexts(np.unique(chunk.hash), 1)
    lists = pd.DataFrame([(i, *packed) for i, chunk in enumerate(chunks) for packed in chunk.packed_contexts()],
                         columns=["chunk", "shard", "data"])
    tracemalloc.start()
    try:
        answers = repeats._smallest_documents(lists)
        assert tracemalloc.get_traced_memory()[1] < 8 * lists["data"].map(len).sum()
    finally:
        tracemalloc.stop()
    first, second = (chunk.removed({0: data}) for chunk, data in zip(chunks, answers["data"], strict=True))
    assert not first.any() and (second[:len(text)] == (np.arange(len(text)) % 100 > 0)).all()


def test_repeats_by_small_ranges_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "RANGE_BYTES", 300)
    test_repeats_equal_brute_force(spark, monkeypatch, 4)


# Near duplicates


def test_near_duplicate_classes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TEXTS_IN_BLOCK", 4)
    random.seed(4)
    words = [f"v{i}" for i in range(2000)]
    rows = odd()
    base = random.choices(words, k=200)
    for i in range(30):  # a chain of small edits: near neighbours only
        base = base.copy()
        base[random.randrange(200)] = random.choice(words)
        rows.append((300 + i, " ".join(base)))
    got = near_dedup.near_duplicates(table(spark, rows))
    shingler = near_dedup.Shingler()
    sets = [shingler.shingles(shingler.words(t)) for _, t in rows]
    forest = near_dedup._Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            both = np.union1d(sets[i][0], sets[j][0])
            x, y = np.zeros(len(both)), np.zeros(len(both))
            x[np.searchsorted(both, sets[i][0])], y[np.searchsorted(both, sets[j][0])] = sets[i][1], sets[j][1]
            if not len(both) or near_dedup.probability_jaccard(x, y) >= 0.8:
                forest.join(i, j)
    classes = collections.defaultdict(list)
    for i in range(len(rows)):
        classes[forest.find(i)].append(rows[i][0])
    want = []
    for ids in classes.values():
        known = [i for i in ids if i is not None]
        want += [(i, min(known) if known else None, len(ids)) for i in ids]
    assert collected(got, "doc_id", "class_id", "class_size") == sorted(want, key=repr)
    assert got.where("kept").count() == len(classes)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_many_null_ids(spark):
    """Two thousand rows without an id and two thousand with the same one are no product."""
    random.seed(21)
    words = [f"n{i}" for i in range(500)]
    base = [random.choices(words, k=60) for _ in range(20)]
    rows = [(None if k % 2 else 5, " ".join([*base[k % 20][:58], f"t{k % 40}", "end"])) for k in range(4000)]
    got = near_dedup.near_duplicates(table(spark, rows))
    assert got.count() == 4000 and got.where("kept").count() == 20
    assert {r[0] for r in got.select("class_size").distinct().collect()} == {200}
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_star_centres_are_spread(spark, monkeypatch):
    edges = spark.range(1, 5000).selectExpr("id AS u", "0L AS v")
    monkeypatch.setattr(components, "GROUP_LIMIT", 100)
    plan = _star(edges, True, 4999)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and plan.count("strategy=broadcast") >= 2
    assert connected_components(edges).where("v = 0").count() == 4999


def test_probability_jaccard_by_its_formula():
    random.seed(9)
    for _ in range(50):
        x, y = (np.array([random.choice([0, 0, 1, 1, 2, 5]) for _ in range(12)], float) for _ in range(2))
        if not (x.any() and y.any()):
            continue
        both = [i for i in range(12) if x[i] and y[i]]
        want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(12)) for i in both)
        keep = (x + y) > 0
        assert math.isclose(near_dedup.probability_jaccard(x[keep], y[keep]), want, abs_tol=1e-12)


def test_signatures_estimate_probability_jaccard():
    random.seed(3)
    elements = near_dedup._mix(np.arange(60, dtype=np.uint64))
    x = np.array([random.choice([1, 1, 2, 4]) for _ in range(60)], float)
    y = np.where(np.arange(60) < 45, x, 0.0)
    want = near_dedup.probability_jaccard(x, y)
    sizes = [60, 45]
    registers = near_dedup.signatures(np.concatenate([elements, elements[:45]]), np.concatenate([x, y[:45]]),
                                      np.repeat([0, 1], sizes), 2, 4096)
    assert abs((registers[0] == registers[1]).mean() - want) < 0.03


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


# Language model


def test_forward_is_the_sum_over_all_paths():
    draw = np.random.default_rng(1)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = hmm.Model({}, norm(draw.random(3)), norm(draw.random(3)), norm(draw.random((3, 3))), norm(draw.random((3, 5))).T)
    sequences = [draw.integers(0, 5, n) for n in (1, 4, 6, 4)]
    lengths = np.array([len(s) for s in sequences])
    got = model.forward(np.concatenate(sequences), np.cumsum(lengths) - lengths, lengths)
    for value, sequence in zip(got, sequences, strict=True):
        total = 0.0
        for path in np.ndindex(*([3] * len(sequence))):
            p = model.start[path[0]] * model.emissions[sequence[0], path[0]]
            for t in range(1, len(path)):
                p *= model.transitions[path[t - 1], path[t]] * model.emissions[sequence[t], path[t]]
            total += p
        assert math.isclose(value, math.log10(total), rel_tol=1e-9)


def test_baum_welch_raises_the_likelihood():
    draw = np.random.default_rng(2)
    block = hmm._Block([[bytes([97 + (i + k) % 5]) for i in range(30)] for k in range(8)], hmm.Model(
        {bytes([97 + i]): i + 1 for i in range(5)}, None, None, None, np.ones((6 + hmm.CLASSES, 3))))
    size = 6 + hmm.CLASSES
    model = hmm.Counts(np.ones(3), np.ones((3, 3)), draw.random((size, 3))).model(dict.fromkeys(range(5)))
    last = -np.inf
    for _ in range(6):
        counts = hmm.Counts.zero(3, size)
        counts.add(model, block.symbols, *hmm._segments(block.lengths))
        assert math.isclose(counts.emissions.sum(), len(block.symbols))
        model = counts.model({})
        value = model.forward(block.symbols, block.starts, block.lengths).sum()
        assert value > last - 0.5
        last = value


def test_language_model_counts_and_probabilities(spark):
    rows = odd() + [(300 + i, f"the cat {i} sat on the mat") for i in range(40)]
    from pyspark.sql import functions as F
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    docs = table(spark, rows)
    got = hmm.score(docs, hmm.fit(docs, ~held), ~held).collect()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    tokens = lambda t: [*(t or "").encode().translate(lower).split(), None]
    counts = collections.Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(
        math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    nothing = empty(spark)
    assert hmm.score(nothing, hmm.fit(nothing, ~held), ~held).count() == 0


def test_language_model_learns_from_every_text(spark):
    from pyspark.sql import functions as F
    texts = [f"only{i % 400} common{i % 7} end" for i in range(2000)] + ["giant " * 30000 + "giant2 " * 10]
    docs = table(spark, list(enumerate(texts)))
    model = hmm.fit(docs, F.lit(True), iterations=2)
    counts = collections.Counter(w.encode() for t in texts for w in t.split())
    assert list(model.head) == sorted(counts, key=lambda w: (-counts[w], w))
    small = hmm.fit(docs, F.lit(True), iterations=1, head_words=100)
    assert list(small.head) == sorted(counts, key=lambda w: (-counts[w], w))[:100]
    head, symbols = hmm._vocabulary(docs.select("text"), 100)
    assert head == small.head and symbols.sum() == sum(counts.values()) + len(texts)
    tail = collections.Counter()
    for w, n in counts.items():
        if w not in head:
            tail[hmm.class_of(w)] += n
    assert {k: n for k, n in enumerate(symbols[101:]) if n} == tail


# Quality


def test_quality_learns_and_bounds(spark):
    random.seed(8)
    words = [f"w{i}" for i in range(50)]
    good = [(i, " ".join(random.choices(words, k=40))) for i in range(120)]
    bad = [(200 + i, " ".join(w + "$$$" for w in random.choices(words, k=40))) for i in range(60)]
    docs = table(spark, good + bad + odd())
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in good[:80] + bad[:40]] + [(5, None, 0), (None, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    weights = quality.fit(docs, labels, bits=14)
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, weights).collect()}
    assert min(scored[i] for i, _ in good[80:]) > 0.3 > max(scored[i] for i, _ in bad[40:])
    assert all(0 <= s <= 1 for s in scored.values())
    assert quality.score(empty(spark), weights).count() == 0
    assert set(np.unique(quality.fit(docs, labels.where("false"), bits=10))) == {0.0}


# Pages


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just, words", "just, words"), ("<p>a &amp; b&nbsp;c\n d<br>e</p><p> </p>", "a & b c d e"),
    ("<nav><ul><li>x</ul></nav><article><h1>T</h1><p><b>one<br><p>two <i>x</i>y</article><footer>f</footer>", "T\none\ntwo xy"),
    ("<article><p>cut off &am", "cut off &am"), ("<article><p>cut off</p><p cla", "cut off"),
    ("<body class='with-sidebar'><div class='sidebar'><p>s, s, s</p></div><div><p>t, t</p></div><script>var x='<p>';</script>", "t, t"),
    ("<main><p>text, here</p><section id='comments'><p>nice, very, nice</p></section><aside>x</aside></main>", "text, here"),
    ("<article><p class='advert'>Buy now<p>Article, one<p>two</article>", "Article, one\ntwo"),
    ("<article><ul><li class='share'>s<li>first, item</ul><p>after, it</article>", "first, item\nafter, it"),
    ("<article><div><p class='promo'>x<b>y</div><p>rest, here</p></article>", "rest, here"),
    ("<article><nav><p>n<ul><li>x</nav><p>rest, here</article>", "rest, here"),
    ("<div id='cookieBanner'>we use cookies</div><article><header><h2>H</h2></header><p>b</p><form>q</form></article>", "H\nb"),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_pages_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>", "t"), (2, None, None, "t"), (None, "v", "", None), (1, "u", "<p>é</p>", "t")],
                                  "page_id bigint, url string, html string, text string")
    assert collected(html.extract(pages), "page_id", "url", "text", "n_chars") == sorted(
        [(1, "u", "é", 1), (1, "u", "é", 1), (2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert html.extract(pages.where("false")).count() == 0
    deep = "<div>" * 3000 + "<p>deep, text</p>"
    assert html.main_text(deep) == "deep, text"


# Lines and licences


def test_patience_alignment_is_common_and_increasing():
    random.seed(6)
    for _ in range(200):
        a, b = (random.choices("abcdefgh", k=random.randint(0, 14)) for _ in range(2))
        pairs = patience.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert patience.align("xaby", "aby") == [(1, 0), (2, 1), (3, 2)]
    assert patience.align("", "a") == []


def test_line_blocks(spark):
    block = "first line of a shared block\nsecond line of the same block\n\nlast line of this shared block"
    rows = [(1, f"one own line here to begin\n{block}\nan end"), (2, f"{block}\nanother"), (3, f"x\n{block}"), (3, f"x\n{block}"),
            (None, block), (4, "second line of the same block\nfirst line of a shared block"), (5, None), (6, ""), (7, "short\nshort")]
    got = collected(line_dedup.dedup_lines(table(spark, rows)), "doc_id", "n_lines", "n_removed", "spans")
    # The second of the two equal rows loses all its lines: the first one has them in one block.
    assert got == sorted([(1, 6, 0, []), (2, 5, 4, [0, 4]), (3, 5, 4, [1, 5]), (3, 5, 5, [0, 5]), (None, 4, 4, [0, 4]),
                          (4, 2, 0, []), (5, 1, 0, []), (6, 1, 0, []), (7, 2, 0, [])], key=repr)
    by_id = {(r[0], tuple(r[3])) for r in got}
    assert (2, (0, 4)) in by_id and (1, ()) in by_id and (None, (0, 4)) in by_id and (4, ()) in by_id
    assert line_dedup.without_lines(rows[1][1], [0, 4]) == "another"
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def shared_lines(rows, least=50):
    """The lines of each document that lie in a run of ``least`` characters that an earlier one has."""
    out, seen = {}, set()
    for i, text in sorted(rows):
        lines = [x.strip(" ") for x in text.split("\n")]
        every = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if sum(map(len, lines[a:b])) >= least]
        out[i] = {k for a, b in every if tuple(lines[a:b]) in seen for k in range(a, b)}
        seen |= {tuple(lines[a:b]) for a, b in every}
    return out


@pytest.mark.parametrize("seed", [12, 13])
def test_line_dedup_of_many_pairs_against_all_pairs(spark, seed):
    """Both ways: all lines of a block that an earlier document has, and no others."""
    random.seed(seed)
    pool = [f"line number {i} of the pool with some more words" for i in range(30)] + ["", "}", "a", "short one", "verse of ten"] * 3
    pool += [f"a line long enough to be a block of its own, number {i}" for i in range(10)]
    rows = [(i, "\n".join(random.choices(pool, k=random.randint(1, 14)))) for i in range(60)]
    rows += [(100 + i, "\n".join([*(t.split("\n")[k:] if i % 2 else t.split("\n")[:k]), "x", *t.split("\n")[:3], *t.split("\n")[:3]]))
             for i, (_, t) in enumerate(rows) for k in [random.randint(0, 5)]]
    got = dict(map(tuple, line_dedup.dedup_lines(table(spark, rows)).select("doc_id", "spans").collect()))
    assert {i: {k for a, b in zip(s[::2], s[1::2]) for k in range(a, b)} for i, s in got.items()} == shared_lines(rows)


def test_line_dedup_of_a_block_in_every_document(spark):
    block = "a block that every document of the table has in it somewhere\nand one more line"
    rows = [(i, f"own {i}\n{block}\nend {i}") for i in range(400)] + [(1000, "\n" * 3000)]
    got = dict(map(tuple, line_dedup.dedup_lines(table(spark, rows)).select("doc_id", "spans").collect()))
    assert got == {i: [1, 3] if 0 < i < 1000 else [] for i, _ in rows}


def test_exact_diff_is_longest():
    random.seed(4)
    for bits in (1 << 26, 20):
        patience.TABLE_BITS, kept = bits, patience.TABLE_BITS
        for _ in range(150):
            a, b = (random.choices("abc", k=random.randint(0, 13)) for _ in range(2))
            pairs = patience.common_subsequence(a, b)
            longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, j in np.ndindex(len(a), len(b)):
                longest[i + 1][j + 1] = longest[i][j] + 1 if a[i] == b[j] else max(longest[i][j + 1], longest[i + 1][j])
            assert len(pairs) == longest[-1][-1] and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        patience.TABLE_BITS = kept
    assert len(patience.align("ab" * 3000, "ba" * 3000)) == 5999


def test_licences(spark):
    notice = licenses.TEMPLATES["MIT-notice"]
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, f"Some text of a file.\n{notice}"), (2, f"intro\n{mit.replace('free of charge', 'at no charge')}\nend"), (3, None), (4, ""),
            (5, f"{notice}\nand then\n{notice.upper()}\n{licenses.TEMPLATES['GPL-3.0-notice']}"), (6, "released the hounds"), (1, f"x\n{notice}")]
    got = {(r["doc_id"], r["n_matches"], r["licenses"], r["best"]) for r in licenses.scan(table(spark, rows)).collect()}
    assert got == {(1, 1, "MIT-notice", "MIT-notice"), (2, 1, "MIT", "MIT"), (3, 0, "", None), (4, 0, "", None),
                   (5, 3, "GPL-3.0-notice,MIT-notice", "GPL-3.0-notice"), (6, 0, "", None)}
    assert licenses.scan(empty(spark)).count() == 0


def test_licence_windows_lose_nothing():
    """No window of a match's length, slid over all words between the matches, covers enough."""
    random.seed(13)
    seen = 0
    for trial in range(300):
        template = licenses.Template("t", " ".join(random.choices([f"word{i}" for i in range(14)], k=random.randint(4, 12))))
        noise = [w.decode() for w in template.words] + ["other"] * 6
        text = []
        for _ in range(3):
            text += random.choices(noise, k=random.randint(0, 12))
            kept = [w.decode() for w in template.words if random.random() < 0.93]
            text += [x for w in kept for x in ([w, "added"] if random.random() < 0.1 else [w])] if random.random() < 0.7 else []
        words = licenses.words_of("\n".join(text))
        found = template.match(words)
        width = len(template.words) + math.ceil(licenses.ADDED * len(template.words))
        for coverage, a, b in found:
            assert coverage >= licenses.COVERAGE - 1e-9 and b - a <= width
            assert len(patience.common_subsequence(words[a:b], template.words)) >= round(coverage * len(template.words))
        seen += len(found)
        for begin, end in zip([0, *(b for _, _, b in found)], [*(a for _, a, _ in found), len(words)], strict=True):
            for i in range(begin, end):
                assert len(patience.align(words[i:min(i + width, end)], template.words)) < template.least
    assert seen > 300


@pytest.mark.parametrize("text, names", [
    ("This work is\nlicensed under the GNU General\nPublic License, version 3.", "GPL-3.0-notice"),
    ("# Licensed under\n# CC BY-NC 4.0.", "CC-BY-NC-4.0-notice"),
    ("foo Released under the MIT License. bar bar Released under the MIT License. baz", "MIT-notice,MIT-notice"),
    ("  * ".join(" ".join(licenses.TEMPLATES["MIT"].split()[k:k + 4]) + "\n" for k in range(0, 170, 4)), "MIT"),
    (licenses.TEMPLATES["BSD-2-Clause"] + "\n" + licenses.TEMPLATES["BSD-3-Clause-condition"], "BSD-2-Clause,BSD-3-Clause-condition"),
    ("released the hounds under a mit of the very old license", ""),
    ("Released " + "word " * 40 + "under the " + "word " * 40 + "MIT License", ""),
])
def test_wrapped_and_repeated_notices(text, names):
    words = licenses.words_of(text)
    assert ",".join(n for n, t in sorted(licenses.TEMPLATES.items()) for _ in licenses.Template(n, t).match(words)) == names

