"""Resampling towards a target and mixing of sources, against plain versions and for odd input."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparkfeat.llm import mixing, resample
from test_llm_small import empty, odd, table

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def drawn(rows, target, share=25, longest=2):
    own = [features(t, longest) for _, t in rows]
    bucket = lambda x: zlib.crc32(x.encode()) % 10000
    s = collections.Counter(bucket(f) for _, fs in own for f in fs)
    t = collections.Counter(bucket(f) for x in target for f in features(x, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for (i, _), (words, fs) in zip(rows, own, strict=True):
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= 20])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    most = share * len(order) // 100
    return [tuple(r[:4]) + (None,) for r in out if not r[4]] + [
        tuple(r[:4]) + (k + 1 if k < most else None,) for k, r in enumerate(order)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resample_against_plain(spark, longest):
    rows = odd() + [(100 + i, f"benchmark words of item {i} " * (i % 9)) for i in range(120)]
    target = ["benchmark words of ITEM 3", None, "", "w1 w2 été"]
    got = resample.resample(table(spark, rows, 5), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest)
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(drawn(rows, target, longest=longest), key=repr)


def test_resample_of_long_texts_and_slices(spark, monkeypatch):
    monkeypatch.setattr(resample, "SLICE_BYTES", 50)
    rows = odd(3)
    got = resample.resample(table(spark, rows), spark.createDataFrame([("w1 w2 w3",)], "text string"), share=60)
    want = drawn(rows, ["w1 w2 w3"], share=60)
    assert sorted(map(tuple, got.drop("n_words").collect()), key=repr) == sorted(want, key=repr)


def test_resample_of_nothing(spark):
    nothing = spark.createDataFrame([], "text string")
    assert resample.resample(empty(spark), nothing).collect() == []
    got = resample.resample(table(spark, [(1, None), (2, "a " * 30)]), nothing, share=100).orderBy("doc_id").collect()
    assert [r["rank"] for r in got] == [None, 1] and got[0]["weight"] == 0


def sources(spark, rows, parts=4):
    """``(doc_id, text, source)`` with columns whose names the operator uses."""
    return spark.createDataFrame([(*r, 5, "x", 1) for r in rows], "doc_id bigint, text string, source string, size int, row string, number int").repartition(parts)


def water(sizes, weights=(1, 2, 3), epochs=3):
    """Targets by filling one source after the other to its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(sum(weight[s] for s in open_), 1)
        above = {s: epochs * sizes[s] for s in open_ if weight[s] * level > epochs * sizes[s] * (1 + 1e-12)}
        if not above:
            return {s: fixed.get(s, weight[s] * level) for s in names}
        fixed.update(above)


def mixed(seed=5):
    random.seed(seed)
    text = lambda n: " ".join(random.choices(["a", "bb", "é", "　"], k=n))
    rows = [(i, text(random.randint(0, 60)), "hot") for i in range(300)]
    rows += [(1000 + i, text(random.randint(1, 30)), f"s{i % 7}") for i in range(120)]
    rows += [(2000, text(9000), "long"), (2001, "one", "tiny"), (2002, None, "blank"), (2003, " \n", "blank"), (2004, text(50), None),
             (None, text(40), "hot"), (None, text(40), "hot"), (7, text(11), "hot"), (7, text(11), "hot"), (2005, text(3), "Ü"), (2006, text(4), "")]
    return rows


@pytest.mark.parametrize("block", [1, 7, 64, 2048])
def test_mix_meets_its_targets(spark, block):
    rows = mixed()
    plan = mixing.mix(sources(spark, rows), block_tokens=block)
    got = mixing.taken(plan).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((i, size(t)) for i, t, _ in rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = water(sizes)
    found = {r["source"]: r for r in plan.sources.collect()}
    assert {s: pytest.approx(r["target"], abs=1e-6) for s, r in found.items()} == want
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by_number = collections.Counter()
    for slot in plan.slots.collect():
        by_number[slot["number"]] += slot["words"]
        assert 0 < slot["words"] <= block
    assert {r["number"]: round(r["target"]) for r in found.values() if r["target"] >= 0.5} == dict(by_number)
    assert sum(r["taken"] for r in got) == sum(by_number.values())
    # Documents of a source differ by one epoch at most, but where an epoch ends within them.
    epochs = collections.defaultdict(set)
    for r in got:
        if r["size"]:
            epochs[r["source_size"]].add(r["taken"] // r["size"])
    assert all(max(e) - min(e) <= 1 for e in epochs.values())


def test_mix_is_spread_and_steady(spark):
    rows = mixed()
    first = mixing.mix(sources(spark, rows, 2), block_tokens=8)
    again = mixing.mix(sources(spark, rows, 7), block_tokens=8)
    seen = [sorted(map(tuple, x.slots.collect())) for x in (first, again)]
    assert seen[0] == seen[1]
    assert sorted(map(tuple, mixing.taken(first).collect()), key=repr) == sorted(map(tuple, mixing.taken(again).collect()), key=repr)
    assert [s[0] for s in seen[0]] == sorted({s[0] for s in seen[0]})
    # Any tenth of the schedule has the largest source about as often as the whole.
    numbers = [s[1] for s in seen[0]]
    often, share = collections.Counter(numbers).most_common(1)[0]
    step = len(numbers) // 10
    assert all(abs(numbers[k:k + step].count(often) - step * share / len(numbers)) <= 4 for k in range(0, 9 * step, step))


def test_mix_points_are_distinct_and_even(spark):
    points = [r[0] for r in spark.range(4096).select(mixing._points(F.col("id"))).collect()]
    assert points == [k * mixing.GOLDEN % 2**40 for k in range(4096)]
    assert spark.range(1).select(mixing._points(F.lit(2**41 + 12345))).first()[0] == (2**41 + 12345) * mixing.GOLDEN % 2**40
    ordered = sorted(points)
    assert max(b - a for a, b in zip(ordered, ordered[1:], strict=False)) < 3 * 2**40 / 4096


def test_mix_of_nothing(spark):
    assert mixing.taken(mixing.mix(sources(spark, []))).collect() == []
    got = mixing.taken(mixing.mix(sources(spark, [(1, None, "a"), (2, "", None)]))).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in got] == [(0, 0, 0.0, 0)] * 2
