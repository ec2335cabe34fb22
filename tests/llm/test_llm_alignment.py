"""Alignment of two tokenizers, against a plain version and for odd input."""

import collections
import hashlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkfeat.llm import alignment
from sparkfeat.llm.bpe import byte_letters
from sparkfeat.llm.queries import vocabulary_path
from test_llm_small import empty, odd, table

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["a", " a", "  a  b ", "a\tb\n\nc", "don't I'LL we've", "<|endoftext|> <s> </s> <unk> <0x41>", "été Ünïcode ﬁ ½ ①", "日本語のテキスト と 中文",
       "🙂🙂 👩‍👩‍👧 z", "▁a ▁▁b", "a b c", "é ́x", "x" * 3000, "12345 678,90", "\x00\x01 a\x7f", "سلام دنیا", " \n\t", "a ", "​z",
       "word " * 500 + "x", "It's the end -- of it...\r\n" * 40]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers.read(vocabulary_path(A), vocabulary_path(B))


def encoders():
    a = Tokenizer.from_file(vocabulary_path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(B))


def plain(rows):
    """Byte by byte: which token of each side holds it."""
    a, b = encoders()
    value = {x: i for i, x in enumerate(byte_letters())}
    made, links = [], collections.Counter()
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        ids = [a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")]
        tokens = [[bytes(value[c] for c in a.id_to_token(t)) for t in ids[0]],
                  [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in ids[1]]]
        if not text or any(b"".join(t) != raw for t in tokens):
            made.append((i, 0, 0, 0, [], ""))
            continue
        holder = [[k for k, t in enumerate(side) for _ in t] for side in tokens]
        pairs = sorted(set(zip(*holder, strict=True)))
        ends = [set(np.cumsum([len(t) for t in side]).tolist()) for side in tokens]
        both = sorted(ends[0] & ends[1])
        groups, begin = [], 0
        for end in both:
            groups.append("|".join(",".join(str(side[k]) for k in sorted(set(h[begin:end]))) for side, h in zip(ids, holder, strict=True)))
            begin = end
        linked = [(ids[0][x], ids[1][y]) for x, y in pairs]
        links.update(linked)
        made.append((i, len(ids[0]), len(ids[1]), len(groups), linked, ";".join(groups)))
    most = collections.Counter()
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    return [(i, na, nb, g, len(linked), sum(links[p] == most[p[1]] for p in linked), sum(links[p] for p in linked),
             hashlib.sha256(text.encode()).hexdigest() if text else "", text) for i, na, nb, g, linked, text in made]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


def aligned(spark, rows, tokenizers):
    frame = alignment.align(table(spark, rows), tokenizers, keep_groups=True)
    return sorted(map(tuple, frame.select(COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("block,known", [(2_000_000, 50_000), (300, 40)])
def test_alignment_against_plain(spark, tokenizers, monkeypatch, block, known):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "KNOWN_CHUNKS", known)
    monkeypatch.setattr(alignment, "CALL_CHARS", 3 * known)
    rows = odd() + [(1000 + i, t) for i, t in enumerate(ODD)] + [(1000, "a"), (2000, " ".join(ODD))]
    want = plain(rows)
    assert aligned(spark, rows, tokenizers) == sorted(want, key=repr)
    assert sum(w[3] for w in want) > 100 and any(w[1] == 0 and r[1] for w, r in zip(want, rows, strict=True))


def test_chunks_encode_as_the_whole(tokenizers):
    a, b = encoders()
    encoder = alignment._Encoder(tokenizers)
    signs = "aZ09.,'-é ñ\u00a0\u00adßΩя\u0301\u0483\u200b\u3000\x1c\x85\n\t ▁<>/日🙂"
    draw = np.random.default_rng(9)
    texts = ["".join(draw.choice(list(signs + "    "), n)) for n in draw.integers(1, 60, 3000)]
    texts += ODD + ["the cat's a b c  d éf gh i" * 9, "I 'm a 's x", "a 's 't b", "x  y", " ", "a  ", "1 2 3,4 5"]
    cut = 0
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        want = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
        cut += len(alignment._CUT.split(text)) > 1
        if ids is None:
            raw = (" " + text).encode()
            assert any(b"".join(names[i] for i in x) != raw for names, x in zip(encoder.spelled, want, strict=True))
        else:
            assert [x.tolist() for x in ids] == want
    assert cut > 1000


def test_gallop_is_a_search():
    draw = np.random.default_rng(3)
    for size in (1, 2, 5, 300):
        ends = np.cumsum(draw.integers(1, 9, size))
        wanted = draw.integers(0, ends[-1] + 1, 400)
        low, high = np.zeros(400, np.int64), np.full(400, size - 1)
        found = alignment.gallop(wanted, ends, low, high, draw.integers(0, size, 400))
        assert (found == np.searchsorted(ends, wanted)).all()


def test_alignment_of_nothing(spark, tokenizers):
    assert alignment.align(empty(spark), tokenizers).collect() == []
    got = alignment.align(table(spark, [(1, None), (None, "")]), tokenizers).collect()
    assert sorted((r["n_links"], r["count_sum"], r["groups_sha256"]) for r in got) == [(0, 0, "")] * 2


def test_pair_counts_cover_all_texts(spark):
    pairs = spark.createDataFrame([(5, 2), (5, 1), (8, 3), (7, 9), (12, 1)], "pair bigint, n bigint")
    got = {r["pair"]: (r["n"], r["best"]) for r in alignment.pair_counts(pairs, 3).orderBy("pair").collect()}
    assert got == {5: (3, True), 8: (3, True), 7: (9, True), 12: (1, True)}
    assert alignment.pair_counts(pairs.where(F.lit(False)), 3).count() == 0
