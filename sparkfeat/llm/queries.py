"""Registered queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkfeat.llm import (
    alignment,
    bpe,
    decontaminate,
    exact_dedup,
    hmm,
    html,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    quality,
    repeats,
    resample,
)
from sparkfeat.llm.common import table
from sparkfeat.sources.staging import staging_root

QUERIES, ORACLES = {}, {}
VOCABULARY = "word_bpe_49k.json"


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_hmm")
def op1_hmm(spark, sf):
    """The model's score of every document; a seventh is held out of training."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    scored = hmm.fit_and_score(docs, ~held_out)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


@query("op2_licenses")
def op2_licenses(spark, sf):
    """Licence notices and texts in every document."""
    return licenses.scan(table(spark, sf, "documents", "doc_id", "text"))


@query("op3_quality")
def op3_quality(spark, sf):
    """The score of every document; labels of the held-out fifth are not learned from."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    fifth = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    labels = table(spark, sf, "labels", "doc_id", "quality").where(fifth != 0)
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fifth == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op4_bpe")
def op4_bpe(spark, sf):
    """Encoding and decoding of every document."""
    return bpe.encode(table(spark, sf, "documents", "doc_id", "text"), vocabulary_path())


@query("op5_html")
def op5_html(spark, sf):
    """The main text of every page."""
    return html.extract(table(spark, sf, "pages", "page_id", "url", "html"))


@query("op6_decontaminate")
def op6_decontaminate(spark, sf):
    """Benchmark windows in every document."""
    return decontaminate.decontaminate(table(spark, sf, "documents", "doc_id", "text"),
                                       table(spark, sf, "benchmark", "item_id", "text")).drop("spans")


@query("op7_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def op7_exact_dedup(spark, sf):
    """All documents as the first batch of a new index."""
    name = f"op7_index_{uuid.uuid4().hex}"
    return exact_dedup.deduplicate(table(spark, sf, "documents", "doc_id", "text"), name, path=f"{staging_root(spark)}/{name}")


@query("op8_near_dedup")
def op8_near_dedup(spark, sf):
    """Near-duplicate classes of all documents."""
    return near_dedup.near_duplicates(table(spark, sf, "documents", "doc_id", "text"))


@query("op9_lines")
def op9_lines(spark, sf):
    """Blocks of lines that an earlier document has."""
    return line_dedup.dedup_lines(table(spark, sf, "documents", "doc_id", "text"))


@query("op10_repeats")
def op10_repeats(spark, sf):
    """Passages of 50 bytes and more that an earlier document has."""
    return repeats.remove_repeats(table(spark, sf, "documents", "doc_id", "text")).drop("spans")


@query("op11_alignment")
def op11_alignment(spark, sf):
    """The tokens of two tokenizers over every document, aligned and linked."""
    tokenizers = alignment.Tokenizers.read(vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
    return alignment.align(table(spark, sf, "documents", "doc_id", "text"), tokenizers)


@query("op12_resample", """
WITH RECURSIVE step(i, j, v) AS (SELECT range, 0, range FROM range(256) UNION ALL
  SELECT i, j + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE j < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE j = 8),
texts AS (SELECT true AS own, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark),
split AS (SELECT row_number() OVER () AS r, own, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
runs AS (SELECT r, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM split),
counted AS (SELECT r, own, f, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(f) * 2, 2),
    lambda p: ('0x' || substr(hex(encode(f)), p, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT f FROM counted), crc),
bucketed AS (SELECT r, own, b, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT b, coalesce(sum(n) FILTER (own), 0)::BIGINT AS s, coalesce(sum(n) FILTER (NOT own), 0)::BIGINT AS t FROM bucketed GROUP BY b),
gains AS (SELECT b, floor(1000 * ln(((t + 1) * (ts.a + 10000))::DOUBLE / ((s + 1) * (tt.a + 10000))::DOUBLE))::BIGINT AS g
  FROM sums, (SELECT coalesce(sum(s), 0)::BIGINT AS a FROM sums) ts, (SELECT coalesce(sum(t), 0)::BIGINT AS a FROM sums) tt),
weights AS (SELECT r, sum(n)::BIGINT AS n, floor(sum(n * g)::BIGINT / sum(n)::BIGINT)::BIGINT AS weight
  FROM bucketed JOIN gains USING (b) WHERE own GROUP BY r),
scored AS (SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
    / 4294967296::DOUBLE)))::BIGINT AS score FROM split LEFT JOIN weights USING (r) WHERE own),
ranked AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place,
    count(*) FILTER (words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM ranked""")
def op12_resample(spark, sf):
    """A quarter of the documents, drawn towards the words of the benchmark."""
    drawn = resample.resample(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "benchmark", "text"))
    return drawn.drop("n_words")


@query("op13_mixing", """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    substr(sha256('13:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS shuffled FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
rounds AS (SELECT 0 AS i, false AS done, sum(source_size)::HUGEINT AS rest, sum(w)::HUGEINT AS open, 0::BIGINT AS stopped FROM s UNION ALL
  SELECT i + 1, n = stopped, nrest, nopen, n FROM (SELECT i, any_value(stopped) AS stopped, any_value(done) AS done,
      (sum(source_size) - coalesce(sum(3 * source_size) FILTER (w * rest > 3 * source_size * open), 0))::HUGEINT AS nrest,
      coalesce(sum(w) FILTER (NOT w * rest > 3 * source_size * open), 0)::HUGEINT AS nopen,
      count(*) FILTER (w * rest > 3 * source_size * open) AS n FROM rounds, s WHERE NOT done GROUP BY i)),
level AS (SELECT rest, open FROM rounds ORDER BY i DESC LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN w * rest > 3 * source_size * open THEN (3 * source_size)::DOUBLE
    ELSE (w * rest)::DOUBLE / open::DOUBLE END AS target FROM s, level),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY shuffled, size, r
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE size * (round(target)::BIGINT // source_size)
    + greatest(0, least(size, round(target)::BIGINT % source_size - before)) END::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source""")
def op13_mixing(spark, sf):
    """How many words of every document a mix of all sources takes, weighed 1, 2, 3 in turn."""
    return mixing.taken(mixing.mix(table(spark, sf, "documents", "doc_id", "text", "source")))
