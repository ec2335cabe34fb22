"""A hidden Markov language model.

The states emit symbols: the words of a bounded head vocabulary, the end of a text, or one of a
fixed number of classes of rarer words (by their first and last letters). A rarer word then has
its share of its class: ``c(w) / (N_k + V_k)``, and all unseen words of a class together
``V_k / (N_k + V_k)`` (``N_k`` tokens, ``V_k`` different words of the class in training). That share
does not depend on the state, so the scaled forward recursion over symbols, times the shares, is
the exact likelihood of a text, and what every task must know has a fixed size.

Texts are read and split once. Each block of texts numbers its different words and deals them to shards by
hash; a shard adds up the training counts of its words over all blocks and sends them back to the blocks, packed
a row for each block and shard. The blocks then know the symbol, the count and the share of every token,
and training and scoring read nothing but the symbols.

Baum-Welch: each task sums the expected counts of its training texts by symbol and state; the sums
of all tasks give the next parameters, until the likelihood gains little. The head vocabulary and the first
parameters come from the word counts of all training texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import parts_for
from sparkfeat.sources.staging import stage, staged

STATES = 8
HEAD_WORDS = 1 << 16
#: A word of the head occurs at least this often: of rarer ones the states learn nothing.
HEAD_COUNT = 3
CLASSES = 1 << 14
SEGMENT = 256
BLOCK_BYTES = 4_000_000
SHARD_BYTES = 16_000_000
COUNT_SEGMENTS = 1200
#: Baum-Welch rounds at most, and the gain in log10 likelihood a token below which they end.
ROUNDS = 4
GAIN = 0.005
WEIGHTS = (5.0, 20.0, 80.0, 320.0, 1280.0, 5120.0, 20480.0)
_CHUNK = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words between white space (blank, tab to carriage return), A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[:2] + b" " + word[-3:]) % CLASSES


@dataclass
class Model:
    """Parameters. Symbols: 0 is the end, then the head words, then the classes."""

    head: dict[bytes, int]
    start: np.ndarray
    resume: np.ndarray
    transitions: np.ndarray
    emissions: np.ndarray

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """The symbol of each word, -1 for words outside the head."""
        return np.fromiter(map(self.head.get, words, [-1] * len(words)), np.int32, len(words))

    def forward(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 likelihood of each symbol sequence, by the scaled forward recursion."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        shrink = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(lengths) else []
        total = np.zeros(len(order))
        alpha = np.broadcast_to(self.start, (len(order), len(self.start)))
        for t, m in enumerate(shrink):
            alpha = alpha[:m] if t == 0 else alpha[:m] @ self.transitions
            alpha = alpha * self.emissions[symbols[starts[:m] + t]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[:m] += np.log10(scale)
        out = np.empty(len(order))
        out[order] = total
        return out


@dataclass
class Counts:
    """Expected counts of Baum-Welch."""

    start: np.ndarray
    transitions: np.ndarray
    emissions: np.ndarray
    likelihood: float = 0.0

    @classmethod
    def zero(cls, states: int, symbols: int) -> Counts:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))

    def add(self, model: Model, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> None:
        """Forward and backward over sequences; ``first`` marks those that begin a text."""
        if not len(lengths):
            return
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, first = starts[order], lengths[order], first[order]
        sizes = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        states = len(model.start)
        alphas, likes = [], []
        alpha = np.where(first[:, None], model.start, model.resume)
        for t, m in enumerate(sizes):
            like = model.emissions[symbols[starts[:m] + t]]
            alpha = (alpha if t == 0 else alpha[:m] @ model.transitions) * like
            scale = alpha.sum(1, keepdims=True)
            alpha = alpha / scale
            self.likelihood += float(np.log10(scale).sum())
            alphas.append(alpha)
            likes.append(like / scale)
        beta = np.ones((sizes[-1], states))
        where, weights = [], []
        for t in range(len(sizes) - 1, -1, -1):
            m = sizes[t]
            if len(beta) < m:
                beta = np.concatenate([beta, np.ones((m - len(beta), states))])
            where.append(symbols[starts[:m] + t])
            weights.append(alphas[t] * beta)
            if t:
                ahead = likes[t] * beta
                self.transitions += (alphas[t - 1][:m].T @ ahead) * model.transitions
                beta = ahead @ model.transitions.T
        self.start += weights[-1][first].sum(0)
        where, weights = np.concatenate(where), np.concatenate(weights)
        for s in range(states):
            self.emissions[:, s] += np.bincount(where, weights[:, s], len(self.emissions))

    def model(self, head: dict[bytes, int]) -> Model:
        """The next parameters, slightly smoothed so that nothing has probability 0."""
        by_state, by_symbol = self.emissions.sum(0), self.emissions.sum(1)
        prior = (by_symbol + 0.5) / (by_symbol.sum() + 0.5 * len(by_symbol))
        weight = self.prior_weight()
        norm = lambda x: (x + 1e-3) / (x + 1e-3).sum(-1, keepdims=True)
        return Model(head, norm(self.start), norm(by_state), norm(self.transitions),
                     (self.emissions + weight * prior[:, None]) / (by_state + weight))

    def prior_weight(self) -> float:
        """How much the states lean on the symbol frequencies: the best of WEIGHTS for counts that leave one out."""
        by_state, by_symbol = self.emissions.sum(0), self.emissions.sum(1)
        left = np.maximum(self.emissions - 1, 0)
        prior = ((np.maximum(by_symbol - 1, 0) + 0.5) / (by_symbol.sum() + 0.5 * len(by_symbol)))[:, None]
        return max(WEIGHTS, key=lambda w: float((self.emissions * np.log((left + w * prior) / (by_state + w))).sum()))


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts sequences that lie one after the other into pieces of at most SEGMENT."""
    pieces = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(lengths) - lengths)[owner] + number * SEGMENT
    return starts, np.minimum(SEGMENT, lengths[owner] - number * SEGMENT), number == 0


def _blocks(texts: list[str | None], most: int = BLOCK_BYTES) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of consecutive texts, some megabytes at a time, with the number of the first text."""
    begin, size, block = 0, 0, []
    for i, text in enumerate(texts):
        block.append(words_of(text))
        size += len(text or "")
        if size >= most or i == len(texts) - 1:
            yield begin, block
            begin, size, block = i + 1, 0, []


class _Block:
    """Texts one after the other as symbols, each ended by 0."""

    def __init__(self, texts: list[list[bytes]], model: Model) -> None:
        flat = [w for words in texts for w in words]
        words = np.array([len(x) for x in texts], np.int64)
        self.lengths = words + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.symbols = np.zeros(int(self.lengths.sum()), np.int32)
        self.symbols[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), words)] = _symbols(flat, model.head)


def _symbols(words: list[bytes], head: dict[bytes, int]) -> np.ndarray:
    """The symbol of each word: its own, or its class after the head's."""
    found = np.fromiter(map(head.get, words, [-1] * len(words)), np.int32, len(words))
    tail = np.flatnonzero(found < 0)
    found[tail] = np.fromiter((class_of(words[i]) for i in tail.tolist()), np.int32, len(tail)) + 1 + len(head)
    return found


def _pack(values: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(np.ascontiguousarray(values).tobytes(), asbytes=True)


def _unpack(packed: bytes, count: int, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(pa.Codec("zstd").decompress(packed, int(count) * kind.itemsize, asbytes=True), kind)


def _rows(types: dict[str, pa.DataType], **values) -> pa.Table:
    """A table of all the columns of ``types``; those that are not named are null."""
    n = len(next(iter(values.values())))
    return pa.table({name: pa.array(values[name], kind) if name in values and not isinstance(values[name], (pa.Array, pa.ChunkedArray))
                     else values.get(name, pa.nulls(n, kind)) for name, kind in types.items()})


def _split(docs: DataFrame, training: Column, shards: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks of texts: a row a text with the numbers of its words in the block, and a row a shard with its words.

    ``block, id, training, n_tokens, numbers`` and ``block, shard, size, bytes, words, counts``, packed. Numbers run
    through the shards in their order; counts are those of the training texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"block bigint, id {kind}, training boolean, n_tokens bigint, numbers binary, shard int, size bigint, "
              "bytes bigint, words binary, counts binary")
    types = {"block": pa.int64(), "id": None, "training": pa.bool_(), "n_tokens": pa.int64(), "numbers": pa.binary(),
             "shard": pa.int32(), "size": pa.int64(), "bytes": pa.int64(), "words": pa.binary(), "counts": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, made = (context.partitionId() if context else 0), 0
        for batch in batches:
            kinds = types | {"id": batch.schema.field("id").type}
            trains = batch.column("training").to_numpy(zero_copy_only=False)
            for begin, texts in _blocks(batch.column("text").to_pylist()):
                flat = [w for words in texts for w in words]
                lengths = np.array(list(map(len, texts)), np.int64)
                numbers = dict.fromkeys(flat)
                words = list(numbers)
                shard = np.fromiter((zlib.crc32(w) % shards for w in words), np.int64, len(words))
                order = np.argsort(shard, kind="stable")
                place = np.empty(len(words), np.uint32)
                place[order] = np.arange(len(words))
                numbers.update(zip(words, place.tolist(), strict=True))
                tokens = np.fromiter(map(numbers.__getitem__, flat), np.uint32, len(flat))
                inside = trains[begin:begin + len(texts)].astype(bool)
                counts = np.bincount(tokens[np.repeat(inside, lengths)], minlength=len(words)).astype(np.int64)
                key, made = part << 32 | made, made + 1
                yield from _rows(kinds, block=[key] * len(texts), id=batch.column("id").slice(begin, len(texts)), training=inside,
                                 n_tokens=lengths + 1, numbers=[_pack(x) for x in np.split(tokens, np.cumsum(lengths)[:-1])]).to_batches()
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                held = np.flatnonzero(np.diff(cuts))
                blobs = [b" ".join([words[i] for i in order[cuts[k]:cuts[k + 1]].tolist()]) for k in held.tolist()]
                if blobs:
                    yield from _rows(kinds, block=[key] * len(held), shard=held, size=np.diff(cuts)[held], bytes=list(map(len, blobs)),
                                     words=[pa.Codec("zstd").compress(x, asbytes=True) for x in blobs],
                                     counts=[_pack(counts[cuts[k]:cuts[k + 1]]) for k in held.tolist()]).to_batches()

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       F.coalesce(training, F.lit(False)).alias("training")).mapInArrow(run, schema)


def _words(row: dict) -> list[bytes]:
    return pa.Codec("zstd").decompress(row["words"], row["bytes"], asbytes=True).split(b" ")


def _count(blocks: DataFrame, least: int) -> DataFrame:
    """Training counts over all blocks: ``block, shard, size, counts`` packed for each shard of a block, the ``word, n`` of
    words that occur ``least`` times, and for each class (and shard) its ``tokens`` and different ``known`` words."""
    types = {"kind": pa.string(), "block": pa.int64(), "shard": pa.int32(), "size": pa.int64(), "counts": pa.binary(),
             "word": pa.binary(), "class": pa.int32(), "n": pa.int64(), "known": pa.int64()}

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        flat = [w for row in rows for w in _words(row)]
        numbers = dict.fromkeys(flat)
        words = list(numbers)
        numbers.update(zip(words, range(len(words)), strict=True))
        at = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
        here = np.concatenate([_unpack(row["counts"], row["size"], "<i8") for row in rows])
        n = np.zeros(len(words), np.int64)
        np.add.at(n, at, here)
        sums = np.split(n[at], np.cumsum([row["size"] for row in rows])[:-1])
        often = np.flatnonzero(n >= least)
        seen = np.flatnonzero(n)
        classes = np.fromiter((class_of(words[i]) for i in seen.tolist()), np.int64, len(seen))
        tokens, known = np.bincount(classes, n[seen], CLASSES), np.bincount(classes, minlength=CLASSES)
        used = np.flatnonzero(known)
        return pa.concat_tables([
            _rows(types, kind=["counts"] * len(rows), block=[r["block"] for r in rows], shard=[r["shard"] for r in rows],
                  size=[r["size"] for r in rows], counts=[_pack(x) for x in sums]),
            _rows(types, kind=["word"] * len(often), word=[words[i] for i in often.tolist()], n=n[often]),
            _rows(types, kind=["class"] * len(used), **{"class": used, "n": tokens[used].astype(np.int64), "known": known[used]})])

    return blocks.where("words IS NOT NULL").select("block", "shard", "size", "bytes", "words", "counts").groupBy("shard").applyInArrow(
        run, "kind string, block bigint, shard int, size bigint, counts binary, word binary, class int, n bigint, known bigint")


def _head(words: DataFrame, head_words: int) -> dict[bytes, int]:
    """The ``head_words`` most frequent of ``words`` (``word, n``) with their counts; of equally frequent ones the first."""
    # Different counts number at most the square root of twice the tokens.
    by_count = words.groupBy("n").agg(F.count("*").alias("words")).toPandas().sort_values("n", ascending=False)
    inside = by_count["words"].cumsum() <= head_words
    least = int(by_count["n"][inside].min()) if inside.any() else 1 << 62
    left = head_words - int(by_count["words"][inside].sum())
    chosen = [words.where(F.col("n") >= least)]
    if left and not inside.all():
        chosen.append(words.where(F.col("n") == int(by_count["n"][~inside].max())).orderBy("word").limit(left))
    top = pd.concat([x.toPandas() for x in chosen])  # at most head_words rows
    return dict(sorted(zip(map(bytes, top["word"]), top["n"].tolist(), strict=True), key=lambda x: (-x[1], x[0])))


@dataclass
class _Corpus:
    """Encoded texts and their counts. ``symbols[i]`` says how often symbol ``i`` occurs in training."""

    rows: DataFrame
    head: dict[bytes, int]
    symbols: np.ndarray


def _prepare(docs: DataFrame, training: Column, held: ExitStack | None, id_col: str, text_col: str, head_words: int = HEAD_WORDS,
             head: dict[bytes, int] | None = None) -> _Corpus:
    """Read and encode all texts, with the head of ``training`` or a given one.

    Rows ``id, training, n_tokens, n_known, train_tokens, base_score, shares, symbols``, in files that stay until ``held``
    ends, or as all staged files do without it; ``shares`` is the log10 share of the rare words in their classes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shards = parts_for(docs, text_col, SHARD_BYTES)
    with staged(_split(docs, training, shards, id_col, text_col)) as blocks, staged(_count(blocks, HEAD_COUNT), ["kind"]) as counted:
        ends = blocks.where("training").count()
        words = counted.where("kind = 'word'").select("word", "n")
        counts: dict[bytes, int] = {}
        if head is None:
            counts = _head(words, head_words)
            head = {w: i + 1 for i, w in enumerate(counts)}
        else:
            # A given head: its counts here, also of those words that are rarer here.
            wanted = docs.sparkSession.createDataFrame([(bytearray(w),) for w in head], "word binary")
            counts = {bytes(r["word"]): r["n"] for r in _word_counts(blocks).join(F.broadcast(wanted), "word").collect()}
        by_class = counted.where("kind = 'class'").groupBy("class").agg(
            F.sum("n").alias("n"), F.sum("known").alias("known")).toPandas()  # at most CLASSES rows
        tokens, known = np.zeros(CLASSES), np.zeros(CLASSES)
        tokens[by_class["class"].to_numpy(np.int64)] = by_class["n"].to_numpy(float)
        known[by_class["class"].to_numpy(np.int64)] = by_class["known"].to_numpy(float)
        n_all, v_all = int(tokens.sum()) + ends, int(known.sum()) + (ends > 0)
        for word, n in counts.items():  # classes are of the words outside the head
            tokens[class_of(word)] -= n
            known[class_of(word)] -= n > 0
        symbols = np.concatenate([[ends], [counts.get(w, 0) for w in head], tokens])
        base_all, both = math.log10(n_all + v_all + 1), tokens + known
        width, end_known, end_base = 1 + len(head), int(ends > 0), math.log10(ends + 1)

        def encode(texts: pa.Table, sums: pa.Table) -> pa.Table:
            rows = texts.filter(texts["words"].is_null())
            held_words = sorted(texts.filter(texts["words"].is_valid()).to_pylist(), key=lambda r: r["shard"])
            found = sorted(sums.to_pylist(), key=lambda r: r["shard"])
            names = [w for row in held_words for w in _words(row)]
            c = np.concatenate([np.zeros(0, np.int64), *[_unpack(r["counts"], r["size"], "<i8") for r in found]])
            symbol = _symbols(names, head)
            k = np.maximum(symbol - width, 0)
            # A word outside the head has its share of the class, unseen words together as much as the different ones.
            share = np.where((symbol >= width) & (both[k] > 0), np.where(c > 0, c, np.maximum(known[k], 1e-300)) / np.maximum(both[k], 1), 1.0)
            values = np.stack([(c > 0).astype(float), np.log10(c + 1), np.log10(share)], 1)
            n_tokens = rows["n_tokens"].to_numpy()
            out, made = np.zeros((len(rows), 3)), []
            for i, (packed, n) in enumerate(zip(rows["numbers"].to_pylist(), n_tokens.tolist(), strict=True)):
                at = _unpack(packed, n - 1, "<u4")
                out[i] = values[at].sum(0)
                made.append(_pack(np.append(symbol[at], 0).astype("<i4")))
            return pa.table({
                "id": rows["id"], "training": rows["training"], "n_tokens": n_tokens, "n_known": out[:, 0].astype(np.int64) + end_known,
                "train_tokens": np.full(len(rows), n_all), "base_score": out[:, 1] + end_base - n_tokens * base_all, "shares": out[:, 2],
                "symbols": pa.array(made, pa.binary())})

        sums = counted.where("kind = 'counts'").select(F.col("block").alias("of_block"), "shard", "size", "counts")
        encoded = blocks.groupBy("block").cogroup(sums.groupBy("of_block")).applyInArrow(
            encode, f"id {kind}, training boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
                    "shares double, symbols binary")
        return _Corpus(stage(encoded) if held is None else held.enter_context(staged(encoded)), head, symbols)


def _word_counts(blocks: DataFrame) -> DataFrame:
    """``word, n``: the training count of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.record_batch({"word": pa.array(_words(row), pa.binary()), "n": _unpack(row["counts"], row["size"], "<i8")})

    rows = blocks.where("words IS NOT NULL").select("size", "bytes", "words", "counts")
    return rows.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _first(head: dict[bytes, int], symbols: np.ndarray, states: int) -> Model:
    """Parameters to start from: the counts of all symbols, dealt unevenly to states that tend to stay."""
    draw = np.random.default_rng(7)
    stay = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Counts(np.full(states, 1 / states), stay,
                  (symbols[:, None] + 0.1) * draw.gamma(2.0, 0.5, (len(symbols), states))).model(head)


def _uniform(states: int, head: dict[bytes, int]) -> Model:
    size = 1 + len(head) + CLASSES
    return Counts(np.ones(states), np.ones((states, states)), np.ones((size, states))).model(head)


def _train(corpus: _Corpus, states: int, iterations: int, gain: float) -> Model:
    if not corpus.symbols.any():
        return _uniform(states, corpus.head)
    model, last = _first(corpus.head, corpus.symbols, states), -math.inf
    for _ in range(iterations):
        counts = _expected(corpus.rows.where("training"), model)
        model = counts.model(corpus.head)
        # The likelihood is that of the parameters that made the counts.
        now = counts.likelihood / max(counts.emissions.sum(), 1.0)
        if now - last < gain:
            break
        last = now
    return model


def _expected(rows: DataFrame, model: Model) -> Counts:
    """Expected counts of all rows, summed over the tasks."""
    states, size = len(model.start), len(model.emissions)
    bare = Model({}, model.start, model.resume, model.transitions, model.emissions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts.zero(states, size)
        for batch in batches:
            lengths = batch.column("n_tokens").to_numpy()
            symbols = np.concatenate([np.zeros(0, np.int32), *[_unpack(x, n, "<i4") for x, n in zip(
                batch.column("symbols").to_pylist(), lengths.tolist(), strict=True)]])
            pieces = _segments(lengths)
            for k in range(0, len(pieces[0]), COUNT_SEGMENTS):
                counts.add(bare, symbols, *(x[k:k + COUNT_SEGMENTS] for x in pieces))
        if not counts.start.any() and not counts.emissions.any():
            return
        # Chunks of symbols from 0; the small parts, with the likelihood, are chunk -1.
        small = np.concatenate([counts.start, counts.transitions.ravel(), [counts.likelihood]])
        parts = [small, *[counts.emissions[k:k + _CHUNK].ravel() for k in range(0, size, _CHUNK)]]
        yield pa.record_batch({"chunk": np.arange(-1, len(parts) - 1), "size": np.array(list(map(len, parts))),
                               "sums": pa.array([_pack(parts[0]), *[_pack(x.astype("<f4")) for x in parts[1:]]], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = sum(_unpack(r["sums"], r["size"], "<f8" if r["chunk"] < 0 else "<f4").astype(float) for r in group.to_pylist())
        return pa.table({"chunk": group["chunk"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    partial = rows.select("n_tokens", "symbols").mapInArrow(run, "chunk bigint, size bigint, sums binary")
    summed = partial.groupBy("chunk").applyInArrow(add, "chunk bigint, sums binary").collect()  # the size of the model
    found = {r["chunk"]: np.frombuffer(r["sums"]) for r in summed}
    small = found.pop(-1)
    emissions = np.concatenate([found[k] for k in sorted(found)]).reshape(size, states)
    return Counts(small[:states].copy(), small[states:-1].reshape(states, states).copy(), emissions, float(small[-1]))


def _vocabulary(texts: DataFrame, head_words: int) -> tuple[dict[bytes, int], np.ndarray] | None:
    """The head of all ``texts`` (``text``) and how often each symbol occurs; None without texts."""
    with ExitStack() as held:
        corpus = _prepare(texts.withColumn("id", F.lit(None).cast("long")), F.lit(True), held, "id", "text", head_words)
    return (corpus.head, corpus.symbols) if corpus.symbols[0] else None


def fit(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES,
        iterations: int = ROUNDS, head_words: int = HEAD_WORDS, gain: float = GAIN) -> Model:
    """Train on the rows where ``training`` holds.

    The head vocabulary and the first parameters come from the word counts of all training texts;
    each iteration counts over all of them, in pieces of SEGMENT tokens that start from the state
    frequencies, until the log10 likelihood of a token gains less than ``gain``. Null and empty texts are just an end;
    without any training text the model knows no word.
    """
    with ExitStack() as held:
        return _train(_prepare(docs, training, held, id_col, text_col, head_words), states, iterations, gain)


def score(docs: DataFrame, model: Model, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probability of every whole text, and of the smoothed word frequencies for comparison.

    Returns ``id_col, training, n_tokens`` (words and one end), ``n_known`` (tokens seen in
    training), ``train_tokens``, ``base_score`` and ``score``. A null text is empty: one end. Rows
    that repeat are scored alike; other columns are ignored. Word counts are exact and cover all texts.
    """
    # The files of the encoded texts stay for the reader of the result, within its staging scope.
    return _scored(_prepare(docs, training, None, id_col, text_col, head=model.head), model, id_col)


def fit_and_score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES,
                  iterations: int = ROUNDS, head_words: int = HEAD_WORDS, gain: float = GAIN) -> DataFrame:
    """:func:`score` of a model that :func:`fit` makes of the same rows, which are read and encoded once."""
    corpus = _prepare(docs, training, None, id_col, text_col, head_words)
    return _scored(corpus, _train(corpus, states, iterations, gain), id_col)


def _scored(corpus: _Corpus, model: Model, id_col: str) -> DataFrame:
    kind = corpus.rows.schema["id"].dataType.simpleString()
    bare = Model({}, model.start, model.resume, model.transitions, model.emissions)
    names = ["id", "training", "n_tokens", "n_known", "train_tokens", "base_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("n_tokens").to_numpy()
            if not len(lengths):
                continue
            symbols = np.concatenate([_unpack(x, n, "<i4") for x, n in zip(
                batch.column("symbols").to_pylist(), lengths.tolist(), strict=True)])
            total = bare.forward(symbols, np.cumsum(lengths) - lengths, lengths) + batch.column("shares").to_numpy()
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(total)], [*names, "score"])

    done = corpus.rows.mapInArrow(run, f"id {kind}, training boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                       "base_score double, score double")
    return done.withColumnRenamed("id", id_col)
