"""Mixes sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are shuffled by a seeded hash and cut into blocks of ``block_tokens`` tokens.
The slots of the mix are the points of a golden-ratio sequence: each is mapped through the cumulative
weights to a source, ranked among the slots of its source, and joined with the block of that rank.
Ranks beyond a source's blocks begin its next epoch, so that any stretch of the mix has every source
close to its weight, and every document of a source is taken equally often, give or take once.

The sequence is close to the weights, not equal to them: a source's slots beyond its target take
nothing, and slots that it lacks follow at the end. The words taken are therefore the rounded target.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.operators.ranking import running_total
from sparkfeat.sources.staging import checked_broadcast, stage

WEIGHTS = (1, 2, 3)
EPOCHS = 3
BLOCK_TOKENS = 2048
SEED = 13
#: Points are k * GOLDEN modulo 2 ** POINT_BITS: the golden ratio's fraction in whole numbers.
POINT_BITS = 40
GOLDEN = 679_535_556_991
CELLS = 1 << 12
CHUNK_SLOTS = 1 << 20
_TOKEN = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """The tables of a mix: sources with targets, pieces of documents in blocks, and the schedule."""

    sources: DataFrame
    documents: DataFrame
    pieces: DataFrame
    slots: DataFrame


def token_count(text: Column) -> Column:
    """Words between blanks, tabs and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Targets of the sources in ``sizes`` (``source, source_size``, one row each).

    Adds ``number`` (by code point from 0, null last), ``weight`` (``weights`` repeating) and ``target``:
    shares of the whole by weight, where a source stops at ``epochs`` times its size and the excess is
    shared again by weight until none is above. Each round is one aggregate over the sources; only its sums
    reach the driver.
    """
    ordered = stage(sizes.withColumn("__null", F.col("source").isNull().cast("int")))
    numbered = running_total(ordered, F.lit(1), ["__null", "source"], out="number", group_limit=0).drop("__null")
    index = (F.col("number") % len(weights)).cast("int") + 1
    rows = stage(numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), index).cast("long")))
    limit, wide = epochs * F.col("source_size"), "decimal(20,0)"

    def is_above(rest: int, open_weight: int) -> Column:
        return F.col("weight").cast(wide) * F.lit(rest).cast(wide) > limit.cast(wide) * F.lit(open_weight).cast(wide)

    # Sources whose share of the level rest / open_weight is above their limit stop there, and the level rises.
    rest, open_weight, stopped = 0, 0, None
    while True:
        above = F.lit(False) if stopped is None else is_above(rest, open_weight)
        size, fixed, open_now, count = rows.agg(
            F.sum("source_size"), F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight"))),
            F.count(F.when(above, 1))).first()
        if count == stopped:
            break
        rest, open_weight, stopped = int((size or 0) - (fixed or 0)), int(open_now or 0), count
    level = F.col("weight") * F.lit(rest) / F.lit(max(open_weight, 1)).cast("double")
    above = is_above(rest, open_weight)
    return rows.withColumn("target", F.when(above, limit.cast("double")).otherwise(level))


def _points(k: Column) -> Column:
    """The ``k``-th point, without leaving 64 bits: ``k`` in two halves of 20 bits."""
    half, whole = 1 << (POINT_BITS // 2), 1 << POINT_BITS
    low, high = k % half, F.floor(k / half) % half
    return (low * GOLDEN + ((high * GOLDEN) % half) * half) % whole


def _schedule(sources: DataFrame, slots: int) -> DataFrame:
    """``slot, number, turn``: each point's source, and its rank among the slots of that source."""
    spark = sources.sparkSession
    whole, cell = 1 << POINT_BITS, (1 << POINT_BITS) // CELLS
    ends = running_total(sources.where("slots > 0"), F.col("slots"), ["number"], out="before", group_limit=0)
    bounds = ends.select("number", *[F.floor(x.cast("decimal(20,0)") * whole / slots).cast("long").alias(name) for name, x in (
        ("low", F.col("before")), ("high", F.col("before") + F.col("slots")))])
    # An interval lies in the cells it meets: at most CELLS more rows than sources.
    cells = stage(bounds.where("high > low").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell)))))
    points = spark.range(slots).select(F.col("id").alias("slot"), _points(F.col("id")).alias("point"))
    placed = points.withColumn("cell", F.floor(F.col("point") / cell)).join(checked_broadcast(cells), "cell").where(
        "point >= low AND point < high").select("slot", "number", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"))
    placed = stage(placed)
    # A source of any share is ranked in chunks of the schedule, each with the slots of the chunks before.
    counts = placed.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(counts.select("number", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    within = F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot")) - 1
    ranked = placed.withColumn("within", within).join(offsets, ["number", "chunk"]).select(
        "slot", "number", (F.col("offset") + F.col("within")).alias("turn"))
    kept = ranked.join(sources.select("number", "slots"), "number").where("turn < slots").select("slot", "number", "turn")
    have = counts.groupBy("number").agg(F.sum("n").alias("have"))
    lacking = sources.join(have, "number", "left").where(F.coalesce("have", F.lit(0)) < F.col("slots")).select(
        "number", F.explode(F.sequence(F.coalesce("have", F.lit(0)), F.col("slots") - 1)).alias("turn"))
    # Points miss an interval by a few only, so that this is a short tail; it keeps the order of the sources' turns.
    tail = running_total(stage(lacking), F.lit(1), ["turn", "number"], out="late", group_limit=0)
    return kept.unionByName(tail.select((F.col("late") + slots).alias("slot"), "number", "turn"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> Mix:
    """Plan the mix of all rows of ``docs``.

    Returns ``sources`` (``source, number, weight, source_size, target, slots``), ``documents`` (``row`` and
    the id, source and size of each row), ``pieces`` (``row, number, block, begin, end``: the tokens of a
    block that are a document's) and ``slots`` (``slot, number, turn, block, epoch, words``): slot by slot, the block
    of its source and how many of its words are taken, the whole block but for a source's last.

    A null text is empty, null ids count as the empty text in the shuffle, and a null source is a source of its
    own, the last. Rows that repeat are rows of their own. The order within a source depends on the seed and the ids;
    equal ids follow in the order of their sizes.
    """
    own = F.col(f"`{id_col}`")
    documents = stage(docs.select(
        own.alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), token_count(F.col(f"`{text_col}`")).alias("size"),
        F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))), 256), 1, 16).alias("shuffled"),
        F.monotonically_increasing_id().alias("row")))
    sizes = documents.groupBy("source").agg(F.sum("size").alias("source_size"))
    taken = F.round("target").cast("long")
    sources = stage(source_targets(sizes, weights, epochs).withColumns({
        "take": taken,
        # Whole epochs, and the blocks of the last one.
        "slots": F.when(F.col("source_size") > 0, F.floor(taken / F.col("source_size")) * F.ceil(F.col("source_size") / block_tokens)
                        + F.ceil((taken % F.expr("nullif(source_size, 0)")) / block_tokens)).otherwise(0).cast("long")}))
    placed = running_total(documents.where("size > 0"), F.col("size"), ["shuffled", "size", "row"], by=["source"],
                           out="before", group_limit=0)
    numbers = sources.select(F.col("source").alias("__source"), "number")
    placed = placed.join(checked_broadcast(numbers), F.col("source").eqNullSafe(F.col("__source")))
    last = F.col("before") + F.col("size") - 1
    pieces = stage(placed.withColumn("block", F.explode(
        F.sequence(F.floor(F.col("before") / block_tokens), F.floor(last / block_tokens)))).select(
        "row", "number", "block",
        F.greatest(F.col("before") - F.col("block") * block_tokens, F.lit(0)).alias("begin"),
        F.least(F.col("before") + F.col("size") - F.col("block") * block_tokens, F.lit(block_tokens)).alias("end")))
    slots = int(sources.agg(F.sum("slots")).first()[0] or 0)
    turns = _schedule(sources, slots) if slots else sources.sparkSession.createDataFrame([], "slot long, number long, turn long")
    blocks = F.ceil(F.col("source_size") / block_tokens)
    epoch, block = F.floor(F.col("turn") / blocks), F.col("turn") % blocks
    left = F.col("take") - epoch * F.col("source_size") - block * block_tokens
    words = F.least(left, F.col("source_size") - block * block_tokens, F.lit(block_tokens))
    schedule = stage(turns.join(checked_broadcast(sources.select("number", "source_size", "take")), "number").select(
        "slot", "number", "turn", block.cast("long").alias("block"), epoch.alias("epoch"), words.cast("long").alias("words")))
    return Mix(sources, documents, pieces, schedule)


def taken(plan: Mix, id_col: str = "doc_id", epochs: int = EPOCHS) -> DataFrame:
    """``id_col, size, source_size, target, taken`` of every row: the words that all slots take of it.

    A block's slots, at most one an epoch, are added up first, so that the join with its pieces is one to many.
    """
    by_block = plan.slots.groupBy("number", "block").agg(F.sort_array(F.collect_list("words")).alias("reach"))
    part = F.aggregate("reach", F.lit(0).cast("long"), lambda sum_, w: sum_ + F.greatest(
        F.least(w, F.col("end")) - F.col("begin"), F.lit(0)))
    by_row = plan.pieces.join(by_block, ["number", "block"]).groupBy("row").agg(F.sum(part).alias("taken"))
    of_source = plan.sources.select(F.col("source").alias("__source"), "source_size", "target")
    return plan.documents.join(checked_broadcast(of_source), F.col("source").eqNullSafe(F.col("__source"))).join(
        by_row, "row", "left").select(F.col("id").alias(id_col), "size", "source_size", "target",
                                      F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
