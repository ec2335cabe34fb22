"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import HOT_SHARE
from sparkfeat.operators.ranking import GROUP_LIMIT
from sparkfeat.sources.staging import stage


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Large star: larger neighbours move to the smallest neighbour; small star: smaller ones do.

    ``total`` is about the number of edges. Where they are too many for a task, the few vertices with a large share of
    them, the centres of stars, are broadcast with their smallest neighbour, so that their edges stay where they are.
    """
    ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    ends = ends.where("u != v")
    if not large:
        ends = ends.where("v < u")
    least = ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    moving = ends.where("v > u") if large else ends
    if total <= GROUP_LIMIT:
        moved = moving.join(least.drop("n"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved if large else moved.unionByName(least.select("u", F.col("m").alias("v")))
    centres = F.broadcast(least.where(F.col("n") * HOT_SHARE > total).select("u", "m"))
    rest = moving.join(centres.select("u"), "u", "left_anti").join(least.drop("n"), "u")
    moved = moving.join(centres, "u").unionByName(rest).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved if large else moved.unionByName(least.select("u", F.col("m").alias("v")))


def _print(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """``u, v`` for each vertex ``u`` of ``edges(u, v)`` but the smallest of its component, ``v``.

    Alternates large and small stars, each round written to the shared folder, until the edges no
    longer change. The rounds grow with the logarithm of the size of a component.
    """
    current = stage(edges.where("u != v").select("u", "v").distinct())
    seen = _print(current)  # stars with their smallest vertex as the centre are done after one round
    while seen[0]:
        current = stage(_star(_star(current, True, seen[0]), False, seen[0]).where("u != v").distinct())
        now = _print(current)
        if now == seen:
            break
        seen = now
    return current
