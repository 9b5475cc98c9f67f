"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every node hands its larger neighbours its least one. Small star: every node hands its smaller ones, and itself, the least."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = near.where("b > a").join(least, "a").select("m", F.col("b").alias("x"))
    else:
        near = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        moved = near.join(least, "a").select("m", F.col("b").alias("x")).unionByName(least.select("m", F.col("a").alias("x")))
    return moved.where("m < x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """edges: a, b with a < b. Result: node, component (its least node) for every node that has an edge.

    Each round writes its edges, so no lineage grows and a lost executor costs a round at most. Rounds
    end when nothing moves; their number grows with the logarithm of the longest chain. Hubs are no
    trouble: least neighbours are pre-aggregated, and Spark splits a hub's rows in the join.
    """
    at = staged(edges.select("a", "b"), "edges")
    before = _mark(at)
    for _ in range(most):
        if not before[0]:
            break
        at = staged(_stars(_stars(at, True), False), "edges")
        now = _mark(at)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {most} rounds")
    stars = at.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(at.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
