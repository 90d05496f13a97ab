"""Distributed union-find: connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Edges that a task writes: rounds over few edges cost little but their tasks.
EDGES = 200_000


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Large star: the larger neighbours of a node point to its least neighbour. Small star: the smaller ones and itself."""
    if both_ways:
        arcs = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        arcs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = arcs.join(least.withColumnRenamed("a", "centre"), F.col("a") == F.col("centre"))
    if both_ways:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (least node of its component) for every node with an edge. ``edges`` has a and b, longs.

    Each round is written to the shared folder, so lost executors cost one round at most.
    """
    edges = stored(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        edges = stored(_star(_star(edges, True), False).coalesce(before[0] // EDGES + 1))
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
