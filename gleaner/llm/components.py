"""Connected components by alternating large-star and small-star steps; edges stay in tables throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written

#: Edges up to which a step joins plainly: no key can have more rows than that.
FEW = 1_000_000


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root (the least node it is linked to) of every node of edges (u, v), two longs; loops are let go.

    Each step links a node's larger (large-star) or smaller (small-star) neighbours to the least of them; both shrink
    every component to a star round its least node in O(log n) steps. The least neighbour is an aggregate with partial
    sums, so a node with many neighbours costs one row a task. Beyond FEW edges, nodes with many neighbours meet theirs
    by a bounded broadcast, so that a hub's edges stay dealt over all tasks.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = _state(e)

    def met(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.join(least.drop("n"), "u") if before[0] <= FEW else join_hot(rows, written(least), ["u"], "n")

    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = written(met(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = met(large, least).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        e = written(small.filter("u <> v").distinct())
        after = _state(e)
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
