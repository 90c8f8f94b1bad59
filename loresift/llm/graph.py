"""Connected components by alternating large and small stars, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm.common import cut, discard


def _stamp(edges: DataFrame) -> tuple:
    """The number of edges and two 64-bit hash sums of them."""
    sums = [F.sum(F.xxhash64(F.lit(i), "x", "y").cast("decimal(20,0)")) for i in (0, 1)]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; the component is its least node.

    Null ends, loops and repeated edges are ignored; an empty table gives an empty one.  A node of
    any degree is safe: minima are pre-aggregated, and joins on a hot node can be split by AQE.
    """
    x, y = F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")
    e = cut(edges.where("a is not null and b is not null and a <> b").select(x, y).distinct())
    before = _stamp(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.select(F.col("x").alias("u"), F.col("y").alias("v")).union(e.select(F.col("y").alias("u"), F.col("x").alias("v")))
        # minima are written, so that AQE can split the joins on a hot node
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        large = cut(large)
        below = cut(large.groupBy("x").agg(F.min("y").alias("m")))
        small = large.join(below, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(below.select("x", F.col("m").alias("y")))
        was, e = e, cut(small.distinct())
        discard(was, least, large, below)
        now = _stamp(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    found = e.groupBy("x").agg(F.min("y").alias("component")).select(F.col("x").alias("node"), "component")
    return found.union(e.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
