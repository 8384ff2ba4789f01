"""Connected components by alternating large-star and small-star passes, no neighbour list ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a long, b long)``; the root is the component's least node.

    Each pass replaces edges by edges to the least neighbour: a minimum by node, combined before the
    shuffle, joined back to the edges, so that a hub's edges can be split over tasks. No side is broadcast: files of stars shrink so far that
    Spark would send millions of rows through the driver. Passes repeat until
    the edges are stars that no longer change, some log of the nodes of the largest component.
    """
    now = scratch.write(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct(), "edges-0")
    step, last = 0, None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
        if state == last or not state.n:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo")).distinct()
        last, step = state, step + 1
        large = scratch.write(_large_star(now), f"large-{step}")
        new = scratch.write(_small_star(large), f"edges-{step}")
        scratch.drop(f"large-{step}", f"edges-{step - 1}")
        now = new


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its greater neighbours to the least of its neighbourhood."""
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least.hint("merge"), "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least.hint("merge"), "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).filter("lo < hi")
    return moved.union(least.select(F.col("m").alias("lo"), "hi")).distinct()
