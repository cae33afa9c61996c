"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge: the root is the component's smallest node.

    Each round hangs larger neighbours, then smaller ones, on the smallest node in reach, until
    nothing moves; the number of rounds grows with the logarithm of the longest path. Neighbours
    are never gathered: a round is an aggregate and a join, whose hot hubs adaptive execution
    splits. Every round is cut, so a lost executor costs a round at most. Loops are dropped and
    nulls are no nodes; no edges give no rows.
    """
    a, b = F.col(f"`{left}`"), F.col(f"`{right}`")
    now = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(now)
    while True:
        now = cut(_small(_large(now)))
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Changes with every move: a node's edge only ever goes to a smaller node, or is dropped."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node go to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, go to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
