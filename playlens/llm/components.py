"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import shared_folder


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the node's smallest one."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the smallest of them; ``a > b`` in every edge."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(low, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` with the smallest node ``b`` of its component for every node but that one.

    Edges are pairs ``a, b`` of ids in any order; loops and repeats don't matter.  Large and
    small stars alternate until every node hangs on its component's smallest one, in about as
    many rounds as the logarithm of the graph's width.  Every round is a checkpoint.
    """
    shared_folder(edges.sparkSession)
    tidy = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = tidy.distinct().checkpoint()
    state = None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(row) == state or not row[0]:
            return now
        state = tuple(row)
        now = _small_star(_large_star(now).distinct()).distinct().checkpoint()
