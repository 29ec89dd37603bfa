"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.store import stored


def _towards_least(edges: DataFrame, all_neighbours: bool) -> DataFrame:
    """Tie neighbours of each node to the least of them; edges run from the larger to the smaller node.

    With ``all_neighbours`` the larger neighbours move, else the smaller ones.
    """
    if all_neighbours:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        rest = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        moved = rest.unionByName(least.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node reachable over the links ``(a, b)``; nodes without links are left out.

    Each round ties larger, then smaller neighbours to the least one; it ends when only stars are left, after about
    the logarithm of the longest path. Every node has at most one row.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    while True:
        edges = stored(_towards_least(_towards_least(edges, True), False), "edges")
        centres = edges.select(F.col("b").alias("a")).distinct()
        several = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        if edges.join(centres, "a", "left_semi").select("a").unionByName(several).isEmpty():
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
