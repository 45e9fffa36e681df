"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Shelf


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's greater neighbours move to its least neighbour (or itself).
    Small star: its smaller neighbours, and it, move to the least of them."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b bigint); root is its component's least node.

    Each round is cut in the shared folder; it ends when a round changes no edge.
    """
    now = shelf.put(edges.where("a != b").select("a", "b").distinct(), "edges", collect_garbage=False)
    mark = None
    while True:
        new = shelf.put(_star(_star(now, large=True), large=False), "star", collect_garbage=False)
        # sums of hashes say whether the edge set changed, without a join
        said = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        shelf.drop(now)
        now = new
        if said == mark:
            break
        mark = said
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
