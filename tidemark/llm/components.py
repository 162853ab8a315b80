"""Connected components of an edge table by alternating large and small stars; every round ends in a shared table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the smallest node that it reaches.

    Nodes are longs; loops and repeated edges don't matter.  A hub's edges are reduced by ``min`` before they meet, and joins
    on a hub can be split, as each row needs only the hub's minimum.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        # Large star: every larger neighbour of a node points to the smallest of its neighbourhood.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        following = written(small, name)
        changed = following.join(now, ["a", "b"], "left_anti").limit(1).count() or now.join(following, ["a", "b"], "left_anti").limit(1).count()
        forget(now)
        now = following
        if not changed:
            break
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
