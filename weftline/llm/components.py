"""Connected components of a DataFrame of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are tied to the smallest node around it: larger ones (large star) or the rest (small star)."""
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # the smallest neighbour comes from a combining aggregate and joins back, so a hub's links meet in no one task
    low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    tied = near.join(low, "a")
    if large:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    return tied.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (columns a and b of one orderable type); root is the smallest node reachable.

    Self-links and repeated links change nothing but that their nodes are listed; nulls are not allowed.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(rounds):
        after = materialise(_star(_star(now, True), False), "links")
        # both stars leave a set of stars alone: the same links twice mean the end
        if after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty():
            discard(after)
            break
        discard(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
