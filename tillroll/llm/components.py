"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u, v) with u > v.

    Large: every larger neighbour of a node moves to the node's smallest neighbour (or itself).
    Small: every smaller neighbour does, and the node too. The minima are stored apart, so the
    join's two sides are plain exchanges, which adaptive execution may split at a hub.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = checkpointed(both.groupBy("u").agg(F.min("v").alias("least")))
    near = both.join(least, "u")
    root = F.least("u", "least")
    if large:
        moved = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), root.alias("v"))
    else:
        moved = near.select(F.col("v").alias("u"), root.alias("v")).unionByName(
            near.select("u", root.alias("v")))
    return moved.where("u != v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the smallest node it reaches.

    Empty links give no rows; self-links and repeated links count once. The number of rounds
    grows with the logarithm of the longest path, and only row counts reach the driver.
    """
    larger = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = checkpointed(larger.distinct())
    state = None
    while True:
        now = checkpointed(_star(_star(now, large=True), large=False))
        # a sum of hashes tells whether the links still change
        last, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
