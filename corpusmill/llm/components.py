"""Connected components of a graph of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(id, component)`` for every node of ``links (a, b)``: the smallest node it can reach.

    Links point from a node to smaller ones. Each step hangs the smaller ends on the smallest node
    they know themselves, and then all smaller neighbours of a node on the smallest of them, which
    keeps what is connected together, until every node has one link to a node without any. Nodes
    that many others hang on are never a key that rows are gathered by, only one side of a plain
    join, which the adaptive planner splits.
    """
    if scratch is None:
        with Scratch(links.sparkSession, "components") as own:
            return own.finish(components(links, own))
    links = scratch.store(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("v < u").distinct(), "links"
    )
    told = None
    while True:
        # The smallest neighbour of every node that has smaller ones.
        least = scratch.store(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        higher = links.join(least.select(F.col("u").alias("v"), F.col("m").alias("up")), "v", "left")
        large = higher.select("u", F.coalesce("up", "v").alias("v"))
        # The direct link to the old end is kept as one between the two ends.
        large = large.union(higher.where("up IS NOT NULL").select(F.col("v").alias("u"), F.col("up").alias("v"))).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        both = large.join(root, "u")
        small = both.select(F.col("v").alias("u"), F.col("m").alias("v")).where("v < u").union(root.select("u", F.col("m").alias("v")))
        after = scratch.store(small.distinct(), "links")
        scratch.drop(links)
        scratch.drop(least)
        links = after
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == told:
            break
        told = now
    # A node without smaller neighbours is its own component.
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
