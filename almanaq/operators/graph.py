"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanaq.sources.tables import discard, materialise


def connected(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges (a, b)``; a component's name is its smallest node.

    Edges are rewired, in turn, from the larger neighbours of each node to its smallest one, and from the smaller ones
    and the node itself, until every edge leads to the smallest node of its component. Neighbours are never listed: a
    node's smallest one is an aggregate that is joined back. A written table per step, the one before is deleted.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    alone = edges.where("a = b").select("a").distinct()
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        # the larger neighbours of each node lead to the smallest of all
        large = materialise(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        # the smaller neighbours, and the node, lead to the smallest one
        new = materialise(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).distinct())
        several = new.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        onward = new.join(new.select(F.col("a").alias("b")), "b", "left_semi")
        done = several.isEmpty() and onward.isEmpty()
        discard(now, large)
        now = new
        if done:
            break
    named = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
    rest = alone.join(named.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return named.union(rest)
