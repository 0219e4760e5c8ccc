"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, hot_join, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is the smallest node it can reach.

    Large-star and small-star steps alternate (Kiveris et al. 2014) until every
    node points at its label. A node's smallest neighbour is found with a
    map-side combined minimum and sent back by a join that deals the links of a
    node with very many over several tasks. Each half round is written out: its
    lineage doesn't grow.
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = hot_join(both.where("b > a"), low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = materialize(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = hot_join(down, low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        # Done when all links lead straight to a root: none of their ends has a link of its own.
        onward = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("b")
        split = after.groupBy("a").count().where("count > 1").select("a")
        discard(edges, down)  # each round was computed from it when it was written
        edges = after
        if not onward.union(split).limit(1).count():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
