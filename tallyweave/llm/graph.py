"""Connected components of a graph of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of `links` (a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps. Each step needs only the smallest neighbour of a node, an aggregate with
    map-side combination, so a node with very many links is never gathered; in the joins the links of such a node are the skewed side, which Spark
    splits over tasks (spark.sql.adaptive.skewJoin), as the other side has one row for each node. Each round's links are written to the
    shared folder, which cuts the lineage. Rounds end when the links no longer change. No links give no rows; loops and repeated links change nothing.
    """
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = materialize(small.where("a <> b").distinct(), "links")
