"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, release


def _stars(edges: DataFrame) -> bool:
    """Whether every node (u, v) is either a centre or has one link, to a centre."""
    ends = edges.select("u", F.lit(1).alias("n")).unionByName(edges.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(2)))
    return ends.groupBy("u").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter("n > 1 and not (n = 2 and most = 2)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v); component is its smallest node.

    Alternates large-star and small-star steps until the links are stars. A node with many
    links is one aggregate and one join that Spark may split, never a gathered list; rounds
    grow with the logarithm of a component's size.
    """
    turned = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(turned.distinct(), "links")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = materialize(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        release(large, now)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
