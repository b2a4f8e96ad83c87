"""Connected components of a graph given by its links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import Written


def components(links: DataFrame) -> DataFrame:
    """For links(a, b): node and component, the smallest node reachable; only nodes with a link to another node appear.

    Each step is written to the shared folder and the tables before it are deleted. Rounds grow with the logarithm of the longest path; nothing
    but two sums reaches the driver. The smallest neighbours are a table of their own before each join, so that Spark can split the join at a
    node with very many links (its skew join takes two plain shuffles). Null ends and loops are ignored; links may repeat; other columns are
    ignored; no links give no rows.
    """
    write = Written(links.sparkSession)
    edges, before = write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct(), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        again = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(again, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = write(small.unionByName(again.withColumnRenamed("m", "v")).distinct(), "links")
        write.drop(edges, least)
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("s")).first()
        edges = new
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
