"""Connected components of a link table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinor.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (its smallest id) of every linked id. Large-star and small-star steps in turn until the links no longer
    change: each is a grouped minimum and a join, so a hub is summed up before it travels, and rounds grow with the logarithm of
    the longest chain. Only a count and a checksum of the links reach the driver."""
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges, before = cut_lineage(links.filter(F.col(a) != F.col(b)).select(u, v).distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
