"""Connected components of an edge table by alternating large and small stars, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import discard, stored


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable), stored, for each node of the edges (u, v); loops and repeated edges are allowed."""
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before, sign = None, _sign(now)
    while sign != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
        before, sign = sign, _sign(now)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = stored(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots))
    discard(now)
    return out
