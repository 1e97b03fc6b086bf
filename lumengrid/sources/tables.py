"""Relations that the ranking queries read, derived from the star-schema tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """user_id, item_id, rating (0.5 to 5.0 in halves) and ts (epoch seconds), one row per user and item.

    by_user: dealt by user_id once, which serves the grouping here and windows over users behind it.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    bought = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), "l_quantity", "o_orderdate")
    if by_user:
        bought = bought.repartition("user_id")
    return bought.groupBy("user_id", "item_id").agg((F.max(F.ceil(F.col("l_quantity") / 5)) / F.lit(2.0)).cast("double").alias("rating"), F.max(F.unix_timestamp("o_orderdate")).alias("ts"))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, title with its year, genres joined by bars."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.concat("p_name", F.lit(" ("), (F.lit(1970) + F.col("p_size")).cast("string"), F.lit(")")).alias("title"), F.concat_ws("|", "p_type", "p_brand").alias("genres")
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_partkey") % 97 != 0, F.col("p_partkey") + 100000).alias("external_id"))


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 100000).alias("external_id"), F.col("p_name").alias("original_title"), F.col("p_retailprice").alias("popularity"), (size % 11 == 0).alias("adult"), (size % 13 == 0).alias("video")
    )


def genome_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevance = F.round(F.avg("l_discount") * 10, 6) + F.lit(0.0)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("tag_id")).agg(relevance.alias("relevance"))


def genome_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tag_id"), F.col("s_name").alias("tag"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed factors for checks: the vectors of the item before, none where the label is 9."""
    return table(spark, sf_dir, "embeddings").where("label <> 9").select((F.col("vec_id") + 1).alias("item_id"), F.col("embedding").cast("array<double>").alias("factor"))
