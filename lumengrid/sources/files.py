"""Readers and writers of the raw formats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RATINGS = "user_id INT, item_id INT, rating DOUBLE, timestamp LONG"
EXPORT = "adult BOOLEAN, id LONG, original_title STRING, popularity DOUBLE, video BOOLEAN"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, escape='"')


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Plain or gzipped; a schema saves the pass that would infer one."""
    return spark.read.schema(schema).json(path)


def by_year(ratings: DataFrame) -> DataFrame:
    return ratings.withColumn("rating_year", F.year(F.from_unixtime("timestamp")))


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """One file for each partition value and task of its own."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def with_shard(vectors: DataFrame, rows: int) -> DataFrame:
    """vectors and shard: so many rows by ascending item_id each; places come from counts by range of ids, so that no single task sorts everything."""
    ranged = vectors.withColumn("range", F.floor(F.col("item_id") / (rows * 64)))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("item_id")) - 1
    return ranged.join(before, "range").withColumn("shard", F.floor(place / rows).cast("int")).drop("range", "before")


def write_shards(vectors: DataFrame, path: str, rows: int) -> int:
    """Shards of so many rows by ascending item_id, written in place of all that the path held; their number.

    They are written beside the path and take its place once every shard has its rows, so that neither a cut-off write nor shards of an
    earlier, larger set are ever read.
    """
    spark = vectors.sparkSession
    beside = f"{path}.part-{uuid.uuid4().hex}"
    with_shard(vectors, rows).repartition("shard").sortWithinPartitions("item_id").write.partitionBy("shard").parquet(beside)
    sizes = dict(spark.read.parquet(beside).groupBy("shard").count().collect()) if not vectors.isEmpty() else {}  # a row for each shard
    if any(n != rows for shard, n in sizes.items() if shard < len(sizes) - 1) or sorted(sizes) != list(range(len(sizes))):
        raise ValueError(f"shards are not whole: {sizes}")
    swap(spark, beside, path)
    return len(sizes)


def swap(spark: SparkSession, new: str, path: str) -> None:
    """A written folder takes the place of another one, by renaming."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(hadoop(new), target):
        raise OSError(f"{new} could not be renamed to {path}")
