"""The published catalog: immutable versions on shared storage, and a pointer to the one that readers use."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"
#: Items of a file, at most; row groups hold runs of item_ids, so that a lookup reads one of them.
ITEMS_PER_FILE = 1_000_000


def scratch(spark: SparkSession) -> str:
    """Where queries may publish: the session's shared folder, and only where it names none (in local tests) one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = f"file://{tempfile.mkdtemp(prefix='lumengrid-store-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _fs(spark: SparkSession, path: str):  # noqa: ANN202  a Java object
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def kept(df: DataFrame, *by: str) -> DataFrame:
    """The frame written once to the shared folder and read back, so that what reads it again doesn't compute it again."""
    path = f"{scratch(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def release(spark: SparkSession) -> None:
    """Frees what was shuffled and cached, once nothing refers to it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(*frames: DataFrame) -> None:
    """Deletes what kept() wrote for these frames; what reads them must have been written by then."""
    for df in frames:
        place, fs = _fs(df.sparkSession, df.kept_path)
        fs.delete(place, True)


def publish(catalog: DataFrame, root: str) -> str:
    """Writes a version sorted by item_id, then moves the pointer to it; readers see the old version whole or the new one. Its path."""
    spark = catalog.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    by_id = catalog.repartitionByRange("item_id").sortWithinPartitions("item_id")
    by_id.write.option("maxRecordsPerFile", ITEMS_PER_FILE).parquet(f"{root}/{version}")
    beside, fs = _fs(spark, f"{root}/{POINTER}.{version}")
    out = fs.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    pointer, _ = _fs(spark, f"{root}/{POINTER}")
    fs.delete(pointer, False)
    if not fs.rename(beside, pointer):
        raise OSError(f"the pointer of {root} could not be moved")
    return f"{root}/{version}"


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version that the pointer names. A filter on item_id is pushed to its row groups."""
    pointer, fs = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(pointer):
        raise FileNotFoundError(f"nothing is published in {root}")
    version = spark.read.text(f"{root}/{POINTER}").first()[0]
    return spark.read.parquet(f"{root}/{version}")


def clean(spark: SparkSession, root: str) -> int:
    """Deletes the versions that the pointer doesn't name; how many. For times without readers of old versions."""
    current = spark.read.text(f"{root}/{POINTER}").first()[0]
    place, fs = _fs(spark, root)
    old = [s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith("v-") and s.getPath().getName() != current]
    for path in old:
        fs.delete(path, True)
    return len(old)


def lookup(spark: SparkSession, root: str, item_id: int) -> DataFrame:
    """One item of the published catalog, or no row."""
    return published(spark, root).where(F.col("item_id") == item_id)
