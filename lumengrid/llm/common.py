"""What the operators share: sessions, reading, shared storage."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch; texts are long, so that fewer rows than Spark's default fit a worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches; find the checkpoint folder, making one only where the session names none."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_dir(spark)
    return spark


def settle(spark: SparkSession) -> None:
    """Executors collect their garbage, by a task for each core, and give heap back to the system: what one step's peak took would lie beside the workers of all later ones."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; without a setting, a temporary one, for local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = f"file://{tempfile.mkdtemp(prefix='lumengrid-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The frame written once to shared storage and read back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    gc.collect()  # frees what earlier steps shuffled, once nothing refers to it
    df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for these frames; all that reads them must have been written by then."""
    for df in frames:
        remove(df.sparkSession, df.stored_path)


#: What workers keep between tasks, by the module that fills it, and how it is emptied.
KEEPERS = {"lumengrid.llm.bpe": lambda m: m._coders.clear(), "lumengrid.llm.packing": lambda m: m._loaded.clear(), "lumengrid.llm.secrets": lambda m: m.ranks.cache_clear()}
_serves: list[str] = []


def take_over(owner: str) -> None:
    """Empties what other operators have kept in this worker, once it serves another one: it would lie beside that one's own until the worker ends."""
    if _serves != [owner]:
        for name, empty in KEEPERS.items():
            if name != owner and name in sys.modules:
                empty(sys.modules[name])
        _serves[:] = [owner]


def lean(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives back to the system, at its end, what allocators hold: workers live on and serve other steps."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(run.__module__)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text, null as empty; all other columns are left out, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of labels up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def with_trusted(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The frame with a column trusted: whether some label gives its doc_id quality 1."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    good = good.withColumn("trusted", F.lit(True))
    if good.count() <= BROADCAST_ROWS:
        good = F.broadcast(good)
    return df.join(good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def slices(values: list[str], limit: int = 4 << 20) -> Iterator[list[str]]:
    """Runs of texts of about limit characters, or one longer text."""
    held, size = [], 0
    for x in values:
        held.append(x)
        size += len(x)
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


#: Ranges of bytes or words up to which spans are broadcast.
BROADCAST_RANGES = 200_000


def merged_spans(spans: DataFrame) -> DataFrame:
    """doc_id and spans, where ranges that touch have become one; in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(1).to_pylist():
                runs: list[dict] = []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in found):
                    if runs and lo <= runs[-1]["hi"]:
                        runs[-1]["hi"] = max(runs[-1]["hi"], hi)
                    else:
                        runs.append({"lo": lo, "hi": hi})
                out.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], names=["doc_id", "spans"])

    return spans.select("doc_id", "spans").mapInArrow(lean(run), "doc_id long, spans array<struct<lo: long, hi: long>>")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with a column spans, null where nothing goes; few ranges are broadcast, many are joined by a shuffle."""
    if (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_RANGES:
        spans = F.broadcast(spans)
    else:
        spans = spans.hint("merge")
    return docs.join(spans, "doc_id", "left")


def only(df: DataFrame, ids: DataFrame, by: str) -> DataFrame:
    """Rows whose id is among distinct ids; those are broadcast up to BROADCAST_ROWS, else both sides are shuffled."""
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, by, "left_semi")
