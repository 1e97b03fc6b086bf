"""Running counts over a sorted frame, without a single task that sees all of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import lean, stored, tasks


def running(df: DataFrame, by: list, flag: str) -> DataFrame:
    """The frame and, in the order of by, how many earlier rows have the flag (hits) and how many have not (rest).

    The frame reads a stored table, which discard() deletes. Rows are dealt by range; each task counts its own, and the tasks' sums, a row for each task, go through the driver.
    """
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, hits, rest = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(flag)).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(own)
            more = np.arange(1, len(own) + 1) - upto
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hits + upto - own), pa.array(rest + more - (1 - own)), pa.array(np.full(len(own), part, np.int32)), pa.array(own)],
                names=[*batch.schema.names, "hits", "rest", "part", "own"],
            )
            if len(own):
                hits, rest = hits + int(upto[-1]), rest + int(more[-1])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", hits long, rest long, part int, own long"
    local = stored(df.repartitionByRange(tasks(spark), *by).sortWithinPartitions(*by).mapInArrow(lean(run), schema))
    sums = sorted(local.groupBy("part").agg(F.sum("own"), F.count("*")).collect())
    starts, hits, rest = [], 0, 0
    for part, a, n in sums:
        starts.append((part, hits, rest))
        hits, rest = hits + a, rest + n - a
    offsets = spark.createDataFrame(starts, "part int, hits0 long, rest0 long")
    out = local.join(F.broadcast(offsets), "part").select(*df.columns, (F.col("hits") + F.col("hits0")).alias("hits"), (F.col("rest") + F.col("rest0")).alias("rest"))
    out.stored_path = local.stored_path
    return out
