"""What the quality stage holds at once, and what executors give back between stages."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lumengrid.llm import common, kneserney


class Mapped:
    """Stands for a frame: keeps the function that it would be mapped by."""

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def test_postings_hold_little_beside_the_text():
    words = np.random.default_rng(5).integers(97, 123, (400, 5000), dtype=np.uint8)
    batch = pa.record_batch([pa.array(range(400), pa.int64()), pa.array([w.tobytes().decode() for w in words])], names=["doc_id", "text"])
    run = kneserney.postings(Mapped(), 8, 16).run
    tracemalloc.start()
    try:
        rows = sum(x.num_rows for x in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 8 and peak < 50 * batch.nbytes


def test_stages_begin_with_a_collection(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    before = full()
    common.settle(spark)
    assert full() > before
    begun = []
    monkeypatch.setattr(corpus_pipeline, "settle", lambda s: begun.append(s) or 1 / 0)
    for _, stage in corpus_pipeline.STAGES:
        try:
            stage(spark, None, "")
        except ZeroDivisionError:
            pass
    assert begun == [spark] * 5
