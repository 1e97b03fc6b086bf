"""Substring deduplication over words with a log-structured fingerprint index.

A window is SIZE successive words of a document; a word goes if a window over it has the same words as one that
starts earlier. Of each window's runs of GRAM words the one of least hash (the last of equal ones) is its anchor,
so equal windows have equal anchors, and successive windows mostly share one.

1. Anchors of a batch of documents become a run of the index: (key, id, nth), dealt into buckets by key and sorted by it,
   written once and never changed. The batch is merge-joined with each run of history, which needs no shuffle of old runs.
2. Verified: the windows of an anchor that met another are compared by two 64-bit hashes over words that are hashed twice
   by themselves, all windows of an anchor at once, then one by one where anchors agree and their surroundings don't.
3. Compaction merges runs into one once there are MOST of them. deduplicate() takes its documents in BATCHES by ascending
   doc_id, each judged against itself and the index that the ones before have left.

Texts that occur twice in a batch are all removed but the one of smallest doc_id, which stands for them. A null text has no words.
Documents under SIZE words keep everything. A doc_id must not have two different texts. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.llm import textkernel as tk
from lumengrid.llm.common import discard, lean, merged_spans, only, remove, shared_dir, stored, tasks, texts, with_spans

#: Words of a window and of an anchor, batches of a load, runs before compaction.
SIZE, GRAM, BATCHES, MOST = 20, 10, 2, 2
SPAN = SIZE - GRAM + 1


class Windows:
    """Anchors (word places) of one document's windows, and which windows lo to hi have each."""

    def __init__(self, hashes: np.ndarray, again: np.ndarray | None = None) -> None:
        grams = tk.window_hashes(hashes, GRAM)
        shown = np.lib.stride_tricks.sliding_window_view(grams, SPAN)[:, ::-1]
        of = np.arange(len(shown)) + SPAN - 1 - shown.argmin(axis=1)
        self.at = np.unique(of)
        self.keys = grams[self.at].astype(np.int64)
        self.lo = np.searchsorted(of, self.at, "left")
        self.hi = np.searchsorted(of, self.at, "right") - 1
        self.sums = tk.prefix(hashes)
        self.more = None if again is None else tk.prefix(again)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = salt.astype(np.uint64)
        return tk.mix(tk.range_hash(self.sums, starts, ends, 11) ^ s).astype(np.int64), tk.mix(tk.range_hash(self.more, starts, ends, 13) + s).astype(np.int64)


def _documents(batch: pa.RecordBatch, column: int, twice: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    for c in tk.chunks(batch.column(column)):
        w = tk.words(c)
        hashes, again = tk.word_hashes(c, w), tk.word_hashes(c, w, seed=1) if twice else None
        for k in range(c.hi - c.lo):
            own = slice(w.first[k], w.first[k + 1])
            yield c.lo + k, hashes[own], again[own] if twice else None


def anchored(plain: DataFrame) -> DataFrame:
    """doc_id, n (words), a and b (a 128-bit hash of the text), and keys by place (null for short documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [np.frombuffer(hashlib.sha256(x.encode()).digest()[:16], dtype=np.int64) for x in batch.column(1).to_pylist()]
            n, found = [], []
            for _, hashes, _ in _documents(batch, 1):
                n.append(len(hashes))
                found.append(Windows(hashes).keys.tolist() if len(hashes) >= SIZE else None)
            arrays = [batch.column(0), pa.array(n, pa.int64()), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "a", "b", "keys"])

    return plain.mapInArrow(lean(run), "doc_id long, n long, a long, b long, keys array<long>")


class Run:
    """An immutable part of the index: a table of (key, id, nth: the document's nth anchor) in buckets by key, sorted, on shared storage."""

    def __init__(self, entries: DataFrame) -> None:
        self.spark = entries.sparkSession
        self.name, buckets = f"run_{uuid.uuid4().hex}", tasks(self.spark)
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        dealt = entries.select("key", "id", "nth").repartition(buckets, "key")
        dealt.write.bucketBy(buckets, "key").sortBy("key").option("path", self.path).saveAsTable(self.name)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def compact(runs: list[Run]) -> list[Run]:
    """Several runs as one; the old ones are deleted."""
    if len(runs) < MOST:
        return runs
    merged = runs[0].rows
    for r in runs[1:]:
        merged = merged.unionByName(r.rows)
    out = Run(merged)
    for r in runs:
        r.drop()
    return [out]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, hashes, again in _documents(batch, 1, twice=True):
            w = Windows(hashes, again)
            i = batch.column(2)[k].values.to_numpy()
            lo, hi = w.lo[i], w.hi[i]
            a, b = w.hashes(lo, hi + SIZE, (w.at[i] - lo) << 16 | (hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), batch.column(0)[k].as_py()), pa.int64()), *(pa.array(x) for x in (lo, hi, w.keys[i], a, b))], names=["id", "lo", "hi", "key", "a", "b"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, hashes, again in _documents(batch, 1, twice=True):
            w = Windows(hashes, again)
            ranges = batch.column(2)[k].values
            lo, hi = (ranges.field(f).to_numpy() for f in ("lo", "hi"))
            many = hi - lo + 1
            p = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            a, b = w.hashes(p, p + SIZE, np.zeros(len(p), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), batch.column(0)[k].as_py()), pa.int64()), pa.array(p), pa.array(a), pa.array(b)], names=["id", "p", "a", "b"])


def removed_spans(docs: DataFrame, index: list[Run] | None = None, history: DataFrame | None = None) -> tuple[DataFrame, Run]:
    """doc_id and spans (word ranges lo to hi to remove), and the run that the documents add to the index.

    The documents of an index (history: doc_id and text, ids other than those of docs) count as earlier ones.
    """
    plain = texts(docs)
    full = stored(anchored(plain))
    wide = stored(full.groupBy("a", "b", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min_by("keys", "doc_id").alias("keys")))
    signed, distinct = stored(full.drop("keys")), stored(wide.drop("keys"))
    run = Run(wide.where("keys is not null").select("id", F.posexplode("keys").alias("nth", "key")))
    discard(full, wide)
    keys = run.rows.groupBy("key").agg(F.count("*").alias("n"))
    met, old = keys.where("n > 1").select("key"), None
    for r in index or []:
        hits = r.rows.join(run.rows.select("key"), "key", "left_semi")
        old = hits if old is None else old.unionByName(hits)
    if old is not None:
        old = stored(old)
        met = met.unionByName(old.select("key")).distinct()
    met = stored(met)  # written, so that the join can split a hot key
    entries = run.rows.join(met, "key", "left_semi").select("id", "nth")
    if old is not None:
        entries = entries.unionByName(old.select("id", "nth"))
    listed = stored(entries.groupBy("id").agg(F.array_sort(F.collect_set("nth")).alias("nth")))
    bodies = plain.select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("new"))
    if history is not None:
        bodies = bodies.unionByName(texts(history).select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("new")))
    bodies = stored(only(bodies, listed.select("id"), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("new").alias("new")))
    found = bodies.join(listed, "id").select("id", "text", "nth").mapInArrow(lean(_contexts), "id long, lo long, hi long, key long, a long, b long")
    found = stored(found.join(bodies.select("id", "new"), "id"))
    groups = stored(found.groupBy("key", "a", "b").agg(F.count("*").alias("n"), F.min(F.struct("new", "id", "lo", "hi")).alias("m")))
    place = F.struct("new", "id", "lo", "hi")
    later = found.join(groups.where("n > 1").select("key", "a", "b", "m"), ["key", "a", "b"]).where(place != F.col("m")).select("id", "lo", "hi")
    several = groups.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    ranges = groups.join(several, "key").groupBy(F.col("m.id").alias("id")).agg(F.collect_list(F.struct("m.lo", "m.hi")).alias("ranges"))
    single = bodies.join(ranges, "id").select("id", "text", "ranges").mapInArrow(lean(_windows), "id long, p long, a long, b long")
    single = stored(single.join(bodies.select("id", "new"), "id"))
    first = single.groupBy("a", "b").agg(F.min(F.struct("new", "id", "p")).alias("m"), F.max(F.struct("new", "id", "p")).alias("z")).where("m <> z")
    one = single.join(first, ["a", "b"]).where(F.struct("new", "id", "p") != F.col("m")).select("id", F.col("p").alias("lo"), F.col("p").alias("hi"))
    gone = later.unionByName(one).groupBy("id").agg(F.collect_set(F.struct("lo", (F.col("hi") + SIZE).alias("hi"))).alias("spans"))
    gone = gone.join(distinct.select("id"), "id", "left_semi").select(F.col("id").alias("doc_id"), "spans")
    # copies: the first keeps what its own windows leave
    copies = signed.select("doc_id", "a", "b", "n").join(distinct.where(f"copies > 1 and n >= {SIZE}").select("a", "b", "n", "id"), ["a", "b", "n"])
    copies = copies.where("doc_id <> id").select("doc_id", F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))).alias("spans")).dropDuplicates(["doc_id"])
    out = stored(merged_spans(gone.unionByName(copies)))
    discard(signed, distinct, met, listed, bodies, found, groups, single, *([old] if old is not None else []))
    return out, run


def load(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """removed_spans() of all documents, batch by batch against the index so far, which is deleted at the end."""
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)]).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    place = F.col("doc_id").cast("long")
    index: list[Run] = []
    out = None
    for k in range(len(cuts) + 1):
        above = (place > cuts[k - 1]) if k else F.lit(True)
        upto = (place <= cuts[k]) if k < len(cuts) else F.lit(True)
        own = docs.where((above & upto) if k else (upto | place.isNull()))
        index = compact(index)
        spans, run = removed_spans(own, index, docs.where(place <= cuts[k - 1]) if k else None)
        index = [*index, run]
        out = spans if out is None else out.unionByName(spans)
    for r in index:
        r.drop()
    return out


def deduplicate(docs: DataFrame, index: list[Run] | None = None, history: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and kept (the words left, joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split()  # of bytes: at [\x20\x09-\x0D] alone
                n = len(words)
                if spans:
                    left, at = [], 0
                    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
                        left += words[at : max(at, lo)]
                        at = max(at, hi)
                    words = left + words[at:]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    spans = load(docs) if index is None else removed_spans(docs, index, history)[0]
    return with_spans(texts(docs), spans).select("doc_id", "text", "spans").mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
