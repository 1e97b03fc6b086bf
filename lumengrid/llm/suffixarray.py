"""Suffix-array deduplication: bytes that a long string covers which also starts elsewhere.

1. Anchors: of every window() successive 8-byte hashes the least (the last of equal ones) is an anchor; so equal
   windows of length bytes have their first anchor at the same place, and the blocks between anchors agree.
   Blocks are the letters of a string for each distinct text. A letter that occurs once ends every match: strings
   are cut there.
2. The suffixes of these strings are sorted by their first AHEAD letters, packed into three numbers. Rows are dealt by
   range of these letters and of where the suffix stands, so that suffixes that agree on all of them don't fall to one task.
   suffix_order() sorts suffixes to any depth, by the difference-cover algorithm, for callers that compare more letters.
3. Neighbours in the suffix array are compared: an anchor stays if it agrees with one on enough bytes for a match, or on
   AHEAD letters, so that suffixes needn't be told apart beyond these.
4. An exact check by 128-bit hashes decides for each window of length bytes that starts at one of those anchors'
   places, first for all windows of an anchor at once, then for STEP of them, and only then one by one.

Texts that occur twice are all copies, and one of them takes part in the rest. A null text counts as empty; texts
under length bytes keep everything. Matches are judged on the input. A doc_id must not have two different texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumengrid.llm import textkernel as tk
from lumengrid.llm.common import discard, lean, merged_spans, only, stored, tasks, texts, with_spans
from lumengrid.llm.order import running

#: Bytes of a match, bytes of a hash, windows checked together, letters compared.
LENGTH, GRAM, STEP, AHEAD = 400, 8, 16, 6
_PLACE = np.uint64((1 << 24) - 1)


def window(length: int) -> int:
    """Of how many hashes an anchor is the least: so few that a match holds two anchors at least, and that block sizes take 7 bits."""
    if length < 64:
        raise ValueError("matches of 64 bytes at least are looked for")
    return min(128, (length - GRAM) // 2)


def anchors(h: np.ndarray, span: int) -> np.ndarray:
    """The anchor of each start of span hashes."""
    h = h & ~_PLACE
    out = []
    for lo in range(0, len(h) - span + 1, 1 << 22):  # places inside a part fit 24 bits
        part = h[lo : lo + (1 << 22) + span - 1]
        least, done = part | (_PLACE - np.arange(len(part), dtype=np.uint64)), 1
        while done < span:
            step = min(done, span - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        out.append(lo + (_PLACE - (least & _PLACE)).astype(np.int64))
    return np.concatenate(out)


class Text:
    """A text's anchors, the letters between them, and which windows of length bytes belong to each anchor.

    Every hash is over mixed numbers of GRAM bytes each, so that ranges are told by the GRAM - 1 bytes behind their last start too.
    """

    def __init__(self, data: np.ndarray, length: int) -> None:
        grams = tk.mix(tk.eights(data)[: len(data) - GRAM + 1])
        of = anchors(grams, window(length))
        begin = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1])  # anchors never step back
        self.at = of[begin]
        self.grams, self.sums = grams, tk.prefix(grams)
        starts = len(data) - length + 1
        self.lo = np.minimum(begin, starts)
        self.hi = np.minimum(np.append(begin[1:], len(of)), starts) - 1

    def letters(self) -> np.ndarray:
        """55 bits of a block's hash and 7 of its length. A block's hash takes the GRAM - 1 bytes behind it in, as its next anchor does."""
        h = tk.range_hash(self.sums, self.at[:-1], self.at[1:])
        return ((h >> np.uint64(1)) & ~np.uint64(127) | (np.diff(self.at) - 1).astype(np.uint64)).astype(np.int64)

    def reach(self) -> np.ndarray:
        """How far before its anchor a letter's first window starts; -1 without windows."""
        return np.where(self.hi >= self.lo, self.at - self.lo, -1)[:-1]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of bytes starts to ends, GRAM of them at least."""
        if not hasattr(self, "more"):
            self.more = tk.prefix(tk.mix(self.grams + np.uint64(77)))
        last, salt = ends - GRAM + 1, salt.astype(np.uint64)
        return tk.mix(tk.range_hash(self.sums, starts, last, 11) ^ salt).astype(np.int64), tk.mix(tk.range_hash(self.more, starts, last, 13) + salt).astype(np.int64)


def _rows(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    for c in tk.chunks(batch.column(column)):
        for k in range(c.hi - c.lo):
            yield c.lo + k, c.data[c.offsets[k] : c.offsets[k + 1]]


def strings(plain: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n (bytes), a and b (a 128-bit hash of the text), letters with their reach (null for short texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, many, names, reaches = [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int16)]
            for _, data in _rows(batch, 1):
                n.append(len(data))
                keys.append(np.frombuffer(hashlib.sha256(data.tobytes()).digest()[:16], dtype=np.int64))
                if len(data) < length:
                    many.append(0)
                else:
                    t = Text(data, length)
                    names.append(t.letters())
                    reaches.append(t.reach().astype(np.int16))
                    many.append(len(names[-1]))
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(reaches))], names=["x", "reach"])
            letters = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pairs, mask=pa.array(np.array(n) < length))
            arrays = [batch.column(0), pa.array(n, pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), letters]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "a", "b", "letters"])

    return plain.mapInArrow(lean(run), "doc_id long, n long, a long, b long, letters array<struct<x: long, reach: smallint>>")


def suffix_order(strings: DataFrame, enough: int = LENGTH, letters: int | None = None, each: int = 1) -> DataFrame:
    """s, j and place, for letters x (positive, covering size bytes) at places j = 0, 1, ... of strings s.

    A string ends below every letter. Suffixes that agree on enough bytes, or on so many letters, may share a place or
    stand in any order among themselves; all others are ordered by their letters. In recursion x is a name for each letters.
    """
    spark = strings.sparkSession
    w = Window.partitionBy("s").orderBy("j")
    end = -1 - F.col("s")
    full = stored(
        strings.select(
            "s", "j", "x", F.coalesce(F.lead("x", 1).over(w), end).alias("x1"), F.coalesce(F.lead("x", 2).over(w), end).alias("x2"),
            (F.col("size") + F.coalesce(F.lead("size", 1).over(w), F.lit(0)) + F.coalesce(F.lead("size", 2).over(w), F.lit(0))).alias("size"),
        )
    )
    triple = ["x", "x1", "x2"]
    sample = full.where("j % 3 <> 0")
    # sort sampled triples: a name is a triple's place among the distinct ones
    named = sample.groupBy(*triple).agg(F.count("*").alias("n"), F.max("size").alias("size"))
    named = stored(named.repartitionByRange(tasks(spark), *triple).sortWithinPartitions(*triple).select(*triple, "n", "size", (F.monotonically_increasing_id() + 1).alias("name")))
    # a name that occurs once, or stands for enough, settles every comparison that reaches it
    settled = (F.col("n") == 1) | (F.col("size") >= enough) | F.lit(letters is not None and 3 * each >= letters)
    below = F.xxhash64("s", F.col("j") % 3)
    sample = sample.select("s", "j", *triple, below.alias("s2"), F.floor(F.col("j") / 3).alias("j2")).join(named.select(*triple, "name", "size", settled.alias("settled")), triple)
    v = Window.partitionBy("s2").orderBy("j2")
    last = F.coalesce(F.max(F.when(F.col("settled"), F.col("j2"))).over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1).cast("long"))
    sample = stored(sample.select("s", "j", "s2", "j2", "name", "size", "settled", last.alias("last")))
    spent = [full, named, sample]
    if sample.where("not settled").isEmpty():
        ranked = sample.select("s", "j", F.col("name").alias("rank"), F.lit(0).cast("long").alias("more"))
    else:  # recurse on strings of names that are not settled and the settled one behind them
        wanted = sample.where("not settled or j2 > last + 1").withColumn("s3", F.xxhash64("s2", "last").bitwiseAND((1 << 62) - 1)).withColumn("j3", F.col("j2") - F.col("last") - 1)
        deeper = suffix_order(wanted.select(F.col("s3").alias("s"), F.col("j3").alias("j"), F.col("name").alias("x"), "size"), enough, letters, 3 * each)
        spent.append(deeper)
        ranked = wanted.select("s", "j", "name", "s3", "j3").join(deeper.select(F.col("s").alias("s3"), F.col("j").alias("j3"), F.col("place").alias("more")), ["s3", "j3"]).select("s", "j", F.col("name").alias("rank"), "more")
        ranked = ranked.unionByName(sample.where("settled and j2 = last + 1").select("s", "j", F.col("name").alias("rank"), F.lit(0).cast("long").alias("more")))
    # merge remaining suffixes: a class is counted against each other one on keys that both have
    both = full.select("s", "j", "x", "x1").join(ranked, ["s", "j"], "left")
    ahead = lambda c, k, none: F.coalesce(F.lead(c, k).over(w), none).alias(f"{c}{k}")
    both = stored(both.select("*", *(ahead("rank", k, end) for k in (1, 2)), *(ahead("more", k, F.lit(0).cast("long")) for k in (1, 2)), (F.col("j") % 3 == 0).alias("zero")))
    discard(*spent)
    first = running(both.where("j % 3 <> 2").select("s", "j", "x", "rank1", "more1", "zero"), ["x", "rank1", "more1", "s", "j"], "zero")
    second = running(both.where("j % 3 <> 1").select("s", "j", "x", "x1", "rank2", "more2", "zero"), ["x", "x1", "rank2", "more2", "s", "j"], "zero")
    samples = running(both.where("not zero").select("s", "j", "rank", "more", "zero"), ["rank", "more", "s", "j"], "zero")
    counts = (
        both.select("s", "j", "zero")
        .join(first.select("s", "j", F.col("hits").alias("zero1"), F.col("rest").alias("one")), ["s", "j"], "left")
        .join(second.select("s", "j", F.col("hits").alias("zero2"), F.col("rest").alias("two")), ["s", "j"], "left")
        .join(samples.select("s", "j", F.col("rest").alias("among")), ["s", "j"], "left")
    )
    place = F.when(F.col("zero"), F.col("zero1") + F.col("one") + F.col("two")).otherwise(F.col("among") + F.coalesce("zero1", "zero2"))
    out = stored(counts.select("s", "j", place.alias("place")))
    discard(both, first, second, samples)
    return out


def _agree(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and letters that each row of packed letters and the one behind it agree on from the start."""
    on, size, many = np.ones(len(keys) - 1, bool), np.zeros(len(keys) - 1, np.int64), np.zeros(len(keys) - 1, np.int64)
    for k in range(AHEAD):
        x = keys[:, k // 2] >> (32 if k % 2 == 0 else 0) & 0xFFFFFFFF
        on &= (x[1:] == x[:-1]) & (x[1:] != 0)
        size += np.where(on, (x[1:] & 127) + 1, 0)
        many += on
    return size, many


def neighbours(letters: DataFrame, length: int = LENGTH) -> DataFrame:
    """id and i of suffixes that agree with a neighbour in the suffix array on AHEAD letters, or on enough bytes for a window of theirs.

    letters: id, i, reach and k0 to k2, a suffix's first AHEAD letters, two in each (0 behind the last); a stored table, whose
    rows are sorted by these letters and dealt by range. Rows on both sides of a limit, two for each task, go through the driver.
    """
    spark = letters.sparkSession
    need = length - window(length) - GRAM + 1
    names = ["k0", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, first = TaskContext.get().partitionId(), None, None

        def rows(x: np.ndarray, edge: int) -> pa.RecordBatch:
            tells = (np.full(len(x), v, np.int32) for v in (part, edge))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (*x.T, *tells)], names=["id", "i", "reach", *names, "part", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            if before is None:
                first = own[:1]
            else:
                own = np.concatenate([before, own])  # its last row meets this one's first
            yield rows(own[met(own)], 0)
            before = own[-1:]
        if first is not None:
            yield rows(first, 1)
            yield rows(before, 2)

    def met(rows: np.ndarray) -> np.ndarray:
        size, many = _agree(rows[:, 3:])
        good = np.zeros(len(rows), bool)
        for side in (rows[:-1], good[:-1]), (rows[1:], good[1:]):
            side[1][:] |= (size >= need - side[0][:, 2]) | (many == AHEAD)
        return good & (rows[:, 2] >= 0)

    dealt = letters.select("id", "i", "reach", *names).repartitionByRange(tasks(spark), *names, "id", "i").sortWithinPartitions(*names, "id", "i")
    local = stored(dealt.mapInArrow(lean(run), "id long, i long, reach long, k0 long, k1 long, k2 long, part int, edge int"))
    edges = sorted(local.where("edge > 0").select("part", "edge", "id", "i", "reach", *names).collect())
    more = []
    for p, q in zip(edges, edges[1:]):
        if p.part != q.part:
            both = np.array([p[2:], q[2:]], dtype=np.int64)
            more += both[met(both)][:, :2].tolist()
    found = local.where("edge = 0").select("id", "i").unionByName(spark.createDataFrame(more, "id long, i long"))
    out = stored(found)
    discard(local)
    return out


def candidates(distinct: DataFrame, length: int = LENGTH) -> DataFrame:
    """id and i of letters whose suffixes agree with a neighbour's on enough bytes for one of their windows to match; some may come twice."""
    letters = distinct.where("letters is not null").select("id", F.posexplode("letters").alias("i", "l")).select("id", "i", "l.x", "l.reach")
    twice = stored(letters.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x"))  # written, so that the join can split a hot letter
    size = F.col("x").bitwiseAND(127) + 1
    w = Window.partitionBy("id").orderBy("i")
    letters = letters.join(twice, "x").withColumn("run", F.col("i") - F.row_number().over(w))
    # a run that covers fewer bytes than any match has behind its first anchor holds none
    least = length - 2 * window(length) - GRAM + 2
    letters = letters.withColumn("covered", F.sum(size).over(Window.partitionBy("id", "run"))).where(F.col("covered") >= least)
    # a mark, 24 bits of the hash and the length: letters that agree by chance make a candidate more, never one less
    of_run = Window.partitionBy("id", "run").orderBy("i")
    brief = F.col("x").bitwiseAND((1 << 31) - 1).bitwiseOR(1 << 31)
    at = lambda k: F.coalesce(F.lead("brief", k).over(of_run), F.lit(0).cast("long")) if k else F.col("brief")
    pairs = [F.shiftleft(at(2 * k), 32).bitwiseOR(at(2 * k + 1)).alias(f"k{k}") for k in range(AHEAD // 2)]
    letters = stored(letters.withColumn("brief", brief).select("id", "i", "reach", *pairs))
    discard(twice)
    out = neighbours(letters, length)
    discard(letters)
    return out


def _checks(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per candidate letter: its windows lo to hi, the hash of all they cover, and by STEP the core and whole hashes."""
        for batch in batches:
            for k, data in _rows(batch, 1):
                t = Text(data, length)
                i = batch.column(2)[k].values.to_numpy()
                at, lo, hi = t.at[i], t.lo[i], t.hi[i]
                a, b = t.hashes(lo, hi + length, (at - lo) << 16 | (hi - lo))
                near, far = at - hi, at - lo  # distances of the last and first window
                first, last = near // STEP, far // STEP
                many = last - first + 1
                who = np.repeat(np.arange(len(i)), many)
                q = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[who]
                low, high = np.maximum(q * STEP, near[who]), np.minimum(q * STEP + STEP - 1, far[who])
                core, _ = t.hashes(at[who] - q * STEP, at[who] - q * STEP - STEP + 1 + length, q)
                wa, wb = t.hashes(at[who] - high, at[who] - low + length, low << 16 | high)
                parts = pa.StructArray.from_arrays([pa.array(x) for x in (at[who] - high, at[who] - low, core, wa, wb)], names=["lo", "hi", "core", "a", "b"])
                parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), parts)
                ids = pa.array(np.full(len(i), batch.column(0)[k].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in (lo, hi, a, b)), parts], names=["id", "lo", "hi", "a", "b", "parts"])

    return run


def _windows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in _rows(batch, 1):
                t = Text(data, length)
                ranges = batch.column(2)[k].values
                lo, hi = (ranges.field(f).to_numpy() for f in ("lo", "hi"))
                many = hi - lo + 1
                p = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
                a, b = t.hashes(p, p + length, np.zeros(len(p), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), batch.column(0)[k].as_py()), pa.int64()), pa.array(p), pa.array(a), pa.array(b)], names=["id", "p", "a", "b"])

    return run


def repeated(plain: DataFrame, found: DataFrame, length: int = LENGTH) -> tuple[DataFrame, list[DataFrame]]:
    """id, lo and hi: starts of windows, among those of the found letters, that occur elsewhere too; and the stored tables it reads."""
    listed = found.groupBy("id").agg(F.array_sort(F.collect_set("i")).alias("i"))
    listed = stored(listed)
    bodies = stored(only(plain.withColumnRenamed("doc_id", "id"), listed.select("id"), "id").groupBy("id").agg(F.first("text").alias("text")))
    checks = stored(
        bodies.join(listed, "id").select("id", "text", "i").mapInArrow(lean(_checks(length)), "id long, lo long, hi long, a long, b long, parts array<struct<lo: long, hi: long, core: long, a: long, b: long>>")
    )
    groups = checks.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("id", "lo", "hi")).alias("m"), F.min_by("parts", F.struct("id", "lo")).alias("parts"))
    groups = stored(groups)
    whole = checks.select("id", "lo", "hi", "a", "b").join(groups.where("n > 1").select("a", "b"), ["a", "b"]).select("id", "lo", "hi")
    parts = groups.select("n", F.col("m.id").alias("id"), F.explode("parts").alias("p")).select("n", "id", "p.*")
    parts = parts.groupBy("core", "a", "b").agg(F.count("*").alias("same"), F.max("n").alias("n"), F.min(F.struct("id", "lo", "hi")).alias("m"), F.collect_list(F.when(F.col("n") == 1, F.struct("id", "lo", "hi"))).alias("open"))
    parts = stored(parts)
    by_step = parts.where("same > 1").select(F.explode("open").alias("o")).select("o.*")
    several = parts.groupBy("core").agg(F.count("*").alias("k"), F.max(((F.col("same") == 1) & (F.col("n") == 1)).cast("int")).alias("left")).where("k > 1 and left = 1").select("core")
    ranges = parts.join(several, "core").groupBy(F.col("m.id").alias("id")).agg(F.collect_list(F.struct("m.lo", "m.hi")).alias("ranges"))
    single = stored(bodies.join(ranges, "id").select("id", "text", "ranges").mapInArrow(lean(_windows(length)), "id long, p long, a long, b long"))
    again = single.groupBy("a", "b").agg(F.countDistinct("id", "p").alias("n")).where("n > 1").select("a", "b")
    by_one = single.join(again, ["a", "b"]).select("id", F.col("p").alias("lo"), F.col("p").alias("hi"))
    return whole.unionByName(by_step).unionByName(by_one), [listed, bodies, checks, groups, parts, single]


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and spans: byte ranges (lo, hi) to remove, for documents that have any."""
    plain = texts(docs)
    full = stored(strings(plain, length))
    wide = stored(full.groupBy("a", "b", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min_by("letters", "doc_id").alias("letters")))
    signed, distinct = stored(full.drop("letters")), stored(wide.drop("letters"))
    discard(full)
    found = candidates(wide, length)
    discard(wide)
    ranges, spent = repeated(plain, found, length)
    ranges = ranges.groupBy("id").agg(F.collect_set(F.struct("lo", (F.col("hi") + length).alias("hi"))).alias("spans"))
    alone = distinct.where("copies = 1").select("id")
    ranges = ranges.join(alone, "id").select(F.col("id").alias("doc_id"), "spans")
    copies = distinct.where(f"copies > 1 and n >= {length}").select("a", "b", "n")
    copies = signed.select("doc_id", "a", "b", "n").join(copies, ["a", "b", "n"]).select("doc_id", F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))).alias("spans")).dropDuplicates(["doc_id"])
    out = stored(merged_spans(ranges.unionByName(copies)))
    discard(signed, distinct, found, *spent)
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left, and the maximal removed ranges."""
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    left, at = [], 0
    for lo, hi in runs:
        left.append(data[at:lo])
        at = hi
    return b"".join([*left, data[at:]]), [(lo, hi) for lo, hi in runs]


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes left)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                left, runs = cut(data, [(s["lo"], s["hi"]) for s in spans or []])
                rows.append((len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = with_spans(texts(docs), removed_spans(docs, length)).select("doc_id", "text", "spans")
    return joined.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
