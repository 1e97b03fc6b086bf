"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted texts.

1. One pass counts n-grams in trusted texts, and lists those of all texts, by task; sums are sharded by n-gram.
2. Count tables of each order and context are joined, by n-gram, with the n-grams of the corpus: a table of costs.
3. A second pass turns texts into postings (n-gram, document, count), compacted by chunk and shard. Each group
   of a shard and a salt meets the shard's costs, and yields each document's partial cost. Salts split n-grams
   that nearly every document holds.
4. A document's cost in bits for a byte, drawn towards its language's median by PRIOR bytes, is compared with a
   threshold of the language, from quantiles of trusted texts that were held out of the counts.

Texts begin with ORDER - 1 marks and end with one, so that a null or empty text has a cost too. Languages without
held-out texts (and null) take the threshold of all held-out texts; with none at all everything is kept. Rows that share
a doc_id are one document, all of whose texts count. Ties at a threshold are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumengrid.llm import textkernel as tk
from lumengrid.llm.common import lean, stored, texts, with_trusted

#: Bytes of an n-gram; steps of a bit, in which costs are whole numbers.
ORDER, UNIT = 4, 1 << 16
#: Groups of the final join, shards x salts: the least of each, the most shards, and bytes of text that a group stands for at most.
SHARDS, SALTS, MOST_SHARDS, GROUP_BYTES = 8, 16, 256, 1 << 28
#: A language's threshold: this quantile of trusted texts, and so many times its distance from the median above it, for small
#: samples; chosen with held-out labels of both kinds in view.
HIGH, SLACK, STEP = 0.95, 1.0, 1000
#: N-grams whose shards are told at once.
PART = 1 << 18
#: One in so many trusted texts is held out of the counts, for the quantiles.
HELD = 5
#: Bytes at the language's median that every document counts as having besides its own: short ones say little.
PRIOR = 100
BEGIN, END, ALPHABET = 0xFF, 0xFE, 256


def grams(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of a chunk's texts (first byte highest), and the row of each."""
    n = len(c.offsets) - 1
    extra = ORDER  # ORDER - 1 marks before, one behind
    data = np.full(len(c.data) + extra * n, BEGIN, dtype=np.uint32)
    starts, ends = c.offsets[:-1] + extra * np.arange(n), c.offsets[1:] + extra * np.arange(1, n + 1) - 1
    last = np.ones(len(data), dtype=bool)  # where an n-gram may end
    for k in range(ORDER - 1):
        last[starts + k] = False
    own = last.copy()
    own[ends] = False
    data[own] = c.data
    data[ends] = END
    size = len(data) - ORDER + 1
    code = data[:size].copy()
    for k in range(1, ORDER):
        code <<= np.uint32(8)
        code |= data[k : k + size]
    return code[last[ORDER - 1 :]], np.repeat(np.arange(n, dtype=np.uint32), np.diff(c.offsets) + 1)


def count_grams(docs: DataFrame) -> DataFrame:
    """gram, and how often trusted texts hold it (0 if only others do); and for gram -1 the n-grams of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        symbols = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code = np.concatenate([total[0], *(w[0] for w in waiting)])
            count = np.concatenate([total[1], *(w[1] for w in waiting)])
            found, at = np.unique(code, return_inverse=True)
            return found, np.bincount(at, weights=count, minlength=len(found)).astype(np.int64)

        for batch in batches:
            good = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for c in tk.chunks(batch.column(1)):
                code, row = grams(c)
                symbols += len(code)
                for own, unit in ((code[good[c.lo : c.hi][row]], 1), (code, 0)):
                    found, count = np.unique(own, return_counts=True)
                    waiting.append((found, count * unit))
                if len(waiting) >= 16:
                    total, waiting = merged(), []
        total = merged()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([symbols], pa.int64())], names=["gram", "count"])
        for lo in range(0, len(total[0]), 200_000):
            part = slice(lo, lo + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(total[0][part].astype(np.int64)), pa.array(total[1][part])], names=["gram", "count"])

    return docs.select("doc_id", "text", "trusted").mapInArrow(lean(run), "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count"))


def _discounts(counts: DataFrame) -> list[float]:
    """For counts of 0, 1, 2 and 3 or more, by how often each of 1 to 4 occurs."""
    n = dict(counts.where(F.col("count").between(1, 4)).groupBy("count").agg(F.count("*")).collect())
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ratio = lambda a, b: a / b if b else 0.0
    return [0.0, *(min(max(k - (k + 1) * y * ratio(b, a), 0.1), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]


def _pick(d: list[float], n: Column) -> Column:
    return F.when(n >= 3, d[3]).when(n == 2, d[2]).when(n == 1, d[1]).otherwise(0.0)


def costs(counted: DataFrame) -> DataFrame:
    """gram and its cost, the negative log2 of the last byte's probability after the others, in UNITths of a bit."""
    counted = counted.where("gram >= 0")
    top = counted.where("count > 0")
    wanted = counted.select("gram")
    p: Column = F.lit(1.0 / ALPHABET)
    levels = [top]  # from ORDER down to 1
    for k in range(ORDER - 1, 0, -1):
        levels.append(stored(levels[-1].groupBy((F.col("gram") % (1 << 8 * k)).alias("gram")).agg(F.count("*").alias("count"))))
    for k, level in zip(range(1, ORDER + 1), reversed(levels), strict=True):
        d = _discounts(level)
        key = (F.col("gram") % (1 << 8 * k)).alias(f"g{k}")
        sums = (F.sum("count").alias("total"), *(F.sum((F.col("count") == j).cast("long")).alias(f"n{j}") for j in (1, 2)), F.sum((F.col("count") >= 3).cast("long")).alias("n3"))
        context = level.groupBy(F.floor(F.col("gram") / 256).alias(f"h{k}")).agg(*sums) if k > 1 else level.agg(*sums)  # one byte has the one empty context
        back = (F.col("n1") * d[1] + F.col("n2") * d[2] + F.col("n3") * d[3]) / F.col("total")
        wanted = wanted.withColumn(f"g{k}", key).withColumn(f"h{k}", F.floor(F.col(f"g{k}") / 256))
        wanted = wanted.join(level.select(F.col("gram").alias(f"g{k}"), F.col("count").alias("own")), f"g{k}", "left")
        if k > 1:
            wanted = wanted.join(context.select(f"h{k}", "total", back.alias("back")), f"h{k}", "left")
        else:
            wanted = wanted.crossJoin(F.broadcast(context.select("total", back.alias("back"))))  # a single row
        own = F.coalesce("own", F.lit(0))
        lower = F.col("p") if k > 1 else p
        p = F.when(F.col("total").isNull(), lower).otherwise(F.greatest(own - _pick(d, own), F.lit(0.0)) / F.col("total") + F.col("back") * lower)
        wanted = wanted.select("gram", p.alias("p"))
    return wanted.select("gram", F.round(-F.log2("p") * UNIT).cast("long").alias("cost"))


def groups(symbols: int) -> tuple[int, int]:
    """Shards and salts for so many n-grams; shards grow first, since each salt gets a copy of the costs."""
    shards = min(MOST_SHARDS, max(SHARDS, -(-symbols // (SALTS * GROUP_BYTES))))
    return shards, max(SALTS, -(-symbols // (shards * GROUP_BYTES)))


def _shard(code: np.ndarray, shards: int) -> np.ndarray:
    return np.concatenate([(tk.mix(code[lo : lo + PART].astype(np.uint64) + np.uint64(1)) % np.uint64(shards)).astype(np.uint8) for lo in range(0, max(len(code), 1), PART)])


def postings(docs: DataFrame, shards: int, salts: int) -> DataFrame:
    """Rows of a chunk and shard: the doc_ids, the distinct n-grams, how many documents hold each, which, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        pack = lambda x: squeeze.compress(x.tobytes())
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for c in tk.chunks(batch.column(1)):
                code, row = grams(c)
                salt = int(tk.mix(np.array([len(c.data) * 1_000_003 + int(code[0])], dtype=np.uint64))[0] % np.uint64(salts))
                # arrays have an entry for each n-gram of the chunk: each is narrow, and goes as soon as it has served
                key = code.astype(np.uint64)
                key <<= np.uint64(32)
                key |= row
                del code, row
                key.sort()
                begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).astype(np.int32)
                count = np.diff(begin, append=np.int32(len(key)))
                key = key[begin]
                gram, doc = (key >> np.uint64(32)).astype(np.uint32), key.astype(np.uint16)
                del key, begin
                if count.max() > 255:  # counts of more than a byte take several entries
                    many = -(-count // 255)
                    at = np.cumsum(many) - 1
                    gram, doc, part = np.repeat(gram, many), np.repeat(doc, many), np.full(many.sum(), 255, dtype=np.int32)
                    part[at] = count - 255 * (many - 1)
                    count = part
                    del many, at, part
                counts, steps = count.astype(np.uint8), doc
                del count, doc
                # places of documents are told by their distance from the one before; far ones take entries that count nothing
                start = np.concatenate([[True], gram[1:] != gram[:-1]])
                steps = np.where(start, steps, np.diff(steps, prepend=steps[:1]))  # never negative: rows of an n-gram ascend
                del start
                if steps.max() > 255:
                    more = (steps // 255).astype(np.int32)
                    at = np.cumsum(more + 1) - 1
                    gram = np.repeat(gram, more + 1)
                    left, few = (steps - 255 * more).astype(np.uint8), counts
                    steps, counts = np.full(len(gram), 255, dtype=np.uint8), np.zeros(len(gram), dtype=np.uint8)
                    steps[at], counts[at] = left, few
                    del more, at, left, few
                steps = steps.astype(np.uint8)
                shard = _shard(gram, shards)
                rows = []
                for s in range(shards):
                    own = shard == s
                    distinct, lengths = np.unique(gram[own], return_counts=True)
                    rows.append((s, salt, ids[c.lo : c.hi], pack(distinct), pack(lengths.astype(np.uint32)), pack(steps[own]), pack(counts[own])))
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "salt", "ids", "grams", "lengths", "docs", "counts"])

    return docs.mapInArrow(lean(run), "shard int, salt int, ids array<long>, grams binary, lengths binary, docs binary, counts binary")


def score(docs: DataFrame, priced: DataFrame, shards: int = SHARDS, salts: int = SALTS) -> DataFrame:
    """doc_id, cost (in UNITths of a bit) and symbols (bytes and end marks)."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy()
            shard = _shard(gram.astype(np.uint32), shards)
            for salt in range(salts):
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.full(len(gram), salt, np.int32)), batch.column(0), batch.column(1)], names=["shard", "salt", "gram", "cost"])

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        gram, cost = right.column("gram").to_numpy(), right.column("cost").to_numpy()
        unpack = zstandard.ZstdDecompressor().decompress
        order = np.argsort(gram)
        gram, cost = gram[order], cost[order]
        out_id, out_cost, out_n = [], [], []
        for row in range(left.num_rows):
            ids = left.column("ids")[row].values
            read = lambda name, kind, row=row: np.frombuffer(unpack(left.column(name)[row].as_py()), dtype=kind)
            own, lengths = read("grams", np.uint32), read("lengths", np.uint32)
            price = np.repeat(cost[np.searchsorted(gram, own)], lengths) if len(own) else np.zeros(0)
            upto, count = np.cumsum(read("docs", np.uint8), dtype=np.int64), read("counts", np.uint8)
            before = np.cumsum(lengths, dtype=np.int64) - lengths
            doc = upto - np.repeat(np.concatenate([[0], upto])[before], lengths) if len(own) else upto
            out_id.append(ids)
            out_cost.append(np.bincount(doc, weights=price * count, minlength=len(ids)))
            out_n.append(np.bincount(doc, weights=count, minlength=len(ids)))
        if not out_id:
            return pa.table({"doc_id": pa.array([], pa.int64()), "cost": pa.array([], pa.int64()), "symbols": pa.array([], pa.int64())})
        flat = lambda x: pa.array(np.concatenate(x).astype(np.int64))
        return pa.table({"doc_id": pa.concat_arrays(out_id), "cost": flat(out_cost), "symbols": flat(out_n)})

    right = priced.mapInArrow(lean(table), "shard int, salt int, gram long, cost long")
    left = postings(docs, shards, salts)
    schema = "doc_id long, cost long, symbols long"
    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInArrow(meet, schema).groupBy("doc_id").agg(F.sum("cost").alias("cost"), F.sum("symbols").alias("symbols"))


def _held() -> Column:
    """The share of documents that take no part in training, so that quantiles are those of unseen texts."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0


def thresholds(scored: DataFrame) -> DataFrame:
    """lang (one more row for null: all languages) and the most thousandths of a bit a byte that its documents may cost.

    Quantiles are exact on whole thousandths; counts by thousandth are few, whatever the number of documents.
    """
    held = scored.where(F.col("trusted") & _held())
    bins = held.groupBy("lang", "level").agg(F.count("*").alias("n")).where("lang is not null")
    bins = bins.unionByName(held.groupBy("level").agg(F.count("*").alias("n")).withColumn("lang", F.lit(None).cast("string")))
    w = Window.partitionBy("lang")
    placed = bins.withColumn("upto", F.sum("n").over(w.orderBy("level"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col("level")))
    return placed.groupBy("lang").agg(at(HIGH).alias("high"), at(0.5).alias("mid")).select("lang", "mid", (F.col("high") + SLACK * (F.col("high") - F.col("mid"))).cast("long").alias("most"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, bits (a byte), perplexity (a byte), threshold (bits) and kept."""
    plain = texts(docs)
    flagged = with_trusted(plain, labels).withColumn("trusted", F.col("trusted") & ~_held())
    counted = stored(count_grams(flagged))
    symbols = counted.where("gram = -1").agg(F.sum("count")).first()[0] or 0
    priced = costs(counted)
    about = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    level = F.round(F.col("cost") / F.col("symbols") / UNIT * STEP).cast("long")
    scored = score(plain, priced, *groups(symbols)).join(about.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left").drop("id")
    scored = stored(with_trusted(scored.withColumn("level", level), labels))
    limits = stored(thresholds(scored))
    overall = limits.where("lang is null").agg(F.first("mid").alias("mid0"), F.first("most").alias("most0"))  # a single row
    scored = scored.join(limits.where("lang is not null"), "lang", "left").crossJoin(F.broadcast(overall))
    mid, most = F.coalesce("mid", "mid0"), F.coalesce("most", "most0")
    kept = F.col("level") * F.col("symbols") + PRIOR * mid <= most * (F.col("symbols") + PRIOR)
    return scored.select(
        "doc_id", "lang", (F.col("level") / STEP).alias("bits"), F.pow(F.lit(2.0), F.col("level") / STEP).alias("perplexity"), (most / STEP).alias("threshold"), F.coalesce(kept, F.lit(True)).alias("kept")
    )
