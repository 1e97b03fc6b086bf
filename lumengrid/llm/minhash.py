"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

1. A text's set is its distinct shingles of SHINGLE words (A-Z lower-cased). One permutation deals the shingles
   into BANDS x ROWS bins; a bin's value is its least shingle, an empty bin takes that of the first full bin in
   its own random order. Bands of bins are buckets. Equal sets are folded into their smallest doc_id first.
2. Each bucket has a centre. A set is paired with one centre, that of most of its buckets, so that a round makes no more
   pairs than there are sets. Pairs whose sizes allow the similarity are confirmed on the full sets, and links make components.
3. Buckets that still hold several components get CENTRES other centres; each set of another component is paired with the one
   it shares most buckets with and has not met, round after round, until a round finds few links (one in FEW of all) or none.
4. All sets of buckets that are divided even then go through an exact join: shingles are ordered from rare to common, and
   the pairs of different components that share one in their prefixes, where sizes, places and outlines (parities of the
   shingles by slot) allow the similarity, are confirmed. Its links are added, whatever their number. So the rounds decide what is quick, not what is found.

With 36 bands of 4 rows a pair at the least similarity shares no bucket with probability 1e-6, the only way to be lost.

Null and empty texts have empty sets, linked with nothing. Texts of fewer words are one shingle as a whole. Rows that
share a doc_id are linked by it (with two different texts, the least one is compared for pairs). Ties of rank go to the smaller doc_id. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.llm import textkernel as tk
from lumengrid.llm.common import discard, lean, only, stored, texts
from lumengrid.llm.graph import components

SHINGLE, BANDS, ROWS, PERCENT = 5, 36, 4, 75
#: Centres of a bucket that is still divided, in each further round.
CENTRES = 8
#: Rounds end once they find less than one in so many of the links so far; slots in which shingles are counted for their order.
FEW, SLOTS = 20, 1 << 18
#: Words of 64 bits of a set's outline.
OUTLINE = 16
BINS = BANDS * ROWS
_ORDER = np.stack([np.random.default_rng(k).permutation(BINS) for k in range(BINS)])


def sets(c: tk.Chunk, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted 64-bit shingle hashes of each text."""
    w = tk.words(c)
    hashes = tk.word_hashes(c, w, lower=True)
    grams = tk.window_hashes(hashes, size)
    sums = tk.prefix(hashes)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield tk.range_hash(sums, np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, np.uint64)


def bands(shingles: np.ndarray) -> np.ndarray:
    """Bucket keys of a set that is not empty."""
    where = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    full = np.zeros(BINS, dtype=bool)
    full[where[first]] = True
    values = np.zeros(BINS, dtype=np.uint64)
    values[where[first]] = shingles[first]
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _ORDER[empty]
        values[empty] = values[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = tk.mix(key ^ values[r::ROWS]) + np.uint64(r)
    return key


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), a and b (a 128-bit hash of the set), and buckets (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch.column(1)):
                n, key, found = [], [], []
                for s in sets(c):
                    n.append(len(s))
                    both = np.concatenate([s, s])
                    both[len(s) :] = tk.mix(s ^ np.uint64(0x5851F42D4C957F2D))
                    key.append((int(np.bitwise_xor.reduce(tk.mix(both[: len(s)])).astype(np.int64)) if len(s) else 0, int(both[len(s) :].sum(dtype=np.uint64).astype(np.int64))))
                    found.append(bands(s).astype(np.int64) if len(s) else None)
                arrays = [batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(n, pa.int64()), *(pa.array([k[i] for k in key], pa.int64()) for i in (0, 1)), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "a", "b", "buckets"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, a long, b long, buckets array<long>")


def confirm(pairs: DataFrame, plain: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (u, v) of ids of plain (id, text) whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                u, v = (part.column(k).to_pylist() for k in (0, 1))
                for ids, column in ((u, 2), (v, 3)):
                    new = {x: k for k, x in enumerate(ids) if x not in known}
                    for c in tk.chunks(part.column(column).take(pa.array(new.values(), pa.int64()))):
                        known.update(zip(list(new)[c.lo : c.hi], sets(c), strict=True))
                good = []
                for a, b in zip(u, v, strict=True):
                    x, y = known[a], known[b]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * common >= percent * (len(x) + len(y) - common))
                known = {x: known[x] for x in v[-1:]}  # a centre goes on
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), part.column(1).filter(pa.array(good))], names=["u", "v"])

    side = lambda name: plain.select(F.col("id").alias(name), F.col("text").alias(f"text_{name}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "text_u", "text_v").mapInArrow(lean(run), "u long, v long")


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(SLOTS - 1)).astype(np.int64)


def _slot_counts(bodies: DataFrame) -> np.ndarray:
    """How many sets of (id, text) hold a shingle of each slot, repeats within a set included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for c in tk.chunks(batch.column(1)):
                for s in sets(c):
                    np.add.at(total, _slot(s), 1)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["slot", "sets"])

    out = np.zeros(SLOTS, dtype=np.int64)
    table = bodies.select("id", "text").mapInArrow(lean(run), "slot long, sets long").groupBy("slot").agg(F.sum("sets").alias("sets")).toArrow()
    out[table.column("slot").to_numpy()] = table.column("sets").to_numpy()
    return out


def outline(shingles: np.ndarray) -> np.ndarray:
    """The parities of a set's shingles by 64 x OUTLINE slots: two sets differ in as many shingles, at least, as these differ in bits."""
    slots = np.bincount((tk.mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * OUTLINE)).astype(np.int64), minlength=64 * OUTLINE)
    return np.packbits((slots & 1).astype(np.uint8)).view(np.int64)


def prefixes(bodies: DataFrame, percent: int) -> DataFrame:
    """id, n, shingle, left (shingles from this one on, rare ones first), short and the set's outline (o0, o1, ...), for the prefixes of sets of (id, text).

    Similar sets share a shingle of both prefixes, which is in the short one of the smaller set.
    """
    counts = _slot_counts(bodies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch.column(1)):
                ids, sizes, found, left, drawn = [], [], [], [], []
                for i, s in zip(batch.column(0).slice(c.lo, c.hi - c.lo).to_pylist(), sets(c), strict=True):
                    s = s[np.lexsort((s, counts[_slot(s)]))]
                    rest = np.arange(len(s), 0, -1)
                    k = int((100 * rest >= percent * len(s)).sum())
                    ids.append(np.full(k, i, dtype=np.int64))
                    sizes.append(np.full(k, len(s), dtype=np.int64))
                    found.append(s[:k].astype(np.int64))
                    left.append(rest[:k])
                    drawn.append(np.broadcast_to(outline(s), (k, OUTLINE)))
                if ids:
                    n, r = np.concatenate(sizes), np.concatenate(left)
                    arrays = [np.concatenate(ids), n, np.concatenate(found), r, (100 + percent) * r >= 2 * percent * n, *np.ascontiguousarray(np.concatenate(drawn).T)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["id", "n", "shingle", "left", "short", *outlines])

    outlines = [f"o{k}" for k in range(OUTLINE)]
    return bodies.select("id", "text").mapInArrow(lean(run), "id long, n long, shingle long, left long, short boolean, " + ", ".join(f"{o} long" for o in outlines))


def exact_pairs(bodies: DataFrame, label: DataFrame | None, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (u, v) of ids of (id, text) in different components that prefixes, sizes and places allow to be similar; and the stored tables behind them."""
    rows = prefixes(bodies, percent)
    if label is None:
        rows = rows.withColumn("c", F.col("id"))
    else:
        rows = rows.join(label, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    every = stored(rows)
    rows = every
    useful = rows.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("short").alias("any")).where("any and low < high").select("shingle")
    rows = stored(rows.join(useful, "shingle"))
    outlines = [f"o{k}" for k in range(OUTLINE)]
    side = lambda x: rows.select("shingle", *(F.col(k).alias(f"{k}_{x}") for k in ("id", "n", "left", "short", "c", *outlines)))
    a, b = side("u").where("short_u"), side("v")
    fits = (F.col("c_u") != F.col("c_v")) & ((F.col("n_u") < F.col("n_v")) | (F.col("n_u") == F.col("n_v")) & (F.col("id_u") < F.col("id_v")))
    fits &= (100 * F.col("n_u") >= percent * F.col("n_v")) & ((100 + percent) * F.least("left_u", "left_v") >= percent * (F.col("n_u") + F.col("n_v")))
    differ = sum((F.bit_count(F.col(f"{o}_u").bitwiseXOR(F.col(f"{o}_v"))) for o in outlines), F.lit(0))  # similar sets differ in few shingles
    fits &= (100 + percent) * differ <= (100 - percent) * (F.col("n_u") + F.col("n_v"))
    return a.join(b, (a.shingle == b.shingle) & fits).select(F.col("id_u").alias("u"), F.col("id_v").alias("v")).distinct(), [every, rows]


def chosen_centres(rows: DataFrame, centre: DataFrame, tested: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (u, v): for each set of rows (id, n, c, bucket) the centre of another component that most of its buckets (bucket, m) have, of those it has not met.

    Centres are gathered by set, BANDS x CENTRES at most, and counted in place: no row is made for each of them.
    """
    other = lambda m: (m.c != F.col("c")) & (100 * F.least(F.col("n"), m.n) >= percent * F.greatest(F.col("n"), m.n))
    near = rows.join(centre, "bucket").select(F.col("id").alias("u"), F.array_distinct(F.transform(F.filter("m", other), lambda m: m.id)).alias("v")).where(F.size("v") > 0)
    near = near.groupBy("u").agg(F.flatten(F.collect_list("v")).alias("v"))
    if tested is not None:
        near = near.join(tested.groupBy("u").agg(F.collect_set("v").alias("met")), "u", "left")
        near = near.select("u", F.when(F.col("met").isNull(), F.col("v")).otherwise(F.filter("v", lambda v: ~F.array_contains("met", v))).alias("v"))
    state = lambda n, last, best: F.struct(n.alias("n"), last.alias("last"), best.alias("best"))
    ranked = lambda n, v: F.struct(n.alias("shared"), F.xxhash64(v).alias("r"), v.alias("v"))
    none = F.lit(None).cast("struct<shared: int, r: bigint, v: bigint>")

    def counted(acc: Column, v: Column) -> Column:  # equal ids stand together
        n = F.when(acc.last == v, acc.n + 1).otherwise(F.lit(1))
        return state(n, v, F.greatest(acc.best, ranked(n, v)))

    best = F.aggregate(F.array_sort("v"), state(F.lit(0), F.lit(None).cast("long"), none), counted, lambda acc: acc.best.v)
    return near.where(F.size("v") > 0).select("u", best.alias("v"))


def labelled(links: DataFrame, old: DataFrame | None) -> DataFrame:
    """id and component by all links so far, in place of the labels by earlier ones."""
    found = components(links)
    out = found.withColumnRenamed("node", "id")
    out.stored_path = found.stored_path
    if old is not None:
        discard(old)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    plain = texts(docs)
    signed = stored(signatures(plain))
    distinct = stored(signed.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("id"), F.min_by("buckets", "doc_id").alias("buckets")))
    dealt = distinct.select("id", "n", F.explode("buckets").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("sets")).where("sets > 1").select("bucket")
    dealt = stored(dealt.join(shared, "bucket"))
    wanted = stored(dealt.select("id").distinct())
    bodies = stored(only(plain.withColumnRenamed("doc_id", "id"), wanted, "id").groupBy("id").agg(F.min("text").alias("text")))
    links, label, turn, many = None, None, 0, 0

    def placed() -> DataFrame:
        if label is None:
            return dealt.withColumn("c", F.col("id"))
        return dealt.join(label, "id", "left").withColumn("c", F.coalesce("component", "id"))

    tested: DataFrame | None = None
    spent = [dealt, wanted, bodies]
    while True:
        rows = placed()
        seeds = range(1) if label is None else range(CENTRES * turn, CENTRES * (turn + 1))
        rank = lambda k: F.struct(F.xxhash64("id", F.lit(k)).alias("r"), "id", "n", "c")
        centre = rows.groupBy("bucket").agg(F.array(*(F.min(rank(k)) for k in seeds)).alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
        centre = stored(centre.select("bucket", "m"))  # written, so that the join can split a hot bucket
        pairs = stored(chosen_centres(rows, centre, tested, percent))
        found = stored(confirm(pairs, bodies, percent))
        discard(centre)
        spent += [pairs, found]
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = found.count()
        if new:
            links = found if links is None else links.unionByName(found)
            label = labelled(links, label)
            many += new
            turn += 1
        if FEW * new < many or not new:
            break
    divided = placed().groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
    spent.append(open_ids := stored(dealt.join(divided, "bucket").select("id").distinct()))
    if not open_ids.isEmpty():
        closer, rows = exact_pairs(only(bodies, open_ids, "id"), label, percent)
        found = stored(confirm(closer, bodies, percent))
        spent += [found, *rows]
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            label = labelled(links, label)
    discard(*spent)
    own = signed.select("doc_id", "n", "a", "b").join(distinct.select("a", "b", "n", "id"), ["a", "b", "n"], "left")
    if label is not None:
        own = own.join(label, "id", "left")
        own = own.withColumn("id", F.coalesce("component", "id"))
    least = F.coalesce("id", "doc_id")
    return own.select("doc_id", F.col("n").alias("n_shingles"), least.alias("component_id"), F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"))
