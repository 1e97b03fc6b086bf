"""Neighbours in the suffix array, against pairs of all suffixes; dealt over several tasks."""

import random

import pytest
from pyspark.sql import functions as F

from lumengrid.llm import suffixarray
from lumengrid.llm.common import prepare, stored


def packed(found):
    return [found[2 * k] - (1 << 32) << 32 | found[2 * k + 1] if found[2 * k] else found[2 * k + 1] for k in range(3)]


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_neighbours(spark, parts, monkeypatch):
    rng = random.Random(int(parts))
    need = 400 - suffixarray.window(400) - suffixarray.GRAM + 1
    letters = [1 << 31 | rng.getrandbits(24) << 7 | rng.choice([20, 60, 90, 127]) for _ in range(4)]
    rows = []
    for s in range(30):
        text = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
        for j in range(len(text)):
            rows.append((s, j, rng.choice([-1, 0, 60, 127]), (text[j : j + 6] + [0] * 6)[:6]))

    def agree(a, b):
        same = next((k for k in range(6) if a[k] != b[k] or not a[k]), 6)
        return same == 6, sum((x & 127) + 1 for x in a[:same])

    wanted = set()
    for k, (s, j, reach, own) in enumerate(rows):
        best = [agree(own, other) for m, (*_, other) in enumerate(rows) if m != k]
        if reach >= 0 and any(full or size >= need - reach for full, size in best):
            wanted.add((s, j))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(s, j, r, *packed(x)) for s, j, r, x in rows], "id long, i long, reach long, k0 long, k1 long, k2 long")
        calls, keep = [], suffixarray.stored
        monkeypatch.setattr(suffixarray, "stored", lambda x: calls.append(x) or keep(x))
        got = {tuple(r) for r in suffixarray.neighbours(stored(df), 400).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == wanted and 0 < len(wanted) < len(rows)
    assert len(calls) == 2  # what is written, once for the order and once for what is found


def test_candidates_write_few_tables(spark, monkeypatch):
    """Six letters are all that neighbours are compared on: no rounds of names are written for them."""
    prepare(spark)
    rng = random.Random(4)
    shared = "".join(rng.choices("abcdefgh ", k=3000))
    docs = spark.createDataFrame([(k, "".join(rng.choices("abcdefgh ", k=500)) + shared * (k < 3)) for k in range(6)], "doc_id long, text string")
    wide = stored(suffixarray.strings(docs).select(F.col("doc_id").alias("id"), "letters"))
    calls, keep = [], suffixarray.stored
    monkeypatch.setattr(suffixarray, "stored", lambda x: calls.append(x) or keep(x))
    monkeypatch.setattr("lumengrid.llm.order.stored", lambda x: calls.append(x) or keep(x))
    found = {r.id for r in suffixarray.candidates(wide).collect()}
    assert found == {0, 1, 2} and len(calls) == 4
