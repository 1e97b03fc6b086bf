"""Operators that compare documents, against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumengrid.llm import fingerprints, graph, kneserney, minhash, secrets, suffixarray
from lumengrid.llm.common import prepare, stored
from tests.llm import fixture as fx


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(prepare(spark)).dropDuplicates(["doc_id"])


def own_texts():
    return {k * 3: t or "" for k, t in enumerate(fx.texts())}


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def shingles(text):
    w = fx.words(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_components(given):
    sets = {i: shingles(t) for i, t in given.items()}
    parent = {i: i for i in given}
    for i in given:
        for j in given:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    return sets, {i: find(parent, i) for i in given}


def test_minhash(docs):
    sets, wanted = near_components(own_texts())
    got = fx.rows(minhash.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), wanted[i], wanted[i] == i) for i in wanted}
    assert len(set(wanted.values())) < len(wanted)
    assert minhash.near_duplicates(fx.empty(docs)).count() == 0


def test_minhash_repeated_rows(spark):
    df = fx.documents(spark)
    assert minhash.near_duplicates(df).count() == len(fx.texts()) + 1


def test_minhash_template_family(spark):
    """300 pairs of similarity 84 / 108 in one family, whose other pairs have 80 / 112."""
    template = " ".join(f"t{k}" for k in range(84))
    rows = [(2 * p + s, " ".join([template, *(f"p{p}x{k}" for k in range(4)), *(f"u{p}x{s}x{k}" for k in range(12))])) for p in range(300) for s in range(2)]
    got = minhash.near_duplicates(prepare(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}


def test_minhash_shared_template(spark):
    """300 documents share 404 words; two of them add 60 words each (similarity 400 / 520), the others 76 (at most 400 / 536)."""
    template = " ".join(f"t{k}" for k in range(404))
    rows = [(i, " ".join([template, *(f"u{i}x{k}" for k in range(60 if i in (100, 200) else 76))])) for i in range(300)]
    got = minhash.near_duplicates(prepare(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 100 if i == 200 else i for i, _ in rows}


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (102, 102), (103, 101)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def cut_bytes(given, length=400):
    seen = {}
    data = {i: t.encode() for i, t in given.items()}
    for b in data.values():
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = {}
    for i, b in data.items():
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = len(b), sum(gone), runs, left
    return out


def test_suffixarray(docs):
    wanted = cut_bytes(own_texts())
    got = fx.rows(suffixarray.deduplicate(docs))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in got.items()} == wanted
    assert all(r.kept_sha256 == hashlib.sha256(r.kept).hexdigest() for r in got.values())
    assert sum(x[1] > 0 for x in wanted.values()) > 8
    assert suffixarray.deduplicate(fx.empty(docs)).count() == 0


def test_suffixarray_repeated_rows(spark):
    got = [r for r in suffixarray.deduplicate(fx.documents(spark)).collect() if r.doc_id == 21]
    assert len(got) == 2 and all(r.n_removed == r.n_bytes for r in got)


@pytest.mark.parametrize("letters", [2, 5])
def test_suffix_order(spark, letters):
    """All suffixes of some strings, fully sorted."""
    import random

    rng = random.Random(letters)
    strings = {s: [rng.randint(1, letters) for _ in range(rng.randint(1, 40))] for s in range(9)}
    rows = [(s, j, x, 1) for s, text in strings.items() for j, x in enumerate(text)]
    order = suffixarray.suffix_order(stored(spark.createDataFrame(rows, "s long, j long, x long, size long")), enough=1000)
    got = [strings[r.s][r.j :] for r in order.orderBy("place").collect()]
    assert got == sorted(got) and len(got) == len(rows)


@pytest.mark.parametrize("most", [3, 6])
def test_suffix_order_of_some_letters(spark, most):
    """Suffixes that agree on so many letters may stand in any order; all others are sorted."""
    import random

    rng = random.Random(most)
    strings = {s: [rng.randint(1, 2) for _ in range(rng.randint(1, 60))] for s in range(9)} | {9: [1] * 50, 10: [1] * 70}
    rows = [(s, j, x, 1) for s, text in strings.items() for j, x in enumerate(text)]
    order = suffixarray.suffix_order(stored(spark.createDataFrame(rows, "s long, j long, x long, size long")), 1000, most).collect()
    assert len(order) == len(rows)
    places = {}
    for r in order:
        places.setdefault(tuple(strings[r.s][r.j : r.j + most]), []).append(r.place)
    last = -1
    for _, found in sorted(places.items()):
        assert last < min(found)
        last = max(found)


def cut_words(given, seen=frozenset()):
    seen, out = set(seen), {}
    for i in sorted(given):
        w = fx.words(given[i])
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        out[i] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    return out, seen


def test_fingerprints(docs):
    wanted, _ = cut_words(own_texts())
    got = fx.rows(fingerprints.deduplicate(docs))
    assert {i: (r.n_words, r.n_removed, r.kept) for i, r in got.items()} == wanted
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in got.values())
    assert fingerprints.deduplicate(fx.empty(docs)).count() == 0


def test_fingerprints_by_batches(docs):
    """History first, then two batches against the compacted index."""
    given = own_texts()
    parts = [{i: t for i, t in given.items() if i // 3 % 3 == k} for k in range(3)]
    _, seen = cut_words(parts[0])
    _, first = fingerprints.removed_spans(docs.where("doc_id div 3 % 3 = 0"))
    index = [first]
    for k in (1, 2):
        batch, history = docs.where(f"doc_id div 3 % 3 = {k}"), docs.where(f"doc_id div 3 % 3 < {k}")
        wanted, seen = cut_words(parts[k], seen)
        got = fx.rows(fingerprints.deduplicate(batch, index, history))
        assert {i: (r.n_words, r.n_removed, r.kept) for i, r in got.items()} == wanted
        _, run = fingerprints.removed_spans(batch, index, history)
        index = fingerprints.compact([*index, run])
        assert len(index) == 1


def test_fingerprints_of_patterns(spark):
    """Two windows that differ in a word alone, whose letters follow a pattern that sums modulo 2**64 can't tell from its complement."""
    a = "a"
    while len(a) < 1024:
        a += a.translate({97: 98, 98: 97})
    words = [f"w{k}" for k in range(19)]
    rows = [(1, " ".join([a, *words])), (2, " ".join([a.translate({97: 98, 98: 97}), *words]))]
    got = fingerprints.deduplicate(prepare(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_pipeline(spark, tmp_path):
    docs = fx.documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    fx.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "substrings", "secrets", "packing"]
    now, d = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    good = {r.doc_id for r in kneserney.classify(docs, fx.labels(spark)).collect() if r.kept}
    given = {i: t for i, t in own_texts().items() if i in good}
    _, comp = near_components(given)
    given = {i: t for i, t in given.items() if comp[i] == i}
    left = {i: x[3].decode(errors="ignore") for i, x in cut_bytes(given, corpus_pipeline.PASSAGE).items()}
    given = {i: left[i] for i, t in given.items() if left[i] == t or left[i].strip()}
    given = {i: secrets.redact(t) for i, t in given.items()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, d)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
    assert {r.doc_id: r.text or "" for r in now.collect()} == given
    pieces = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(given)
    assert now.where(F.col("text").isNotNull() & (F.length("text") != F.col("n_chars"))).count() == 0


def test_near_keeps_rows_without_id(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "g h i j k l"), (None, "m n o p q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "11L AS n_chars")
    assert sorted(r.text for r in corpus_pipeline.near(spark, docs, "").collect()) == ["a b c d e f", "g h i j k l", "m n o p q r"]


def test_empty_pipeline(spark, tmp_path):
    fx.empty(fx.documents(spark)).write.parquet(f"{tmp_path}/documents.parquet")
    fx.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
