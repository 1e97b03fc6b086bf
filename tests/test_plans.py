import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.operators import als, gate, parser
from lumengrid.plans import catalog, discover, evaluate

RATINGS = "user_id long, item_id long, rating double, ts long"


def split(spark, rows, **kw):
    return {(r.user_id, r.item_id): r.is_test for r in evaluate.temporal_split(spark.createDataFrame(rows, RATINGS), **kw).collect()}


def test_split_holds_out_the_last(spark):
    got = split(spark, [(1, k, 3.0, 1000 + k) for k in range(1, 11)])
    assert sorted(k[1] for k, v in got.items() if v) == [9, 10]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 21])
def test_split_counts(spark, n):
    got = split(spark, [(1, k, 3.0, k) for k in range(n)])
    assert sum(got.values()) == min(math.ceil(0.2 * n), n - 1) and len(got) == n


def test_split_ties_and_leakage(spark):
    got = split(spark, [(1, i, 3.0, 50) for i in (4, 2, 9, 7)] + [(1, 1, 3.0, 10)])
    assert [k[1] for k, v in got.items() if v] == [9]
    rng = random.Random(7)
    rows = [(u, i, 3.0, rng.randint(0, 500)) for u in range(40) for i in range(rng.randint(2, 12))]
    got, ts = split(spark, rows), {(u, i): t for u, i, _, t in rows}
    for u in range(40):
        assert min(ts[k] for k, v in got.items() if v and k[0] == u) >= max(ts[k] for k, v in got.items() if not v and k[0] == u)


@pytest.mark.parametrize("share", [0.0, 1.0, -0.1, 1.5])
def test_split_rejects(spark, share):
    with pytest.raises(ValueError):
        evaluate.temporal_split(spark.createDataFrame([], RATINGS), share)


def test_metrics(spark):
    best = spark.createDataFrame([("r", 1, i, k) for k, i in enumerate((10, 20, 30, 40, 50), 1)], "ranker string, user_id long, item_id long, rank int")
    relevant = spark.createDataFrame([(1, 20), (1, 50), (1, 99)], "user_id long, item_id long")
    got = {r.k: r for r in evaluate.metrics(best, relevant, spark.createDataFrame([(1,)], "user_id long")).collect()}
    assert got[10].precision == pytest.approx(0.2) and got[10].recall == pytest.approx(2 / 3)


def test_profiles(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [4.0, 4.0])], "item_id long, embedding array<double>")
    rows = spark.createDataFrame([(1, 1, 5.0, 1), (1, 2, 4.0, 2), (1, 3, 1.0, 3), (2, 3, 2.0, 1), (2, 1, 1.0, 2)], RATINGS)
    got = {r.user_id: r.profile for r in evaluate.profiles(rows, vectors).collect()}
    assert got[1] == [0.5, 0.5] and got[2] == [2.5, 2.0]


def test_top_tags_ties(spark):
    scores = spark.createDataFrame([(1, t, 0.9) for t in range(20)] + [(1, 30, 0.4)], "item_id long, tag_id long, relevance double")
    tags = spark.createDataFrame([(t, f"t{t:02}") for t in range(31)], "tag_id long, tag string")
    assert catalog.top_tags(scores, tags).first().keywords == [f"t{t:02}" for t in range(14, -1, -1)]


def test_empty_ratings(spark):
    assert catalog.bayes_stats(spark.createDataFrame([], RATINGS)).collect() == []


CATALOG = "item_id long, title string, release_year int, genres array<string>, vote_average double, rating_count long, rating_mean double, bayes_score double, embedding array<double>, factor array<double>"


def small(spark):
    return spark.createDataFrame(
        [(1, "Alpha", 1990, ["Drama"], 8.0, 5, 4.0, 3.0, [0.2, 1.0], [1.0, 0.0]), (2, "Alpha Beta", 2000, ["War"], None, 9, 3.5, 4.5, [0.9, 0.1], [0.0, 1.0]), (3, "Gamma", None, None, 6.0, None, None, 2.0, [0.1, 1.0], None)],
        CATALOG,
    )


def test_references_and_behavioral(spark):
    c = small(spark)
    refs = discover.references(c, ["alpha", "beta", "nothing"])
    assert {(r.asked, r.item_id) for r in refs.collect()} == {(0, 1), (1, 2)}
    got = {r.item_id: r.behavioral for r in discover.behavioral(c, refs).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: None}
    assert {r.behavioral for r in discover.behavioral(c, refs.limit(0)).collect()} == {None}
    assert discover.references(c, []).count() == 0


def test_hybrid_and_neighbours(spark):
    c = small(spark)
    p = discover.pool(c, F.array(F.lit(1.0), F.lit(0.0)), parser.Spec())
    page = discover.hybrid(discover.behavioral(p, discover.references(c, ["Alpha"]))).orderBy("rank").collect()
    assert page[0].rank == 1 and {r.item_id for r in page} == {1, 2, 3} and page[-1].item_id == 3 and page[-1].behavioral is None
    assert page[0].fans_of == ["Alpha"] and page[-1].fans_of == []
    absent = discover.behavioral(p, discover.references(c, ["Gamma"]))  # known, but without a factor
    rest = discover.hybrid(absent).orderBy("rank").collect()
    assert rest[0].item_id == 2 and rest[0].score == 1.0 and all(r.fans_of == [] for r in rest)  # the two signals left share all weight
    assert discover.hybrid(absent.limit(0)).collect() == []
    assert [r.item_id for r in discover.pool(c, F.array(F.lit(1.0), F.lit(0.0)), parser.Spec(), discover.references(c, ["beta"])).collect()] == [1, 3]
    assert [r.item_id for r in discover.neighbours(c, 1, "embedding").collect()] == [3, 2]
    assert discover.neighbours(c, 3, "factor").collect() == []


def test_filters(spark):
    c = small(spark)
    got = {r.item_id for r in c.where(parser.predicate(parser.Spec(), (2,))).collect()}
    assert got == {1, 3}
    ids = lambda spec, *out: [r.item_id for r in c.where(parser.predicate(spec, tuple(out))).orderBy("item_id").collect()]
    assert ids(parser.Spec()) == [1, 2, 3]
    assert ids(parser.Spec(exclude=["drama"])) == [2, 3]
    assert ids(parser.Spec(include=["DRAMA"])) == [1]
    assert ids(parser.Spec(start=1995)) == [2]
    assert ids(parser.Spec(min_rating=6.5)) == [1, 2]
    assert ids(parser.Spec(), 2) == [1, 3]


def test_als(spark):
    rows = spark.createDataFrame([(u, i, float(1 + (u + i) % 5), 0) for u in range(12) for i in range(10) if (u * i) % 3], RATINGS)
    model = als.fit(rows, rank=4)
    assert als.item_factors(model).count() and all(len(r.features) == 4 for r in als.user_factors(model).collect())
    assert als.top_items(model, 3).groupBy("user_id").count().where("count <> 3").count() == 0


def test_encoder_and_lsh(spark):
    v = als.hashed_vectors(spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "x y z")], "item_id long, text string"), 64)
    assert all(sum(x * x for x in r.embedding) == pytest.approx(1.0, abs=1e-5) for r in v.collect())
    near = als.lsh_neighbours(v.select("item_id", F.col("embedding").cast("array<double>").alias("embedding")), F.col("item_id") == 1, 1).collect()
    assert [(r.query_id, r.item_id) for r in near] in ([(1, 2)], [])
    texts = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert len(als.encoded(texts, 32).first().embedding) == 32
    with pytest.raises(Exception, match="has not 32 numbers"):
        als.encoded(texts, 32, lambda t: als.hashed_vectors(t, 16)).collect()


def test_lsh_recall(spark):
    """Against brute force, for every id divisible by 50."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(60, 32))
    v = middles[rng.integers(0, 60, 3000)] + 0.5 * rng.normal(size=(3000, 32))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "item_id long, embedding array<double>")
    got: dict[int, set] = {}
    for r in als.lsh_neighbours(df, F.col("item_id") % 50 == 0, 10).collect():
        got.setdefault(r.query_id, set()).add(r.item_id)
    hits = 0
    for q in range(0, 3000, 50):
        near = u @ u[q]
        near[q] = -2
        hits += len(set(np.argsort(-near)[:10].tolist()) & got.get(q, set()))
    assert hits >= 0.9 * 600


def test_evaluation_of_trained_factors(spark, tmp_path):
    rng = random.Random(3)
    rows = [(u, i, 5.0 if (u + i) % 2 else 1.0, rng.randint(0, 999)) for u in range(30) for i in rng.sample(range(40), 14)]
    items = spark.createDataFrame([(i, [1.0, float(i % 2)], 2.0, None) for i in range(40)], "item_id long, embedding array<double>, bayes_score double, factor array<double>")
    got = evaluate.evaluate_trained(spark.createDataFrame(rows, RATINGS), items, rank=4)
    doc = evaluate.result_document(got, "full", 40)
    assert set(doc["rankers"]) == set(evaluate.RANKERS) and doc["n_users_evaluated"] > 10 and set(doc["rankers"]["hybrid"]) == {"precision@10", "recall@10", "precision@25", "recall@25"}
    assert doc["rankers"]["cf_only"]["recall@10"] > doc["rankers"]["embeddings_only"]["recall@10"] - 1
    gate.promote(doc, tmp_path / "base.json", "first")
    gate.write_result(doc, tmp_path / "results")
    assert gate.run_gate(tmp_path / "results", tmp_path / "base.json") == 0
    with pytest.raises(ValueError, match="no user"):
        evaluate.result_document(got.limit(0), "full", 40)
