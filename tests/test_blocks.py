"""Searches by blocks against plain joins of all pairs."""

import math
import re
import time

import numpy as np
import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lumengrid import config
from lumengrid.operators import als, blocks
from lumengrid.plans import evaluate


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sample", [16_384, 100])
def test_lsh_is_the_join_by_buckets(spark, monkeypatch, sample):
    monkeypatch.setattr(blocks, "SAMPLE", sample)
    monkeypatch.setattr(blocks, "PASS", 7)  # several passes
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 16))
    v[600:] = v[:300]  # copies: ties go to the smaller id
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "item_id long, embedding array<double>")
    unit = Normalizer(p=2.0, inputCol="raw", outputCol="unit").transform(df.select("item_id", array_to_vector("embedding").alias("raw")))
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=als.BUCKET, numHashTables=als.TABLES, seed=config.SEED).fit(unit)
    pairs = model.approxSimilarityJoin(unit.where("item_id % 50 = 0"), unit, als.WITHIN, distCol="distance").select(F.col("datasetA.item_id").alias("q"), F.col("datasetB.item_id").alias("i"), "distance").collect()
    wanted = {(q, i) for q in range(0, 900, 50) for _, i in sorted((round(r.distance, 12), r.i) for r in pairs if r.q == q != r.i)[:10]}
    got = als.lsh_neighbours(df, F.col("item_id") % 50 == 0, 10)
    assert {(r.query_id, r.item_id) for r in got.collect()} == wanted
    assert "Join" not in plan(got) and "Generate" not in plan(got)  # pairs and copies of vectors never become rows


def plain_best(ranker, items, users, n):
    """{user_id: item_ids} by all pairs; a missing score comes last, one that is not a number first, ties by item_id."""

    def minmax(xs):
        good = [x for x in xs if x is not None and math.isfinite(x)]
        if not good:
            return [0.0] * len(xs)
        lo, hi = min(good), max(good)
        if hi - lo < 1e-12:
            return [0.5 if x is not None and math.isfinite(x) else 0.0 for x in xs]
        return [0.0 if x is None or not math.isfinite(x) else (x - lo) / (hi - lo) for x in xs]

    def dot(a, b):
        return None if a is None or b is None else float(np.dot(a, b))

    out = {}
    for place, (user, profile, factor) in enumerate(users):
        semantic = [None if e is None else dot(profile, np.array(e) / np.linalg.norm(e)) for _, e, _, _, _ in items]
        behavioral = [dot(factor, f) for _, _, f, _, _ in items]
        hybrid = [0.45 * a + 0.4 * b + 0.15 * c for a, b, c in zip(minmax(semantic), minmax(behavioral), minmax([x[3] for x in items]), strict=True)]
        scores = {"embeddings_only": semantic, "cf_only": behavioral, "hybrid": hybrid}[ranker]
        order = sorted((s is None, 0 if s is None or math.isnan(s) else 1, 0 if s is None or math.isnan(s) else -round(s, 9), i[0]) for s, i in zip(scores, items, strict=True) if place not in (i[4] or []))
        out[user] = [x[3] for x in order[:n]]
    return out


def best_by_blocks(spark, ranker):
    rng = np.random.default_rng(3)
    items = []
    for k in range(500):
        e, f = (rng.normal(size=d).round(1).tolist() for d in (6, 4))
        items.append([k, e if k % 50 else None, f if k % 7 else None, float(k % 30) if k % 11 else None, rng.integers(0, 9, 3).tolist() if k % 3 else None])
    for k in range(250, 300):  # copies
        items[k][1:3] = items[k - 250][1:3]
    items[123][2] = [float("nan")] * 4
    users = [(100 + p, (v := rng.normal(size=6)) / np.linalg.norm(v), rng.normal(size=4) if p != 5 else None) for p in range(9)]
    found = evaluate.Cohort(np.array([u[0] for u in users]), np.array([u[1] for u in users]), np.ones(9, bool), np.array([np.zeros(4) if u[2] is None else u[2] for u in users]), np.array([u[2] is not None for u in users]))
    df = spark.createDataFrame(items, "item_id long, embedding array<double>, factor array<double>, bayes_score double, rated array<long>").repartition(3)
    got = evaluate.ranked(df, found, (ranker,), 25)
    assert "Join" not in plan(got)  # the cohort never meets the catalog row by row
    out = {}
    for r in got.orderBy("rank").collect():
        out.setdefault(r.user_id, []).append(r.item_id)
    assert out == plain_best(ranker, items, users, 25)


def test_hybrid_by_blocks(spark):
    best_by_blocks(spark, "hybrid")


def test_semantic_by_blocks(spark):
    best_by_blocks(spark, "embeddings_only")


def fitted(spark):
    rows = spark.createDataFrame([(u, i, float(1 + (u * i) % 5), 0) for u in range(60) for i in range(40) if (u + i) % 3], "user_id long, item_id long, rating double, ts long")
    return als.fit(rows, rank=4)


def test_als_deletes_what_iterations_shuffled(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return set(re.findall(r"shuffle_(\d+)_", files.mkString(" ")))

    before = shuffles()
    model = fitted(spark)  # ten iterations, two shuffles each
    for _ in range(20):
        left = shuffles() - before
        if len(left) < 12:
            break
        time.sleep(0.5)  # files are deleted in the background
    assert len(left) < 12 and als.item_factors(model).count() == 40


def test_top_items_are_those_of_all_pairs(spark):
    model = fitted(spark)
    u, v = ({r[0]: np.array(r[1]) for r in f(model).collect()} for f in (als.user_factors, als.item_factors))
    got = als.top_items(model, 5, F.col("user_id") % 3 == 0)
    assert "Join" not in plan(got)
    rows = {}
    for r in got.orderBy("user_id", F.desc("score"), "item_id").collect():
        rows.setdefault(r.user_id, []).append(r.score)
    assert set(rows) == {x for x in u if x % 3 == 0}
    for x, scores in rows.items():
        assert scores == pytest.approx(sorted((float(u[x] @ w) for w in v.values()), reverse=True)[:5], abs=1e-5)


def test_behavioral_by_blocks(spark):
    best_by_blocks(spark, "cf_only")
