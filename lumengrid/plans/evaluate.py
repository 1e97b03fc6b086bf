"""Leakage-free evaluation: split by time, score a cohort against the whole catalog, precision and recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumengrid import config
from lumengrid.functions import scoring
from lumengrid.operators import als, blocks
from lumengrid.plans import catalog
from lumengrid.sources import store


def temporal_split(ratings: DataFrame, holdout: float = config.HOLDOUT) -> DataFrame:
    """ratings with is_test: each user's last ratings (a share, rounded up, but never all); ties of time by item_id."""
    if not 0 < holdout < 1:
        raise ValueError("holdout must lie between 0 and 1")
    user = Window.partitionBy("user_id")
    place = F.row_number().over(user.orderBy("ts", "item_id"))
    n = F.count(F.lit(1)).over(user)
    marked = ratings.select("*", place.alias("place"), n.alias("n"))
    return marked.withColumn("is_test", F.col("place") > F.col("n") - F.least(F.ceil(F.col("n") * F.lit(holdout)), F.col("n") - 1)).drop("place", "n")


def cohort(train: DataFrame, test: DataFrame, items: DataFrame, limit: int = config.COHORT_LIMIT) -> DataFrame:
    """user_id of those with a train rating and a liked test rating on the items."""
    a = train.join(items.select("item_id"), "item_id", "left_semi").select("user_id")
    b = test.where(F.col("rating") >= config.LIKED).join(items.select("item_id"), "item_id", "left_semi").select("user_id")
    return a.intersect(b).orderBy("user_id").limit(limit)


def profiles(train: DataFrame, vectors: DataFrame) -> DataFrame:
    """user_id and profile: the mean vector of liked items, or of all rated ones where none is liked."""
    rated = train.join(vectors.select("item_id", "embedding"), "item_id")
    any_liked = F.max((F.col("rating") >= config.LIKED).cast("int")).over(Window.partitionBy("user_id"))
    used = rated.withColumn("any_liked", any_liked).where((F.col("rating") >= config.LIKED) | (F.col("any_liked") == 0))
    mean = Summarizer.mean(array_to_vector("embedding"))
    return used.groupBy("user_id").agg(vector_to_array(mean).alias("profile"))


def user_factors(train: DataFrame, factors: DataFrame) -> DataFrame:
    """Fixed user factors for checks: the mean factor of a user's rated items."""
    return profiles(train.withColumn("rating", F.lit(5.0)), factors.withColumnRenamed("factor", "embedding")).withColumnRenamed("profile", "user_factor")


RANKERS = ("embeddings_only", "cf_only", "hybrid")


#: What a ranker reads of an item, besides its item_id.
READS = {"embeddings_only": ("embedding",), "cf_only": ("factor",), "hybrid": ("embedding", "factor", "bayes_score")}
NEAR = 1e-9
#: Stands for a missing score, which comes last; one that is not a number comes first, as in SQL.
MISSING = -np.finfo(np.float64).max


@dataclass
class Cohort:
    """The users of an evaluation: unit profiles and factors as rows, which of them are known, and the limits of hybrid signals by user."""

    ids: np.ndarray
    profile: np.ndarray
    has_profile: np.ndarray
    factor: np.ndarray
    has_factor: np.ndarray
    limits: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), scoring.FLAT)


def _parts(rows: Iterator[pa.RecordBatch], users: Cohort, reads: tuple[str, ...]) -> Iterator[tuple[np.ndarray, slice, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Item ids, a range of users, their signals (MISSING for a missing score), and users and items of pairs rated in train; all pairs, block by block."""
    size = 16
    for batch in rows:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        ids = columns["item_id"].to_numpy()
        found = {}
        if "embedding" in reads:
            v, good = blocks.vectors(columns["embedding"], users.profile.shape[1])
            found["semantic"] = (users.profile, users.has_profile, _unit(v), good)
        if "factor" in reads:
            found["behavioral"] = (users.factor, users.has_factor, *blocks.vectors(columns["factor"], users.factor.shape[1]))
        lists = columns["rated"]
        seen_users = lists.flatten().to_numpy()
        seen_items = np.repeat(np.arange(len(ids)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        for lo, hi in blocks.growing(len(ids), size):
            of = (seen_items >= lo) & (seen_items < hi)
            block_users, block_items = seen_users[of], seen_items[of] - lo
            for q in range(0, len(users.ids), blocks.QUERIES):
                at = slice(q, q + blocks.QUERIES)
                signals = {}
                for name, (own, known, v, good) in found.items():
                    signals[name] = own[at] @ v[lo:hi].T
                    signals[name][~known[at]] = MISSING
                    signals[name][:, ~good[lo:hi]] = MISSING
                if "bayes_score" in reads:
                    signals["quality"] = columns["bayes_score"].slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.float64)[None, :]
                these = (block_users >= q) & (block_users < q + blocks.QUERIES)
                yield ids[lo:hi], at, signals, block_users[these] - q, block_items[these]
        size = blocks.ITEMS


def _rounded(score: np.ndarray) -> np.ndarray:
    """Nine decimals; large and infinite numbers stay."""
    small = np.abs(score) < 1e6
    return np.where(small, np.round(np.where(small, score, 0.0), 9) + 0.0, score)


def _scaled(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """scoring.minmax() with known limits, by row."""
    flat, none = high - low < scoring.FLAT, np.isnan(low)
    x = np.where(x == MISSING, np.nan, x)
    out = (x - low) / np.where(flat | none, 1.0, high - low)
    out = np.where(flat, 0.5, out) if flat.any() else out
    wild = ~np.isfinite(x)
    if wild.any():
        out = np.where(wild, np.where((x == np.inf) & ~flat, 1.0, 0.0), out)
    return np.where(none, 0.0, out) if none.any() else out


def _limits(items: DataFrame, users: Cohort, sent: Broadcast) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Least and greatest finite value of each hybrid signal over a user's whole catalog; NaN where there is none."""
    names = list(config.WEIGHTS)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        users = sent.value
        low, high = (np.full((len(users.ids), len(names)), x) for x in (np.inf, -np.inf))
        for _, at, signals, _, _ in _parts(rows, users, READS["hybrid"]):
            for k, name in enumerate(names):
                x = signals[name]
                good = np.isfinite(x) & (x != MISSING)
                whole = good.all()
                low[at, k] = np.minimum(low[at, k], (x if whole else np.where(good, x, np.inf)).min(axis=1))
                high[at, k] = np.maximum(high[at, k], (x if whole else np.where(good, x, -np.inf)).max(axis=1))
        place = np.arange(len(users.ids))
        yield pa.RecordBatch.from_arrays([pa.array(place), *(pa.array(x[:, k]) for k in range(len(names)) for x in (low, high))], names=kinds)

    kinds = ["place", *(f"{side}_{name}" for name in names for side in ("low", "high"))]
    found = items.mapInArrow(run, ", ".join(f"{k} {'long' if k == 'place' else 'double'}" for k in kinds)).groupBy("place")
    found = found.agg(*((F.min if k.startswith("low") else F.max)(k).alias(k) for k in kinds[1:])).toArrow()
    out = {}
    for name in names:
        both = [np.full(len(users.ids), np.nan) for _ in range(2)]
        for side, x in zip(("low", "high"), both, strict=True):
            values = found.column(f"{side}_{name}").to_numpy()
            x[found.column("place").to_numpy()] = np.where(np.isfinite(values), values, np.nan)
        out[name] = tuple(x[:, None] for x in both)
    return out


def ranked(items: DataFrame, users: Cohort, rankers: tuple[str, ...], n: int = max(config.CUTOFFS)) -> DataFrame:
    """ranker, user_id, item_id and rank of the n best items not rated in train; ties of rounded scores by item_id, missing scores last.

    items: item_id, what the rankers read, and rated (places of the users that rated the item in train). Every user meets the whole
    catalog, in blocks; hybrid scores are scaled over a user's whole catalog, in a pass of their own before.
    """
    context = items.sparkSession.sparkContext
    if "hybrid" in rankers:
        users.limits = _limits(items, users, context.broadcast(users))
    sent = context.broadcast(users)
    reads = tuple(dict.fromkeys(c for r in rankers for c in READS[r]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        users = sent.value
        best = {r: blocks.Best(len(users.ids), n) for r in rankers}
        for ids, at, signals, seen_users, seen_items in _parts(rows, users, reads):
            for r in rankers:
                if r == "hybrid":
                    limits = {name: [x if len(x) == 1 else x[at] for x in both] for name, both in users.limits.items()}
                    score = sum((weight * _scaled(signals[name], *limits[name]) for name, weight in scoring.shares(list(config.WEIGHTS), config.WEIGHTS).items()), 0.0)
                else:
                    name = "semantic" if r == "embeddings_only" else "behavioral"
                    score = np.where(np.isnan(signals[name]), np.inf, signals[name])
                near = score >= best[r].floor[at][:, None] - NEAR
                near[seen_users, seen_items] = False
                q, i = np.nonzero(near)
                best[r].add(q + at.start, _rounded(score[q, i]), ids[i])
                if len(ids) < blocks.ITEMS and at.stop >= len(users.ids):
                    best[r].merge()
        for r in rankers:
            for part in blocks.batches(best[r], users.ids, ["user_id", "item_id", "key"]):
                yield pa.RecordBatch.from_arrays([pa.array([r] * part.num_rows, pa.string()), *part.columns], names=["ranker", *part.schema.names])

    top = Window.partitionBy("ranker", "user_id").orderBy(F.desc("key"), "item_id")
    found = items.mapInArrow(run, "ranker string, user_id long, item_id long, key double").withColumn("rank", F.row_number().over(top))
    return found.where(F.col("rank") <= n).select("ranker", "user_id", "item_id", "rank")


def metrics(best: DataFrame, relevant: DataFrame, users: DataFrame) -> DataFrame:
    """ranker, k, precision and recall, averaged over users; the divisor of precision stays k."""
    hits = best.join(relevant.select("user_id", "item_id").withColumn("hit", F.lit(1)), ["user_id", "item_id"], "left")
    wanted = relevant.groupBy("user_id").agg(F.count("*").alias("wanted"))
    rankers = best.select("ranker").distinct()
    base = users.select("user_id").join(wanted, "user_id").crossJoin(F.broadcast(rankers))
    out = None
    for k in config.CUTOFFS:
        got = hits.where(F.col("rank") <= k).groupBy("ranker", "user_id").agg(F.sum("hit").alias("got"))
        each = base.join(got, ["ranker", "user_id"], "left").fillna(0, ["got"])
        part = each.groupBy("ranker").agg(F.lit(k).alias("k"), F.round(F.avg(F.col("got") / F.lit(float(k))), 9).alias("precision"), F.round(F.avg(F.col("got") / F.col("wanted")), 9).alias("recall"), F.count("*").alias("users"))
        out = part if out is None else out.unionByName(part)
    return out


def kept_split(ratings: DataFrame) -> DataFrame:
    """temporal_split() without times, written once."""
    return store.kept(temporal_split(ratings).drop("ts"))


def _split(ratings: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What kept_split() gives, as it is or made here; and what is to be deleted in the end."""
    if "is_test" in ratings.columns:
        return ratings, []
    split = kept_split(ratings)
    return split, [split]


def evaluate(ratings: DataFrame, items: DataFrame, factors: DataFrame, users_limit: int = config.COHORT_LIMIT, rankers: tuple[str, ...] = RANKERS) -> DataFrame:
    """metrics() with fixed factors of items; a user's factor is the mean of those rated in train. ratings: or what kept_split() made of them."""
    split, spent = _split(ratings)
    out = _measured(split, items, lambda train, _: user_factors(train, factors), users_limit, rankers)
    store.drop(*spent)
    return out


def evaluate_trained(ratings: DataFrame, items: DataFrame, users_limit: int = config.COHORT_LIMIT, rankers: tuple[str, ...] = RANKERS, rank: int = config.ALS_RANK) -> DataFrame:
    """metrics() with factors and statistics that have seen the train side alone."""
    split, spent = _split(ratings)
    model = als.fit(split.where("not is_test"), rank)
    of_items, of_users = store.kept(als.item_factors(model)), store.kept(als.user_factors(model))
    del model
    store.release(split.sparkSession)  # what the fit has shuffled and cached
    stats = catalog.bayes_stats(split.where("not is_test")).select("item_id", "bayes_score")
    own = items.drop("factor", "bayes_score").join(of_items.withColumnRenamed("features", "factor"), "item_id", "left").join(stats, "item_id", "left")
    renamed = of_users.withColumnRenamed("features", "user_factor")
    out = _measured(split, own, lambda _, users: renamed.join(F.broadcast(users), "user_id", "left_semi"), users_limit, rankers)
    store.drop(of_items, of_users, *spent)
    return out


def _measured(split: DataFrame, items: DataFrame, of_users: Callable[[DataFrame, DataFrame], DataFrame], users_limit: int, rankers: tuple[str, ...]) -> DataFrame:
    """of_users: the factors (user_id, user_factor) by a cohort's train ratings and its user_ids."""
    spark = split.sparkSession
    ids = store.kept(items.select(F.col("item_id").cast("long").alias("item_id")))
    known = split.join(ids, "item_id", "left_semi")
    chosen = [r.user_id for r in cohort(known.where("not is_test"), known.where("is_test"), ids, users_limit).collect()]  # users_limit at most
    users = spark.createDataFrame([(u,) for u in chosen], "user_id long")
    own = store.kept(known.join(F.broadcast(users), "user_id", "left_semi"))
    train, relevant = own.where("not is_test"), own.where(F.col("is_test") & (F.col("rating") >= config.LIKED)).select("user_id", "item_id")
    places = spark.createDataFrame(list(zip(chosen, range(len(chosen)), strict=True)), "user_id long, place long")
    rated = train.join(F.broadcast(places), "user_id").groupBy("item_id").agg(F.collect_set("place").alias("rated"))
    reads = list(dict.fromkeys(c for r in rankers for c in READS[r]))
    wanted = store.kept(items.select("item_id", *reads).join(rated, "item_id", "left"))
    vectors = places
    if "embedding" in reads:
        vectors = vectors.join(profiles(train, wanted), "user_id")
    if "factor" in reads:
        vectors = vectors.join(of_users(train, users), "user_id", "left")
    table = vectors.orderBy("place").toArrow()
    sides = {}
    for name in ("profile", "user_factor"):
        column = table.column(name).combine_chunks() if name in table.column_names else pa.nulls(table.num_rows, pa.list_(pa.float64()))
        dims = max([0, *column.value_lengths().drop_null().to_pylist()])
        sides[name] = blocks.vectors(column, dims)
    profile, has_profile = sides["profile"]
    found = Cohort(table.column("user_id").to_numpy(), _unit(profile), has_profile, *sides["user_factor"])
    places_of = table.column("place").to_numpy()
    if not np.array_equal(places_of, np.arange(len(chosen))):  # users without a profile are left out
        by_place = np.full(len(chosen), -1)
        by_place[places_of] = np.arange(len(places_of))
        now = F.udf(lambda xs: None if xs is None else [int(by_place[x]) for x in xs if by_place[x] >= 0], "array<long>")
        read = wanted.withColumn("rated", now("rated"))
    else:
        read = wanted
    best = store.kept(ranked(read, found, rankers))
    store.drop(ids, wanted)
    return metrics(best, relevant, users)


def result_document(measured: DataFrame, mode: str, n_candidates: int, revision: str | None = None) -> dict:
    """The result of an evaluation as gate and readers expect it; an empty cohort is an error. measured: some rows for each ranker."""
    rows = measured.collect()
    if not rows:
        raise ValueError("no user has both a train rating and a liked test rating")
    rankers: dict[str, dict[str, float]] = {}
    for r in sorted(rows, key=lambda r: (r.ranker, r.k)):
        rankers.setdefault(r.ranker, {}).update({f"precision@{r.k}": r.precision, f"recall@{r.k}": r.recall})
    return {
        "schema_version": 1, "generated_at": datetime.now(timezone.utc).isoformat(), "revision": revision, "mode": mode, "sample_fraction": config.SAMPLE_FRACTION if mode == "sample" else None,
        "holdout_fraction": config.HOLDOUT, "positive_threshold": config.LIKED, "k_values": list(config.CUTOFFS), "hybrid_weights": config.WEIGHTS, "n_candidates": n_candidates,
        "n_users_evaluated": rows[0].users, "rankers": rankers,
    }
