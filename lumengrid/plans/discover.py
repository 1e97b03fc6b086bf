"""Interactive ranking: references, filtered candidates, hybrid score with its reasons, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumengrid import config
from lumengrid.functions import scoring
from lumengrid.operators import parser


def references(catalog: DataFrame, titles: list[str]) -> DataFrame:
    """asked (place in the list), item_id and factor: each title's best match; exact ones first, then by ratings, then by item_id."""
    tests = [F.when(F.instr(F.lower("title"), t.lower()) > 0, F.struct(F.lit(k).alias("asked"), (F.lower("title") == t.lower()).alias("exact"))) for k, t in enumerate(titles)]
    if not tests:
        return catalog.select(F.lit(0).alias("asked"), "item_id", "title", "factor").limit(0)
    hits = catalog.select("item_id", "title", "rating_count", "factor", F.explode(F.array_compact(F.array(*tests))).alias("m"))
    w = Window.partitionBy("m.asked").orderBy(F.desc("m.exact"), F.desc_nulls_last("rating_count"), "item_id")
    return hits.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("m.asked", "item_id", "title", "factor")


def pool(catalog: DataFrame, query: Column, spec: parser.Spec, refs: DataFrame | None = None, size: int = config.POOL) -> DataFrame:
    """The nearest candidates that pass the filters, with semantic; what the request refers to is no candidate."""
    rest = catalog.where(parser.predicate(spec))
    if refs is not None:
        rest = rest.join(F.broadcast(refs.select("item_id").distinct()), "item_id", "left_anti")  # a row for each title asked for, at most
    near = rest.withColumn("semantic", F.round(scoring.cosine(F.col("embedding"), query), 9))
    return near.orderBy(F.desc("semantic"), "item_id").limit(size)


def behavioral(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """candidates with behavioral (the mean cosine to the factors of the references, null without factor) and fans_of: the titles that have one.

    The references are a few rows. Without any factor among them fans_of is empty, which tells that the signal is absent as a whole.
    """
    with_factor = refs.where("factor is not null")
    known = with_factor.agg(F.array_sort(F.collect_list(F.struct("asked", "title", "factor"))).alias("given"))
    mean = F.aggregate(F.transform("given", lambda r: scoring.cosine(F.col("factor"), r["factor"])), F.lit(0.0), lambda s, x: s + x) / F.size("given")
    found = candidates.crossJoin(F.broadcast(known)).withColumn("behavioral", F.when(F.size("given") > 0, mean))
    return found.withColumn("fans_of", F.col("given").getField("title")).drop("given")


def hybrid(candidates: DataFrame, limit: int = config.PAGE) -> DataFrame:
    """The page: rank, the item's summary, score, and why: the signals (four decimals) and fans_of. Candidates are POOL rows at most.

    Where fans_of says that no reference has a factor, the weight of that signal goes to the others.
    """
    one = Window.partitionBy(F.lit(1))
    signals = {"semantic": F.col("semantic"), "behavioral": F.col("behavioral"), "quality": F.col("bayes_score")}
    without = {name: x for name, x in signals.items() if name != "behavioral"}
    score = F.when(F.size("fans_of") > 0, scoring.blend(signals, config.WEIGHTS, one)).otherwise(scoring.blend(without, config.WEIGHTS, one))
    best = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), F.desc("semantic"), "item_id")
    shown = [scoring.shown(F.col(c)).alias(c) for c in ("semantic", "behavioral", "bayes_score")]
    summary = [c for c in ("release_year", "genres", "vote_average", "rating_count") if c in candidates.columns]
    ranked = candidates.withColumn("score", F.coalesce(F.round(score, 6), F.lit(0.0))).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= limit)
    fans = F.when(F.col("behavioral").isNotNull(), F.col("fans_of")).otherwise(F.array().cast("array<string>")).alias("fans_of")
    return ranked.select("rank", "item_id", "title", *summary, "score", *shown, fans)


def neighbours(catalog: DataFrame, anchor: int, vector: str, k: int = config.NEIGHBOURS) -> DataFrame:
    """The k items nearest to the anchor's vector, without itself; none if it has no vector."""
    own = catalog.where((F.col("item_id") == anchor) & F.col(vector).isNotNull()).select(F.col(vector).alias("anchor_vector"))
    near = catalog.where((F.col("item_id") != anchor) & F.col(vector).isNotNull()).crossJoin(F.broadcast(own))
    near = near.withColumn("similarity", F.round(scoring.cosine(F.col(vector), F.col("anchor_vector")), 6))
    return near.orderBy(F.desc("similarity"), "item_id").limit(k).select("item_id", "title", "similarity")
