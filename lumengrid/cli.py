"""The steps of the catalog on the command line: each writes a table and a marker, and needs those before it.

    python -m lumengrid.cli ingest --data DIR --work DIR [--sample]      then cf, hydrate, embed, index, eval, eval-gate
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid import config
from lumengrid.functions import text
from lumengrid.operators import als, gate, steps
from lumengrid.plans import catalog, evaluate
from lumengrid.session import session
from lumengrid.sources import files, sampling, store, tables

#: A step's settings, which its marker holds a fingerprint of, and the steps before it.
SETTINGS = {
    "ingest": {"share": config.SAMPLE_FRACTION, "seed": config.SEED}, "cf": {"rank": config.ALS_RANK, "iterations": config.ALS_ITERATIONS, "reg": config.ALS_REG, "prior": config.PRIOR_RATINGS},
    "hydrate": {"tags": config.TAGS_PER_ITEM, "relevance": config.TAG_RELEVANCE}, "embed": {"dims": config.TEXT_DIMS, "rows": config.SHARD_ROWS}, "index": {},
}
NEEDS = {"ingest": (), "cf": ("ingest",), "hydrate": ("ingest",), "embed": ("hydrate",), "index": ("cf", "hydrate", "embed"), "eval": ("ingest", "index")}
#: Tables that ingest reads, their keys for sampling, and how it writes them.
RAW = {"ratings": ("user_id", "item_id"), "movies": ("item_id",), "links": ("item_id",), "genome_scores": ("item_id", "tag_id"), "genome_tags": ("tag_id",)}


class Steps:
    """One work folder: tables of each mode, markers, the published catalog and results."""

    def __init__(self, spark: SparkSession, data: str, work: str, sample: bool) -> None:
        self.spark, self.data, self.sample = spark, data, sample
        self.root = f"{work}/{'sample' if sample else 'full'}"
        self.markers, self.results, self.baseline = Path(self.root) / "_done", Path(work) / "results", Path(work) / "baseline.json"

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")

    def write(self, step: str, **written: DataFrame) -> None:
        rows = {name: steps.write_step(df, f"{self.root}/{name}", self.markers / "tables", name)["rows"] for name, df in written.items()}
        steps.write_marker(self.markers, step, sum(rows.values()), config=steps.fingerprint(SETTINGS[step]), tables=rows)

    def run(self, step: str) -> None:
        """A step is left out if it was written with the same settings, and fails if one that it needs was not."""
        steps.require(self.markers, *NEEDS[step])
        if step not in SETTINGS or not steps.up_to_date(self.markers, step, SETTINGS[step]):
            getattr(self, step)()

    def ingest(self, only: Sequence[str] = ()) -> None:
        if unknown := set(only) - set(RAW):
            raise ValueError(f"unknown tables: {', '.join(sorted(unknown))}")
        chosen = {t: keys for t, keys in RAW.items() if not only or t in only}
        self.write("ingest", **{t: sampling.sampled(getattr(tables, t)(self.spark, self.data), t, self.sample, *keys) for t, keys in chosen.items()})

    def cf(self) -> None:
        ratings = self.read("ratings")
        model = als.fit(ratings)
        self.write("cf", stats=catalog.bayes_stats(ratings), item_factors=als.item_factors(model), user_factors=als.user_factors(model))

    def hydrate(self) -> None:
        movies = self.read("movies")
        targets = catalog.linked_targets(self.read("links"), movies)
        self.write("hydrate", hydrated=catalog.metadata_from_titles(targets, movies, catalog.top_tags(self.read("genome_scores"), self.read("genome_tags"))))

    def embed(self, encoder: als.Encoder | None = None) -> None:
        told = text.described(*(F.col(c) for c in ("title", "release_year", "overview", "genres", "keywords")))
        vectors = als.encoded(self.read("hydrated").select("item_id", told.alias("text")), config.TEXT_DIMS, encoder)
        shards = files.write_shards(vectors, f"{self.root}/embeddings", config.SHARD_ROWS)
        steps.write_marker(self.markers, "embed", self.read("embeddings").count(), config=steps.fingerprint(SETTINGS["embed"]), shards=shards)

    def index(self) -> None:
        items = self.read("hydrated").join(self.read("embeddings").drop("shard"), "item_id")
        items = items.join(self.read("item_factors").withColumnRenamed("features", "factor"), "item_id", "left").join(self.read("stats"), "item_id", "left")
        store.publish(items, f"{self.root}/catalog")
        store.clean(self.spark, f"{self.root}/catalog")
        steps.write_marker(self.markers, "index", store.published(self.spark, f"{self.root}/catalog").count(), config=steps.fingerprint(SETTINGS["index"]))

    def eval(self) -> None:
        items = store.published(self.spark, f"{self.root}/catalog")
        measured = evaluate.evaluate_trained(self.read("ratings"), items)
        result = evaluate.result_document(measured, "sample" if self.sample else "full", items.count())
        print(gate.write_result(result, self.results))

    def gate(self, promote: bool) -> int:
        if not promote:
            return gate.run_gate(self.results, self.baseline)
        gate.promote(gate.newest(gate.read_results(self.results)), self.baseline, "promoted on the command line")
        return 0


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lumengrid")
    sub = parser.add_subparsers(dest="step", required=True)
    for step in (*NEEDS, "eval-gate"):
        p = sub.add_parser(step)
        p.add_argument("--work", required=True)
        p.add_argument("--sample", action="store_true")
        if step == "ingest":
            p.add_argument("--data", required=True)
            p.add_argument("--tables", nargs="*", default=[])
        if step == "eval-gate":
            p.add_argument("--update-baseline", action="store_true")
    return parser


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    if args.step == "eval-gate":  # needs no session
        return Steps(None, "", args.work, args.sample).gate(args.update_baseline)
    work = Steps(spark or session(), getattr(args, "data", ""), args.work, args.sample)
    if args.step == "ingest" and args.tables:
        work.ingest(args.tables)
    else:
        work.run(args.step)
    return 0


if __name__ == "__main__":
    sys.exit(main())
