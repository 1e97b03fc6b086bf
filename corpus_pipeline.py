"""Raw documents to packed training sequences, in stages that each keep, cut or arrange documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, with text and n_chars of what
is left. Rows keep their doc_id throughout.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.llm import kneserney, minhash, packing, secrets, suffixarray
from lumengrid.llm.common import BROADCAST_ROWS, lean, prepare, remove, settle, shared_dir, with_spans
from lumengrid.llm.queries import WORD_BPE

#: Bytes of a repeated string that goes: fewer than 50 words have, in the languages at hand, so that shared passages of that size go too.
PASSAGE = 240
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _chosen(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Documents that are kept; the ids of the others are broadcast if they are few, and joined by a shuffle if many."""
    gone = decided.where("not kept").select("doc_id")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def _rewritten(docs: DataFrame, change: Callable[[str, list | None], str], spans: bool = False) -> DataFrame:
    """Documents with another text and its n_chars; documents whose text becomes blank are left out, unless it was so before."""
    fields = [*COLUMNS, *["spans"] * spans]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(1).to_pylist()
            how = batch.column(5).to_pylist() if spans else [None] * len(old)
            new = [None if x is None else change(x, y) for x, y in zip(old, how, strict=True)]
            keep = pa.array([a is None or a == b or bool(b.strip()) for a, b in zip(old, new, strict=True)], pa.bool_())
            sizes = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, batch.column(4).to_pylist(), strict=True)], batch.column(4).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), batch.column(2), batch.column(3), sizes], names=list(COLUMNS)).filter(keep)

    return docs.select(*fields).mapInArrow(lean(run), ", ".join(f"{c} {kinds[c]}" for c in COLUMNS))


def _begin(spark: SparkSession) -> None:
    prepare(spark)
    settle(spark)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney model of trusted text finds too improbable go."""
    _begin(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _chosen(docs, kneserney.classify(docs, labels))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates stays."""
    _begin(spark)
    kept = _chosen(docs, minhash.near_duplicates(docs))
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():  # repeated rows
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
    return kept


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes or more that occur twice go; a character that a cut goes through goes as a whole."""
    _begin(spark)

    def change(text: str, spans: list | None) -> str:
        if not spans:
            return text
        return suffixarray.cut(text.encode(), [(s["lo"], s["hi"]) for s in spans])[0].decode(errors="ignore")

    return _rewritten(with_spans(docs.select(*COLUMNS), suffixarray.removed_spans(docs, PASSAGE)), change, spans=True)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    _begin(spark)
    return _rewritten(docs, lambda text, _: secrets.redact(text))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    _begin(spark)
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), with_ids=True)


STAGES = [("quality", classify), ("near-duplicates", near), ("substrings", substrings), ("secrets", redact), ("packing", pack)]
#: Similarity joins, suffix arrays and tokenizers are beyond SQL on whole tables; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to shared storage and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if stage is not pack:
            now = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            out.write.parquet(now)
            docs = spark.read.parquet(now)
        if path:  # what the next stage has read; packing keeps its tokens in a table of its own
            remove(spark, path)
        path = now
    return out
