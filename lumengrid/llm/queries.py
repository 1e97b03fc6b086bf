"""Queries of the text operators with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumengrid.llm import bpe, extract, fingerprints, kneserney, media, minhash, packing, rules, secrets, suffixarray
from lumengrid.llm.common import documents, prepare

BYTE_RANKS, WORD_BPE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.with_media(documents(spark, sf_dir)))


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(prepare(spark).read.parquet(f"{sf_dir}/pages.parquet"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op4_suffixarray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixarray.deduplicate(documents(spark, sf_dir)).drop("kept")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.deduplicate(documents(spark, sf_dir)).drop("kept")


def op8_kneserney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_extract": op2_extract,
    "op3_secrets": op3_secrets,
    "op4_suffixarray": op4_suffixarray,
    "op5_minhash": op5_minhash,
    "op6_packing": op6_packing,
    "op7_fingerprints": op7_fingerprints,
    "op8_kneserney": op8_kneserney,
    "op9_rules": op9_rules,
    "op10_bpe": op10_bpe,
}
#: None of these can be said in SQL that stays usable on whole tables; tests/llm holds brute-force versions.
ORACLES: dict[str, str] = {}
