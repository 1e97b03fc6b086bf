"""Sample mode: facts are sampled, dimensions are kept whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid import config

# Which tables are facts and which are dimensions.
FACTS = ("ratings", "tags", "genome_scores", "export")
DIMENSIONS = ("movies", "links", "genome_tags")
PARTS = 1_000_000


def share(table: str, sample: bool) -> float | None:
    """The share of a table's rows that a mode keeps; None for all."""
    if table not in FACTS + DIMENSIONS:
        raise ValueError(f"unknown table {table}")
    return config.SAMPLE_FRACTION if sample and table in FACTS else None


def chosen(fraction: float, *keys: str) -> Column:
    """Whether a row is in the sample, by a hash of its keys and the seed: independent of files, partitions and order."""
    digest = F.md5(F.concat_ws("|", F.lit(str(config.SEED)), *(F.col(k).cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % PARTS < round(fraction * PARTS)


def sampled(df: DataFrame, table: str, sample: bool, *keys: str) -> DataFrame:
    """The table as a mode reads it."""
    fraction = share(table, sample)
    return df if fraction is None else df.where(chosen(fraction, *keys))
