"""A session with the settings that results and plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lumengrid", **conf: str) -> SparkSession:
    """UTC and adaptive execution; any other setting by keyword, with _ for the dots of its name."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
