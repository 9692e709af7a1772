"""A session with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def create(app: str = "logweave", **conf: str) -> SparkSession:
    """UTC times, adaptive execution with skew handling, Arrow for Python exchanges; ``conf`` adds to these."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
