"""The session that the library's plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lynxmark", **conf: str) -> SparkSession:
    """UTC, ANSI casts, adaptive execution with skew joins; anything else by ``conf``."""
    builder = SparkSession.builder.appName(name)
    fixed = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for k, v in (fixed | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
