"""A session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "strataline", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow for Python functions. ``settings`` override."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=conf | settings).getOrCreate()
