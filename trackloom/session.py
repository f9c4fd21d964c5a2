"""A Spark session with the settings that the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "trackloom", master: str | None = None, **settings: str) -> SparkSession:
    """The running session, or a new one: UTC, adaptive plans with skewed joins split, Arrow for what leaves the JVM."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | settings
    for key, value in wanted.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
