"""Spark sessions with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC timestamps, errors instead of silent nulls, and the last of repeated map keys.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "sextant", master: str | None = None, **settings: str) -> SparkSession:
    """A session; keyword names have ``__`` for the dots of a setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
