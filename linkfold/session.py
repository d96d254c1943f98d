"""The Spark session that the library is tested with; any session with the same SQL settings will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "linkfold", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; sizes of shuffles and scans are left to the cluster's defaults."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
