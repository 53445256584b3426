"""Session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lakewright", **conf: str) -> SparkSession:
    """A session for local use; on a cluster the caller brings its own."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
