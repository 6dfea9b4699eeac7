"""Session settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "spectraloom", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC times and the Python data sources registered."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    from .sources import register

    register(spark)
    return spark
