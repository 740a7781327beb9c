"""A session with the settings that the engine expects; an existing one is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "docengine", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
