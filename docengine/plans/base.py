"""Registration of queries that are written as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..catalog import register

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register Spark SQL in which ``{table}`` stands for a table; the oracle is the same text unless given."""
    used = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: read(spark, sf_dir, t) for t in used})

    register(name, run, re.sub(r"\{(\w+)\}", r"\1", oracle or text))
