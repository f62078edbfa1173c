"""The registry of queries over the test tables, and of the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import read_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return wrap


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_file(spark, f"{sf_dir}/{name}.parquet", "parquet")


def rounded(name: str, digits: int = 4):
    return F.round(name, digits).alias(name)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``; a local master may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/millrace-queries/{what}-{uuid.uuid4().hex}"
