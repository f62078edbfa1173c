"""Structured Streaming forms of the batch operators: an extension, as batches are all that pipelines of
this kind usually have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.materialize import Store


def read_stream(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(format).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def windowed(df: DataFrame, timestamp: str, size: str, keys: list[str], aggregates: dict[str, Column], slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding windows; rows later than ``late`` may be dropped, and state is kept no longer."""
    source = df.withWatermark(timestamp, late) if df.isStreaming else df
    w = F.window(timestamp, size, slide) if slide else F.window(timestamp, size)
    out = source.groupBy(w.alias("w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def sessions(df: DataFrame, timestamp: str, gap: str, keys: list[str], aggregates: dict[str, Column], late: str = "1 hour") -> DataFrame:
    source = df.withWatermark(timestamp, late) if df.isStreaming else df
    out = source.groupBy(F.session_window(timestamp, gap).alias("w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggregates)


def deduplicated(df: DataFrame, keys: list[str], timestamp: str, late: str = "1 hour") -> DataFrame:
    if not df.isStreaming:
        return df.dropDuplicates(keys)
    return df.withWatermark(timestamp, late).dropDuplicatesWithinWatermark(keys)


def upsert_stream(df: DataFrame, store: Store, name: str, key: str, order_by: str, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch into a stored table; a repeated batch gives the same table."""

    def one(batch: DataFrame, _: int) -> None:
        store.upsert(name, batch, key, order_by)

    return df.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def each_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
