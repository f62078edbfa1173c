"""What a source and a sink are, and these for files, stores and databases."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources import files
from millrace.sources.connections import Database
from millrace.sources.materialize import Store


@runtime_checkable
class Source(Protocol):
    def load(self, spark: SparkSession) -> DataFrame: ...


@runtime_checkable
class Sink(Protocol):
    def save(self, df: DataFrame) -> files.SinkResult: ...


@dataclass
class Files:
    """Files of any known format, as a source and a sink."""

    path: str
    format: str | None = None
    options: dict[str, Any] = field(default_factory=dict)

    def load(self, spark: SparkSession) -> DataFrame:
        return files.read_file(spark, self.path, self.format, **self.options)

    def save(self, df: DataFrame) -> files.SinkResult:
        return files.write_file(df, self.path, self.format, **self.options)


@dataclass
class Stored:
    """A table of a store; saved whole, or upserted by a key."""

    store: Store
    name: str
    key: str | None = None
    order_by: str | None = None

    def load(self, spark: SparkSession) -> DataFrame:
        return self.store.load(self.name)

    def save(self, df: DataFrame) -> files.SinkResult:
        self.store.upsert(self.name, df, self.key, self.order_by) if self.key else self.store.replace(self.name, df)
        return files.SinkResult(True, df.count(), None, {"table": self.name})


@dataclass
class Table:
    """A table of a database."""

    database: Database
    name: str
    schema: str = ""
    keys: list[str] = field(default_factory=list)
    mode: str = "append"

    def load(self, spark: SparkSession) -> DataFrame:
        return self.database.read(spark, f"SELECT * FROM {self.name}", self.schema)

    def save(self, df: DataFrame) -> files.SinkResult:
        return self.database.write(df, self.name, self.keys, self.mode)
