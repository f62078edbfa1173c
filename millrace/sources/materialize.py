"""Ways to keep a table: replaced, as a view, in files, upserted, or cached; and a registry of stores."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.joins import upsert


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@dataclass
class Store:
    """Tables as Parquet under a base path, by asset name.  A new state is written beside the old one and
    a pointer is renamed into place last, so readers never see half a table or none, and a table can be
    read while its next state is computed from it.  The state before the current one stays for plans that still
    read it; older ones are removed."""

    spark: SparkSession
    base: str

    def _versions(self, name: str) -> list[str]:
        """Versions that pointers name, oldest first: a pointer is an empty file ``CURRENT-<number>-<version>``."""
        p, fs = _fs(self.spark, f"{self.base}/{name}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if n.startswith("CURRENT-"))

    def path(self, name: str) -> str | None:
        found = self._versions(name)
        return f"{self.base}/{name}/{found[-1].split('-', 2)[2]}" if found else None

    def exists(self, name: str) -> bool:
        return self.path(name) is not None

    def load(self, name: str) -> DataFrame:
        path = self.path(name)
        if path is None:
            raise KeyError(name)
        return self.spark.read.parquet(path)

    def replace(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        version, before = f"v-{uuid.uuid4().hex}", self._versions(name)
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.base}/{name}/{version}")
        number = int(before[-1].split("-")[1]) + 1 if before else 0
        p, fs = _fs(self.spark, f"{self.base}/{name}/CURRENT-{number:012d}-{version}")
        fs.create(p, False).close()  # its name says all, so it is there whole or not at all
        for pointer in before[:-1]:
            for gone in (pointer, pointer.split("-", 2)[2]):
                q, fs = _fs(self.spark, f"{self.base}/{name}/{gone}")
                fs.delete(q, True)
        return self.load(name)

    def remove(self, name: str) -> None:
        """Removes a table with all its versions."""
        p, fs = _fs(self.spark, f"{self.base}/{name}")
        fs.delete(p, True)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        path = self.path(name)
        if path is None:
            return self.replace(name, df)
        df.write.mode("append").parquet(path)
        return self.load(name)

    def upsert(self, name: str, new: DataFrame, key: str, order_by: str | None = None) -> DataFrame:
        """The last new row of a key beats the old one; see ``operators.joins.upsert``."""
        if not self.exists(name):
            return self.replace(name, upsert(new.limit(0), new, key, order_by))
        return self.replace(name, upsert(self.load(name), new, key, order_by))


def as_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def as_table(df: DataFrame, name: str, buckets: int | None = None, bucket_by: str | None = None) -> DataFrame:
    """Replaces a catalog table; bucketed on a key, later joins on it need no shuffle."""
    writer = df.write.mode("overwrite")
    if buckets and bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def in_memory(df: DataFrame) -> DataFrame:
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)


@dataclass
class Registry:
    stores: dict[str, Store] = field(default_factory=dict)

    def register(self, name: str, store: Store) -> None:
        self.stores[name] = store

    def get(self, name: str) -> Store:
        return self.stores[name]
