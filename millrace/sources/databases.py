"""Databases over JDBC, incremental loads by a high-watermark, and a query builder."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Drivers and URL forms.
DRIVERS = {
    "postgresql": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 5432),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 3306),
    "snowflake": ("net.snowflake.client.jdbc.SnowflakeDriver", "jdbc:snowflake://{host}/?db={database}", 443),
    "bigquery": ("com.simba.googlebigquery.jdbc.Driver", "jdbc:bigquery://{host}:{port};ProjectId={database}", 443),
}


@dataclass(frozen=True)
class Connection:
    dialect: str
    host: str
    database: str
    user: str = ""
    password: str = field(default="", repr=False)
    port: int | None = None
    options: dict[str, str] = field(default_factory=dict)

    def jdbc(self) -> dict[str, str]:
        driver, url, port = DRIVERS[self.dialect]
        return {"driver": driver, "url": url.format(host=self.host, port=self.port or port, database=self.database), "user": self.user, "password": self.password, **self.options}


def _text(value: Any) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def incremental_query(table: str, watermark_column: str | None = None, watermark: Any = None, query: str | None = None) -> str:
    """The load as a query: all, or rows strictly above the watermark."""
    base = query or f"SELECT * FROM {table}"
    if watermark_column is None or watermark is None:
        return base
    return f"SELECT * FROM ({base}) AS src WHERE {watermark_column} > {_text(watermark)}"


def read_table(spark: SparkSession, connection: Connection, table: str = "", query: str | None = None, watermark_column: str | None = None, watermark: Any = None, partition_column: str | None = None, bounds: tuple[Any, Any] | None = None, partitions: int = 8) -> DataFrame:
    """Reads over JDBC; with a partition column and bounds, by as many tasks as there are partitions."""
    reader = spark.read.format("jdbc").options(**connection.jdbc()).option("dbtable", f"({incremental_query(table, watermark_column, watermark, query)}) AS q").option("fetchsize", 10_000)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def write_table(df: DataFrame, connection: Connection, table: str, mode: str = "append", batch: int = 1000, partitions: int | None = None) -> None:
    (df.coalesce(partitions) if partitions else df).write.format("jdbc").options(**connection.jdbc()).option("dbtable", table).option("batchsize", batch).mode(mode).save()


class WatermarkStore:
    """Watermarks by name, in a JSON file under a path that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _file(self, name: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{re.sub(r'[^A-Za-z0-9_.-]', '_', name)}.json")
        return p, p.getFileSystem(conf)

    def get(self, name: str) -> Any:
        p, fs = self._file(name)
        if not fs.exists(p):
            return None
        return json.loads(self.spark.read.option("wholetext", True).text(p.toString()).first()["value"])["value"]

    def put(self, name: str, value: Any) -> None:
        p, fs = self._file(name)
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps({"value": value}, default=str).encode()))
        finally:
            out.close()


def above_watermark(df: DataFrame, column: str, watermark: Any) -> DataFrame:
    return df if watermark is None else df.filter(F.col(column) > F.lit(watermark))


def next_watermark(df: DataFrame, column: str) -> Any:
    return df.agg(F.max(column)).first()[0]


@dataclass
class QueryBuilder:
    """SELECT, INSERT, UPDATE and DELETE text with named parameters, for ``spark.sql(text, args)``."""

    table: str
    _select: list[str] = field(default_factory=list)
    _where: list[str] = field(default_factory=list)
    _joins: list[str] = field(default_factory=list)
    _group: list[str] = field(default_factory=list)
    _having: list[str] = field(default_factory=list)
    _order: list[str] = field(default_factory=list)
    _limit: int | None = None
    _offset: int | None = None
    _distinct: bool = False
    _hints: list[str] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)

    def select(self, *columns: str) -> QueryBuilder:
        self._select += columns
        return self

    def distinct(self) -> QueryBuilder:
        self._distinct = True
        return self

    def where(self, condition: str, **params: Any) -> QueryBuilder:
        self._where.append(condition)
        self.params |= params
        return self

    def join(self, table: str, on: str, kind: str = "INNER") -> QueryBuilder:
        self._joins.append(f"{kind} JOIN {table} ON {on}")
        return self

    def group_by(self, *columns: str) -> QueryBuilder:
        self._group += columns
        return self

    def having(self, condition: str) -> QueryBuilder:
        self._having.append(condition)
        return self

    def order_by(self, *columns: str) -> QueryBuilder:
        self._order += columns
        return self

    def limit(self, n: int) -> QueryBuilder:
        self._limit = n
        return self

    def offset(self, n: int) -> QueryBuilder:
        self._offset = n
        return self

    def hint(self, name: str, *tables: str) -> QueryBuilder:
        """BROADCAST, MERGE, SHUFFLE_HASH, SHUFFLE_REPLICATE_NL, COALESCE, REPARTITION, REBALANCE."""
        self._hints.append(f"{name}({', '.join(tables)})")
        return self

    def build(self) -> str:
        parts = ["SELECT"]
        if self._hints:
            parts.append(f"/*+ {', '.join(self._hints)} */")
        if self._distinct:
            parts.append("DISTINCT")
        parts += [", ".join(self._select) or "*", "FROM", self.table, *self._joins]
        for word, items, glue in (("WHERE", [f"({w})" for w in self._where], " AND "), ("GROUP BY", self._group, ", "), ("HAVING", self._having, " AND "), ("ORDER BY", self._order, ", ")):
            if items:
                parts += [word, glue.join(items)]
        if self._limit is not None:
            parts.append(f"LIMIT {self._limit}")
        if self._offset is not None:
            parts.append(f"OFFSET {self._offset}")
        return " ".join(parts)

    def insert(self, rows: list[dict[str, Any]]) -> tuple[str, dict[str, Any]]:
        """All rows in one statement."""
        columns = list(rows[0])
        params = {f"{c}_{i}": r[c] for i, r in enumerate(rows) for c in columns}
        values = ", ".join(f"({', '.join(f':{c}_{i}' for c in columns)})" for i in range(len(rows)))
        return f"INSERT INTO {self.table} ({', '.join(columns)}) VALUES {values}", params

    def _condition(self) -> str:
        if not self._where:
            raise ValueError("a statement that changes rows needs a condition; say TRUE for all")
        return " AND ".join(f"({w})" for w in self._where)

    def update(self, values: dict[str, Any]) -> tuple[str, dict[str, Any]]:
        text = f"UPDATE {self.table} SET {', '.join(f'{c} = :set_{c}' for c in values)} WHERE {self._condition()}"
        return text, {f"set_{c}": v for c, v in values.items()} | self.params

    def delete(self) -> tuple[str, dict[str, Any]]:
        return f"DELETE FROM {self.table} WHERE {self._condition()}", dict(self.params)

    def run(self, spark: SparkSession) -> DataFrame:
        return spark.sql(self.build(), args=self.params or None)
