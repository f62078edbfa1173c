"""Databases behind a DB-API connection: statements, transactions, and loads from and to tables.

A connection is made by a function that workers can run, as tables are written by their partitions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.schema import create_table, upsert_sql
from millrace.sources.files import SinkResult

_NAMED = re.compile(r"(?<!:):([A-Za-z_][A-Za-z0-9_]*)")


@dataclass
class Database:
    """``connect`` makes a DB-API connection; ``style`` is its module's paramstyle: named (``:a``) or
    pyformat (``%(a)s``).  Statements are written with ``:a``."""

    connect: Callable[[], Any]
    dialect: str = "postgresql"
    style: str = "named"

    def _text(self, statement: str) -> str:
        return statement if self.style == "named" else _NAMED.sub(r"%(\1)s", statement)

    @contextmanager
    def transaction(self) -> Iterator[Any]:
        """A cursor whose statements count together or not at all."""
        link = self.connect()
        try:
            cursor = link.cursor()
            yield cursor
            link.commit()
        except BaseException:
            link.rollback()
            raise
        finally:
            link.close()

    def execute(self, statement: str, params: dict[str, Any] | None = None) -> int:
        """Rows that a statement has changed."""
        with self.transaction() as c:
            c.execute(self._text(statement), params or {})
            return c.rowcount

    def execute_many(self, statement: str, rows: list[dict[str, Any]]) -> int:
        with self.transaction() as c:
            c.executemany(self._text(statement), rows)
        return len(rows)

    def query(self, statement: str, params: dict[str, Any] | None = None) -> list[dict[str, Any]]:
        """A result that the driver can hold; for large ones, ``databases.read_table``."""
        with self.transaction() as c:
            c.execute(self._text(statement), params or {})
            names = [d[0] for d in c.description]
            return [dict(zip(names, r, strict=True)) for r in c.fetchall()]

    def test(self) -> bool:
        try:
            return self.query("SELECT 1 AS one")[0]["one"] == 1
        except Exception:
            return False

    def table_exists(self, table: str) -> bool:
        try:
            self.query(f"SELECT * FROM {table} WHERE 1 = 0")
        except Exception:
            return False
        return True

    def columns(self, table: str) -> list[str]:
        with self.transaction() as c:
            c.execute(f"SELECT * FROM {table} WHERE 1 = 0")
            return [d[0] for d in c.description]

    def read(self, spark: SparkSession, statement: str, schema: T.StructType | str, params: dict[str, Any] | None = None) -> DataFrame:
        rows = self.query(statement, params)
        names = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).names
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

    def create(self, table: str, schema: T.StructType, keys: list[str] = ()) -> None:
        self.execute(create_table(table, schema, self.dialect, list(keys)))

    def write(self, df: DataFrame, table: str, keys: list[str] | None = None, mode: str = "append", batch: int = 1000, partitions: int = 8) -> SinkResult:
        """Writes a table by its partitions, creating it if it isn't there.

        With ``keys`` rows are upserted, so a partition that is written again changes nothing; without, a task that
        is run again may add rows twice.  Rows of one key go to one partition.  ``mode``: append, overwrite
        (rows are deleted first) or fail_if_exists.
        """
        keys = list(keys or [])
        if mode == "fail_if_exists" and self.table_exists(table):
            return SinkResult(False, 0, f"{table} is there")
        try:
            self.create(table, df.schema, keys)
            if mode == "overwrite":
                self.execute(f"DELETE FROM {table}")
            names = df.columns
            statement = upsert_sql(table, names, keys, self.dialect) if keys else f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join(f':{c}' for c in names)})"
            done = df.sparkSession.sparkContext.accumulator(0)

            def load(rows: Iterator[Any]) -> None:
                held: list[dict] = []
                with self.transaction() as c:
                    for r in rows:
                        held.append(r.asDict())
                        if len(held) == batch:
                            c.executemany(self._text(statement), held)
                            done.add(len(held))
                            held = []
                    if held:
                        c.executemany(self._text(statement), held)
                        done.add(len(held))

            (df.repartition(partitions, *keys) if keys else df.coalesce(partitions)).foreachPartition(load)
        except Exception as e:
            return SinkResult(False, 0, str(e).split("\n")[0])
        return SinkResult(True, done.value, None, {"table": table})
