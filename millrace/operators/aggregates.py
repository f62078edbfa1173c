"""Grouped, rolled-up and cubed aggregation.  Spark sums up within partitions first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    """An aggregate of a column; named ``<column>_<function>`` unless it has an alias."""

    column: str
    alias: str | None = None
    function = ""

    def value(self) -> Column:
        raise NotImplementedError

    def named(self) -> Column:
        return self.value().alias(self.alias or f"{self.column}_{self.function}")


class Sum(Aggregate):
    """Sum; 0 where all are null."""

    function = "sum"

    def value(self) -> Column:
        return F.coalesce(F.sum(self.column), F.lit(0))


class Count(Aggregate):
    """Number of values that aren't null; of rows for ``*``."""

    function = "count"

    def value(self) -> Column:
        return F.count(self.column)


class Avg(Aggregate):
    function = "avg"

    def value(self) -> Column:
        return F.avg(self.column)


class Min(Aggregate):
    function = "min"

    def value(self) -> Column:
        return F.min(self.column)


class Max(Aggregate):
    function = "max"

    def value(self) -> Column:
        return F.max(self.column)


class CountDistinct(Aggregate):
    function = "count_distinct"

    def value(self) -> Column:
        return F.count_distinct(self.column)


def _checked(df: DataFrame, keys: str | list[str], aggregates: list[Aggregate]) -> list[str]:
    names = [keys] if isinstance(keys, str) else list(keys)
    missing = [c for c in names + [a.column for a in aggregates if a.column != "*"] if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    return names


def group_by(df: DataFrame, keys: str | list[str], aggregates: list[Aggregate], keep_null_keys: bool = False) -> DataFrame:
    """One row a group; groups with a null key are left out unless they are to be kept."""
    names = _checked(df, keys, aggregates)
    return (df if keep_null_keys else df.dropna(subset=names)).groupBy(*names).agg(*(a.named() for a in aggregates))


def rollup(df: DataFrame, keys: str | list[str], aggregates: list[Aggregate], grouping_id: bool = False) -> DataFrame:
    """Groups, and their subtotals for each shorter list of keys; ``grouping_id`` tells a total from a null."""
    names = _checked(df, keys, aggregates)
    return df.rollup(*names).agg(*(a.named() for a in aggregates), *([F.grouping_id().alias("grouping_id")] if grouping_id else []))


def cube(df: DataFrame, keys: str | list[str], aggregates: list[Aggregate], grouping_id: bool = False) -> DataFrame:
    """Groups and subtotals for every choice of keys."""
    names = _checked(df, keys, aggregates)
    return df.cube(*names).agg(*(a.named() for a in aggregates), *([F.grouping_id().alias("grouping_id")] if grouping_id else []))


def aggregate_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def aggregate_sum(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(column), F.lit(0)).alias("sum"))


def by_period(df: DataFrame, timestamp: str, period: str, aggregates: list[Aggregate]) -> DataFrame:
    """Aggregates by day, week, month or any other unit of ``date_trunc``."""
    return df.groupBy(F.date_trunc(period, F.col(timestamp)).alias("period")).agg(*(a.named() for a in aggregates))


def value_counts(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """The most frequent values; ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "value").limit(top_n)
