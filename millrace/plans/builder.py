"""A fluent chain over a DataFrame.  Each step only adds to the logical plan."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame

from millrace.operators import aggregates, cleaning, joins, reshape, rows, windows


class Chain:
    def __init__(self, df: DataFrame):
        self.df = df

    def pipe(self, step: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> Chain:
        return Chain(step(self.df, *args, **kwargs))

    def filter(self, condition: Column | str | None = None, field: str | None = None, value: Any = None, operator: str = "eq") -> Chain:
        return self.pipe(rows.filter_rows(condition) if condition is not None else rows.filter_by_field(field, value, operator))

    def select(self, *fields: str) -> Chain:
        return self.pipe(rows.select_fields(fields))

    def drop(self, *fields: str) -> Chain:
        return self.pipe(rows.drop_fields(fields))

    def rename(self, **mapping: str) -> Chain:
        return self.pipe(rows.rename_fields(mapping))

    def compute(self, name: str, expression: str) -> Chain:
        return self.pipe(rows.compute_field_from_expression(name, expression))

    def map(self, fn: Callable, schema: str) -> Chain:
        """Any function of iterators of Arrow batches; it can't be optimised, so prefer expressions."""
        return Chain(self.df.mapInArrow(fn, schema))

    def join(self, right: DataFrame, on: joins.Keys, how: str = "inner", **options: Any) -> Chain:
        return self.pipe(joins.join, right, on, how, **options)

    def groupby(self, keys: str | list[str], aggs: list[aggregates.Aggregate]) -> Chain:
        return self.pipe(aggregates.group_by, keys, aggs)

    def rollup(self, keys: list[str], aggs: list[aggregates.Aggregate]) -> Chain:
        return self.pipe(aggregates.rollup, keys, aggs)

    def cube(self, keys: list[str], aggs: list[aggregates.Aggregate]) -> Chain:
        return self.pipe(aggregates.cube, keys, aggs)

    def window(self, functions: dict[str, Column], partition_by: list[str] | None = None, order_by: list[str] | None = None) -> Chain:
        return self.pipe(windows.window, functions, partition_by, order_by)

    def pivot(self, index: list[str], columns: str, values: str, aggfunc: str = "mean", **options: Any) -> Chain:
        return self.pipe(reshape.pivot, index, columns, values, aggfunc, **options)

    def unpivot(self, ids: list[str], values: list[str] | None = None, **options: Any) -> Chain:
        return self.pipe(reshape.unpivot, ids, values, **options)

    def clean(self, config: cleaning.CleaningConfig | None = None) -> Chain:
        return self.pipe(cleaning.clean_dataset, config)

    def sort(self, *keys: str) -> Chain:
        return self.pipe(rows.sort_rows(*keys))

    def limit(self, n: int, offset: int = 0) -> Chain:
        return self.pipe(rows.limit_rows(n, offset))

    def execute(self) -> DataFrame:
        return self.df


def transform(df: DataFrame) -> Chain:
    return Chain(df)
