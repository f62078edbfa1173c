"""User-defined functions over Arrow batches.  Built-in expressions are faster wherever they suffice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Of ``aggregate_parts``: rows, or bytes, of a table that are made to states at once.
PART_ROWS = 500_000
PART_BYTES = 32 << 20


def scalar(fn: Callable[..., Any], returns: str) -> Callable[..., Column]:
    """A function of values, as one of columns; it is called once a row within Arrow batches."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            yield pd.Series([fn(*x) for x in zip(*columns, strict=True)], dtype=object)

    return F.pandas_udf(run, returns, F.PandasUDFType.SCALAR_ITER)


def vectorised(fn: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """A function of whole columns of a batch (annotated with ``pd.Series``)."""
    return F.pandas_udf(fn, returns)


def aggregate(fn: Callable[[pd.Series], Any], returns: str) -> Callable[[Column | str], Column]:
    """A function from the values of a group, or of a window's frame, to one value.  A group's values are
    held by one task: for large groups, use ``aggregate_parts`` where a function can be merged, or built-in
    aggregates."""

    def one(values: pd.Series) -> Any:
        return fn(values)

    one.__annotations__ = {"values": pd.Series, "return": {"double": float, "long": int, "bigint": int, "string": str, "boolean": bool}[returns]}
    return F.pandas_udf(one, returns)


def aggregate_parts(df: DataFrame, keys: str | list[str], column: str, part: Callable[[pd.Series], dict[str, Any]], state: str, merge: Callable[[pd.DataFrame], Any], name: str, returns: str) -> DataFrame:
    """An aggregate of groups of any size: ``part`` makes a state, with the fields of the DDL ``state``, from some of a
    group's values, and ``merge`` the result ``name`` from a table of all states of the group.

    Values are read where they are, at most PART_ROWS or PART_BYTES and a batch at a time; only states are shuffled.
    Keys are of plain types; null is a group.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    fields, most, large = T.StructType.fromDDL(state).fields, PART_ROWS, PART_BYTES
    if not names:
        raise ValueError("aggregate_parts needs keys")
    values = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(names)), F.col(column).alias("v"))
    schema = T.StructType([*values.schema.fields[:-1], *(T.StructField(f"s{i}", f.dataType) for i, f in enumerate(fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def states(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            rows = table.drop_columns(["v"]).append_column("row", pa.array(np.arange(table.num_rows)))
            groups = rows.group_by([f"k{i}" for i in range(len(names))], use_threads=False).aggregate([("row", "list")])
            made = [part(table.column("v").take(places.values).to_pandas()) for places in groups.column("row_list")]
            made = {f"s{i}": pa.array([m[f.name] for m in made], to_arrow_type(f.dataType), from_pandas=True) for i, f in enumerate(fields)}
            yield from pa.table({c: groups.column(c) for c in groups.column_names if c != "row_list"} | made).to_batches()

        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= most or size >= large:
                yield from states(held)
                held, rows, size = [], 0, 0
        if held:
            yield from states(held)

    def one(*columns: pd.Series) -> Any:
        return merge(pd.DataFrame({f.name: c for f, c in zip(fields, columns, strict=True)}))

    result = F.pandas_udf(one, returns, F.PandasUDFType.GROUPED_AGG)(*(F.col(f"s{i}") for i in range(len(fields))))
    found = values.mapInArrow(run, schema).groupBy(*(f"k{i}" for i in range(len(names)))).agg(result.alias("r"))
    return found.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(names)), F.col("r").alias(name))


def group_apply(df: DataFrame, keys: str | list[str], fn: Callable[[pd.DataFrame], dict[str, Any] | pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Calls a function for each group's rows; it gives one row as a dict, or a table.  A group must fit
    into one task's memory."""
    names = [keys] if isinstance(keys, str) else list(keys)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = fn(rows)
        return out if isinstance(out, pd.DataFrame) else pd.DataFrame([out])

    return df.groupBy(*names).applyInPandas(run, schema)


def row_function(df: DataFrame, fn: Callable[[dict[str, Any]], dict[str, Any] | None], schema: str) -> DataFrame:
    """Calls a function for each row; rows for which it gives None are left out."""

    def run(batches):
        for rows in batches:
            out = [r for r in map(fn, rows.to_dict("records")) if r is not None]
            yield pd.DataFrame(out, columns=names)

    names = T.StructType.fromDDL(schema).names
    return df.mapInPandas(run, schema)
