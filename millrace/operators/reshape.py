"""Pivot and unpivot."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AGG = {"mean": F.avg, "avg": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_samp}


def pivot(df: DataFrame, index: list[str] | str, columns: str, values: str, aggfunc: str | Callable[[str], Column] = "mean", fill_value: Any = None, expected: list | None = None) -> DataFrame:
    """Values of ``columns`` become columns.  Give the ``expected`` ones to spare a pass over the data.
    ``aggfunc`` is a name or a function from the values' column to an aggregate.  Rows with a null index or column value are left out."""
    keys = [index] if isinstance(index, str) else list(index)
    grouped = df.dropna(subset=[*keys, columns]).groupBy(*keys)
    out = (grouped.pivot(columns, expected) if expected else grouped.pivot(columns)).agg((aggfunc if callable(aggfunc) else _AGG[aggfunc])(values))
    return out if fill_value is None else out.fillna(fill_value, [c for c in out.columns if c not in keys])


def unpivot(df: DataFrame, id_vars: list[str] | str, value_vars: list[str] | None = None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Columns become rows; all others than the ids unless told.  Numbers of several types become doubles, other mixtures text."""
    ids = [id_vars] if isinstance(id_vars, str) else list(id_vars)
    names = list(value_vars) if value_vars else [c for c in df.columns if c not in ids]
    kinds = {df.schema[c].dataType.simpleString() for c in names}
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    if len(kinds) > 1:
        kind = "double" if kinds <= numbers else "string"
        df = df.withColumns({c: F.col(c).cast(kind) for c in names})
    return df.unpivot(ids, names, var_name, value_name)
