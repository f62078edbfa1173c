"""Window functions with explicit order; ranks share ties as SQL's do."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.rows import sort_key


def window_function(kind: str, column: str | None = None, offset: int = 1, default: Any = None) -> Column:
    """row_number, rank, dense_rank, percent_rank, ntile (``offset`` tiles), lag or lead.  A default of
    lag and lead stands for rows beyond the partition, not for nulls in it."""
    ranks = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank}
    if kind in ranks:
        return ranks[kind]()
    if kind == "ntile":
        return F.ntile(offset)
    if kind in ("lag", "lead") and column:
        return (F.lag if kind == "lag" else F.lead)(column, offset, default)
    raise ValueError(f"unknown window function {kind!r}")


def window(df: DataFrame, functions: dict[str, Column], partition_by: list[str] | str | None = None, order_by: list[str] | str | None = None) -> DataFrame:
    """Adds window columns.  Keys of order are ``"col"`` or ``"col DESC"``.

    Without ``partition_by``, all rows go to one task: right for small tables only.
    """
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    keys = [order_by] if isinstance(order_by, str) else list(order_by or [])
    w = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    if keys:
        w = w.orderBy(*map(sort_key, keys))
    return df.withColumns({k: f.over(w) for k, f in functions.items()})


def moving_average(df: DataFrame, column: str, partition_by: list[str], order_by: list[str], size: int = 7, tolerance: float = 0.2) -> DataFrame:
    """Trailing mean of ``size`` rows with the current one, once there are so many, and whether the value
    is further than ``tolerance`` from it."""
    w = Window.partitionBy(*partition_by).orderBy(*map(sort_key, order_by))
    frame = w.rowsBetween(-(size - 1), 0)
    mean = F.when(F.row_number().over(w) >= size, F.avg(column).over(frame))
    out = df.withColumn("moving_avg", mean)
    return out.withColumn("is_anomaly", F.coalesce(F.abs(F.try_divide(F.col(column) - F.col("moving_avg"), F.col("moving_avg"))) > tolerance, F.lit(False)))


def change_points(df: DataFrame, column: str, partition_by: list[str], order_by: list[str], threshold: float = 0.2) -> DataFrame:
    """Rows whose value differs from the one before by more than ``threshold`` of it."""
    w = Window.partitionBy(*partition_by).orderBy(*map(sort_key, order_by))
    out = df.withColumn("previous", F.lag(column).over(w))
    out = out.withColumn("change", F.abs(F.try_divide(F.col(column) - F.col("previous"), F.abs("previous"))))
    return out.filter(F.col("change") > threshold)
