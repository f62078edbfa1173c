"""Data cleaning: duplicates, nulls, outliers, text, types and scaling.

Statistics of a whole table are one aggregation to one row, which is broadcast back: its size doesn't
depend on the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.predicates import title_case
from millrace.operators.ranges import quantiles
from millrace.operators.rows import sort_key


def _numeric(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and (columns is None or f.name in columns)]


def _texts(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]


def _with_stats(df: DataFrame, stats: dict[str, Column | _Quantile]) -> DataFrame:
    """Adds aggregates over the whole table as columns; they are one row, or one of aggregates and one of exact quantiles."""
    exact = {n: c for n, c in stats.items() if isinstance(c, _Quantile)}
    rest = [c.alias(n) for n, c in stats.items() if n not in exact]
    out = df.crossJoin(F.broadcast(df.agg(*rest))) if rest else df
    return out.crossJoin(F.broadcast(quantiles(df, exact))) if exact else out


class _Quantile(NamedTuple):
    column: str
    share: float


# duplicates


def remove_duplicates(df: DataFrame, columns: list[str] | None = None, keep: str = "first", order_by: list[str] | None = None) -> DataFrame:
    """Keeps the first or last row of each key by ``order_by``, or none of those that repeat.  Nulls are
    equal.  Over all columns no order is needed."""
    keys = columns or df.columns
    if keep == "none":
        return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")
    if columns is None:
        return df.dropDuplicates()
    if not order_by:
        raise ValueError("order_by says which row is first")
    return _ranked(df, keys, keep, order_by).filter("_k = 1").drop("_k")


def find_duplicates(df: DataFrame, columns: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """The rows after the first of each key."""
    return _ranked(df, columns or df.columns, "first", order_by or (columns or df.columns)).filter("_k > 1").drop("_k")


def _ranked(df: DataFrame, keys: list[str], keep: str, order_by: list[str]) -> DataFrame:
    order = [sort_key(k) for k in order_by]
    if keep == "last":
        order = [F.col(k.split()[0]).asc_nulls_first() if k.upper().endswith(" DESC") else F.col(k.split()[0]).desc_nulls_first() for k in order_by]
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


# nulls


def handle_nulls(df: DataFrame, strategy: str, fill_value: Any = None, columns: list[str] | None = None, order_by: list[str] | None = None, partition_by: list[str] | None = None, approx: bool = False) -> DataFrame:
    """drop, fill_default, fill_mean, fill_median, fill_mode, fill_forward, fill_backward, interpolate or
    keep.  The last three but keep need an order; give ``partition_by`` too, as without it all rows are
    ordered by one task."""
    names = columns or df.columns
    if strategy == "keep":
        return df
    if strategy == "drop":
        return df.dropna("any", subset=names)
    if strategy == "fill_default":
        return df.withColumns({c: F.coalesce(c, F.lit(fill_value).cast(df.schema[c].dataType)) for c in names})
    stats = {"fill_mean": F.avg, "fill_median": lambda c: _quantile(c, 0.5, approx), "fill_mode": lambda c: F.mode(c, True)}
    if strategy in stats:
        names = names if strategy == "fill_mode" else _numeric(df, names)
        out = _with_stats(df, {f"_s_{c}": stats[strategy](c) for c in names})
        kind = lambda c: df.schema[c].dataType if strategy == "fill_mode" else T.DoubleType()
        return out.select(*((F.coalesce(F.col(c).cast(kind(c)), f"_s_{c}").alias(c) if c in names else F.col(c)) for c in df.columns))
    if not order_by:
        raise ValueError(f"{strategy} needs an order")
    if strategy == "fill_forward":
        return _beside(df, names, order_by, partition_by, lambda c: F.coalesce(f"_past_{c}", f"_next_{c}"))
    if strategy == "fill_backward":
        return _beside(df, names, order_by, partition_by, lambda c: F.coalesce(f"_next_{c}", f"_past_{c}"))
    if strategy == "interpolate":

        def between(c: str) -> Column:
            a, b = F.col(f"_past_{c}").cast("double"), F.col(f"_next_{c}").cast("double")
            line = a + (b - a) * F.try_divide(F.col("_i") - F.col(f"_past_i_{c}"), F.col(f"_next_i_{c}") - F.col(f"_past_i_{c}"))
            return F.coalesce(F.col(c).cast("double"), line, a)

        return _beside(df, _numeric(df, names), order_by, partition_by, between)
    raise ValueError(f"unknown strategy {strategy!r}")


def _beside(df: DataFrame, names: list[str], order_by: list[str], partition_by: list[str] | None, new: Callable[[str], Column]) -> DataFrame:
    """Replaces columns by what ``new`` makes of ``_i``, the row's place, and of the nearest values that aren't null, ``_past_<column>``
    and ``_next_<column>``, at ``_past_i_<column>`` and ``_next_i_<column>``; the row's own is both.

    Spark goes over a frame that ends in the future again for each row, in the square of a group's rows.  So the next values are the
    last ones of the reverse order, by places, which are the same for both where the order leaves ties.
    """
    w = Window.partitionBy(*(partition_by or [F.lit(0)]))

    def nearest(side: str, order: list[Column]) -> dict[str, Column]:
        seen = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        last = lambda c: F.last(c, ignorenulls=True).over(seen)
        return {f"_{side}_{c}": last(F.col(c)) for c in names} | {f"_{side}_i_{c}": last(F.when(F.col(c).isNotNull(), F.col("_i"))) for c in names}

    out = df.withColumn("_i", F.row_number().over(w.orderBy(*map(sort_key, order_by))))
    out = out.withColumns(nearest("past", [F.col("_i")])).withColumns(nearest("next", [F.col("_i").desc()]))
    return out.select(*(new(c).alias(c) if c in names else F.col(c) for c in df.columns))


def null_counts(df: DataFrame) -> DataFrame:
    """One row: nulls of each column."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))


# outliers


def _quantile(c: str, p: float, approx: bool) -> Column | _Quantile:
    """For ``_with_stats``: exact (interpolated; see ``ranges.quantiles``), or, in one pass, within a ten-thousandth of the rank."""
    return F.percentile_approx(F.col(c).cast("double"), p, 10_000) if approx else _Quantile(c, p)


def _bounds(df: DataFrame, columns: list[str], method: str, threshold: float, approx: bool = False) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """The table with statistics, and the lowest and highest usual value of each column."""
    low_high: dict[str, tuple[Column, Column]] = {}
    if method == "iqr":
        df = _with_stats(df, {f"_q{k}_{c}": _quantile(c, k / 4, approx) for c in columns for k in (1, 3)})
        for c in columns:
            q1, q3 = F.col(f"_q1_{c}"), F.col(f"_q3_{c}")
            low_high[c] = (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
    elif method == "zscore":
        df = _with_stats(df, {f"_m_{c}": F.avg(c) for c in columns} | {f"_d_{c}": F.stddev_samp(c) for c in columns})
        for c in columns:
            low_high[c] = (F.col(f"_m_{c}") - threshold * F.col(f"_d_{c}"), F.col(f"_m_{c}") + threshold * F.col(f"_d_{c}"))
    elif method == "modified_zscore":
        df = _with_stats(df, {f"_m_{c}": _quantile(c, 0.5, approx) for c in columns})
        df = df.withColumns({f"_o_{c}": F.abs(F.col(c) - F.col(f"_m_{c}")) for c in columns})
        df = _with_stats(df, {f"_d_{c}": _quantile(f"_o_{c}", 0.5, approx) for c in columns})
        for c in columns:
            reach = F.nullif(F.col(f"_d_{c}"), F.lit(0)) * threshold / 0.6745
            low_high[c] = (F.col(f"_m_{c}") - reach, F.col(f"_m_{c}") + reach)
    elif method == "percentile":
        df = _with_stats(df, {f"_l_{c}": _quantile(c, threshold / 100, approx) for c in columns} | {f"_h_{c}": _quantile(c, 1 - threshold / 100, approx) for c in columns})
        for c in columns:
            low_high[c] = (F.col(f"_l_{c}"), F.col(f"_h_{c}"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return df, low_high


def detect_outliers(df: DataFrame, method: str = "iqr", threshold: float = 1.5, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Adds ``<column>_is_outlier`` for each number column; ``approx``: see ``_quantile``."""
    names = _numeric(df, columns)
    out, bounds = _bounds(df, names, method, threshold, approx)
    flags = {f"{c}_is_outlier": F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)) for c, (lo, hi) in bounds.items()}
    return out.withColumns(flags).select(*df.columns, *flags)


def handle_outliers(df: DataFrame, method: str = "iqr", action: str = "cap", threshold: float = 1.5, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """drop, cap (both ends), floor (lower end), mean_replace, median_replace or flag; bounds are the
    method's."""
    if action == "flag":
        return detect_outliers(df, method, threshold, columns, approx)
    names = _numeric(df, columns)
    out, bounds = _bounds(df, names, method, threshold, approx)
    odd = {c: F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)) for c, (lo, hi) in bounds.items()}
    if action == "drop":
        for c in names:
            out = out.filter(~odd[c])
        return out.select(*df.columns)
    if action == "cap":
        new = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), lo), hi)) for c, (lo, hi) in bounds.items()}
    elif action == "floor":
        new = {c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c).cast("double"), lo)) for c, (lo, _) in bounds.items()}
    elif action in ("mean_replace", "median_replace"):
        stat = F.avg if action == "mean_replace" else lambda c: _quantile(c, 0.5, approx)
        out = _with_stats(out, {f"_r_{c}": stat(c) for c in names})
        new = {c: F.when(odd[c], F.col(f"_r_{c}")).otherwise(F.col(c).cast("double")) for c in names}
    else:
        raise ValueError(f"unknown action {action!r}")
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


# types, scaling and text


def normalize_types(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Casts columns; what can't be cast is null, and null stays null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in mapping.items() if c in df.columns})


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns become whole numbers or doubles if all their values are."""
    names = _texts(df)
    if not names:
        return df
    tests = [F.coalesce(F.every(F.col(c).isNull() | F.col(c).try_cast(t).isNotNull()), F.lit(False)).alias(f"{c}|{t}") for c in names for t in ("bigint", "double")]
    row = df.agg(*tests).first()
    kind = {c: "bigint" if row[f"{c}|bigint"] else "double" if row[f"{c}|double"] else None for c in names}
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in kind.items() if t})


def standardize_columns(df: DataFrame, columns: list[str], method: str = "zscore", approx: bool = False) -> DataFrame:
    """zscore (sample deviation), minmax or robust (median and quartiles); null where there is no spread."""
    parts = {
        "zscore": lambda c: (F.avg(c), F.stddev_samp(c)),
        "minmax": lambda c: (F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")),
        "robust": lambda c: (_quantile(c, 0.5, approx), _quantile(c, 0.75, approx), _quantile(c, 0.25, approx)),
    }[method]
    out = _with_stats(df, {f"_{k}_{c}": s for c in columns for k, s in zip("abc", parts(c))})  # noqa: B905
    spread = lambda c: F.col(f"_b_{c}") - F.col(f"_c_{c}") if method == "robust" else F.col(f"_b_{c}")
    new = {c: F.try_divide(F.col(c) - F.col(f"_a_{c}"), spread(c)) for c in columns}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


def clean_text(df: DataFrame, trim: bool = True, normalize: bool = False, case: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Trims white space, brings to Unicode form NFKC and changes case of text columns.

    Spark has no function for NFKC, so that goes through an Arrow batch function, and only if asked for.
    """
    change = {None: lambda c: c, "upper": F.upper, "lower": F.lower, "title": title_case}[case]

    def one(c: str) -> Column:
        out = F.col(c)
        if normalize:
            out = _nfkc()(out)
        if trim:
            out = F.regexp_replace(out, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")
        return change(out)

    return df.withColumns({c: one(c) for c in _texts(df, columns)})


def _nfkc() -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return nfkc


def remove_special_chars(df: DataFrame, columns: list[str] | None = None, keep_alphanumeric: bool = True, keep_spaces: bool = True) -> DataFrame:
    pattern = (r"[^a-zA-Z0-9\s]" if keep_spaces else r"[^a-zA-Z0-9]") if keep_alphanumeric else r"^\s+|\s+$"
    return df.withColumns({c: F.regexp_replace(c, pattern, "") for c in _texts(df, columns)})


# the whole of it


@dataclass
class CleaningConfig:
    dedup: bool = True
    dedup_columns: list[str] | None = None
    order_by: list[str] | None = None
    null_strategy: str = "keep"
    null_fill_value: Any = None
    null_columns: list[str] | None = None
    outlier_method: str | None = None
    outlier_action: str = "cap"
    outlier_threshold: float = 1.5
    outlier_columns: list[str] | None = None
    trim: bool = False
    case: str | None = None
    text_columns: list[str] | None = None
    standardize: str | None = None
    standardize_columns: list[str] = field(default_factory=list)


def clean_dataset(df: DataFrame, config: CleaningConfig | None = None) -> DataFrame:
    """Duplicates, nulls, outliers, text, then scaling, as far as they are set."""
    c = config or CleaningConfig()
    if c.dedup:
        df = remove_duplicates(df, c.dedup_columns, order_by=c.order_by)
    df = handle_nulls(df, c.null_strategy, c.null_fill_value, c.null_columns, c.order_by)
    if c.outlier_method or c.outlier_columns:
        df = handle_outliers(df, c.outlier_method or "iqr", c.outlier_action, c.outlier_threshold, c.outlier_columns)
    if c.trim or c.case:
        df = clean_text(df, c.trim, case=c.case, columns=c.text_columns)
    if c.standardize:
        df = standardize_columns(df, c.standardize_columns, c.standardize)
    return df


def clean_data(config: CleaningConfig | None = None) -> Callable:
    """Decorator: cleans the table that a function returns."""

    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        return wraps(fn)(lambda *a, **k: clean_dataset(fn(*a, **k), config))

    return wrap


def cleaning_report(before: DataFrame, after: DataFrame) -> dict[str, Any]:
    """Rows and nulls before and after, rows removed, and columns that changed their type; one aggregation each."""
    a, b = (d.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in d.columns)).first().asDict() for d in (before, after))
    return {"original_count": a["rows"], "final_count": b["rows"], "nulls_before": sum(v for k, v in a.items() if k != "rows"), "nulls_after": sum(v for k, v in b.items() if k != "rows"), "rows_removed": a["rows"] - b["rows"], "types_changed": sorted(c for c, t in after.dtypes if dict(before.dtypes).get(c, t) != t)}


def data_profile(df: DataFrame) -> dict[str, Any]:
    row = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns)).first().asDict()
    distinct = df.distinct().count()
    return {"rows": row.pop("_n"), "columns": df.columns, "types": dict(df.dtypes), "nulls": row, "duplicate_rows": df.count() - distinct}


def drop_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return handle_nulls(df, "drop", columns=columns)


def fill_nulls(df: DataFrame, value: Any, columns: list[str] | None = None) -> DataFrame:
    return handle_nulls(df, "fill_default", value, columns)
