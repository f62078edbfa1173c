"""Projections, row functions and predicates.  Each returns a function for ``df.transform``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expressions import to_column

Step = Callable[[DataFrame], DataFrame]


def select_fields(fields: Iterable[str]) -> Step:
    """Keeps the listed columns in the table's own order; names that it lacks are ignored."""
    wanted = set(fields)
    return lambda df: df.select(*(c for c in df.columns if c in wanted))


def drop_fields(fields: Iterable[str]) -> Step:
    return lambda df: df.drop(*fields)


def rename_fields(mapping: Mapping[str, str]) -> Step:
    """Renames in place; a column whose name is taken over gives way."""

    def run(df: DataFrame) -> DataFrame:
        taken = {new for old, new in mapping.items() if old in df.columns and new != old}
        return df.select(*(F.col(c).alias(mapping.get(c, c)) for c in df.columns if c in mapping or c not in taken))

    return run


def cast_field(name: str, target: str, default: Any = None) -> Step:
    """Casts; null, or what can't be cast, becomes ``default``.  'false' casts to false."""
    return lambda df: df.withColumn(name, F.coalesce(F.col(name).try_cast(target), F.lit(default).cast(target)))


def compute_field(name: str, value: Column | str) -> Step:
    """A column from a Column, or from SQL text."""
    return lambda df: df.withColumn(name, F.expr(value) if isinstance(value, str) else value)


def compute_field_from_expression(name: str, expression: str) -> Step:
    """A column from Python-like arithmetic, comparison and logic over columns; null where it fails."""
    return lambda df: df.withColumn(name, to_column(expression, df.columns))


def add_field(name: str, value: Column, kind: str) -> Step:
    return lambda df: df.withColumn(name, value.cast(kind))


def extract_fields(mapping: Mapping[str, str]) -> Step:
    """New columns from dotted paths: of structs and maps, or of JSON text; null where absent."""

    def column(df: DataFrame, path: str) -> Column:
        head, _, rest = path.partition(".")
        if not rest:
            return F.col(f"`{head}`") if head in df.columns else F.lit(None).cast("string")
        if head not in df.columns:
            return F.lit(None).cast("string")
        if df.schema[head].dataType.typeName() == "string":
            return F.get_json_object(head, f"$.{rest}")
        out = F.col(f"`{head}`")
        for part in rest.split("."):
            out = out[part]
        return out

    return lambda df: df.withColumns({k: column(df, p) for k, p in mapping.items()})


def map_field(name: str, mapping: Mapping[Any, Any], default: Any = None) -> Step:
    """Replaces values by a table; others become ``default``, or stay if there is none."""

    def run(df: DataFrame) -> DataFrame:
        table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)) if mapping else None
        found = table[F.col(name)] if table is not None else F.lit(None)
        return df.withColumn(name, F.coalesce(found, F.lit(default) if default is not None else F.col(name)))

    return run


def enrich_from_lookup(lookup: DataFrame, lookup_key: str, target_key: str, fields: list[str], prefix: str = "", order_by: str | None = None) -> Step:
    """Left lookup: ``fields`` of the row with the key.  Of rows that share one, the last by
    ``order_by`` counts, or the one with the largest fields; a null key finds nothing.  Spark
    broadcasts the lookup if it is small."""
    best = F.max_by(F.struct(*fields), F.col(order_by)) if order_by else F.max(F.struct(*fields))
    one = lookup.filter(F.col(lookup_key).isNotNull()).groupBy(F.col(lookup_key).alias("_key")).agg(best.alias("_found"))

    def run(df: DataFrame) -> DataFrame:
        out = df.join(one, df[target_key] == one["_key"], "left")
        return out.select(*(df[c] for c in df.columns if c not in {f"{prefix}{f}" for f in fields}), *(F.col("_found")[f].alias(f"{prefix}{f}") for f in fields))

    return run


def filter_rows(condition: Column | str) -> Step:
    return lambda df: df.filter(condition)


def predicate(name: str, value: Any = None, operator: str = "eq") -> Column:
    """A predicate that is never null: comparisons by order drop nulls; ne and not_in keep them; eq to
    None finds them."""
    c = F.col(name)
    simple = {
        "eq": lambda: c.eqNullSafe(F.lit(value)),
        "ne": lambda: ~c.eqNullSafe(F.lit(value)),
        "gt": lambda: c > value,
        "lt": lambda: c < value,
        "gte": lambda: c >= value,
        "lte": lambda: c <= value,
        "in": lambda: c.isin(list(value)),
        "not_in": lambda: ~F.coalesce(c.isin(list(value)), F.lit(False)),
        "is_null": c.isNull,
        "is_not_null": c.isNotNull,
    }
    if operator not in simple:
        raise ValueError(f"unknown operator {operator!r}")
    return simple[operator]()


def filter_by_field(name: str, value: Any = None, operator: str = "eq") -> Step:
    return lambda df: df.filter(predicate(name, value, operator))


def filter_field_equals(name: str, value: Any) -> Step:
    return filter_by_field(name, value)


def filter_field_not_null(name: str) -> Step:
    return filter_by_field(name, operator="is_not_null")


def sort_rows(*keys: str) -> Step:
    """``"col"`` or ``"col DESC"``; nulls last either way."""
    return lambda df: df.orderBy(*map(sort_key, keys))


def sort_key(key: str) -> Column:
    name, _, way = key.strip().partition(" ")
    return F.col(name).desc_nulls_last() if way.strip().upper() == "DESC" else F.col(name).asc_nulls_last()


def limit_rows(count: int, offset: int = 0) -> Step:
    return lambda df: (df.offset(offset) if offset else df).limit(count)


def top_k(count: int, *keys: str) -> Step:
    """The first rows by the keys; Spark takes the best of each partition first."""
    return lambda df: df.orderBy(*map(sort_key, keys)).limit(count)


def top_k_per_group(group: list[str], count: int, *keys: str) -> Step:
    def run(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(*map(sort_key, keys))
        return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= count).drop("_k")

    return run


def union_all(*others: DataFrame) -> Step:
    """Rows of all tables, by column name; what a table lacks is null."""

    def run(df: DataFrame) -> DataFrame:
        for o in others:
            df = df.unionByName(o, allowMissingColumns=True)
        return df

    return run


def intersection(other: DataFrame) -> Step:
    """Distinct rows that both tables have."""
    return lambda df: df.intersect(other.select(*df.columns))


def difference(other: DataFrame) -> Step:
    """Distinct rows that the other table lacks."""
    return lambda df: df.subtract(other.select(*df.columns))
