"""Equi-joins with SQL's nulls, and the joins that pipelines build from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = str | list[str] | tuple[str, str]
_HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full"}


def join(left: DataFrame, right: DataFrame, on: Keys, how: str = "inner", left_suffix: str = "_x", right_suffix: str = "_y", null_safe: bool = False, hint: str | None = None) -> DataFrame:
    """Joins on a name, a list of names, or a tuple of a left and a right name.

    Keys of one name come out once, filled from either side.  Other columns that both sides have get the
    suffixes.  Null keys match nothing, unless ``null_safe``.  ``hint`` is a join hint for the right
    side; without one, Spark chooses by size.
    """
    if how not in _HOW:
        raise ValueError(f"unknown join {how!r}")
    pairs = [on] if isinstance(on, tuple) else [(k, k) for k in ([on] if isinstance(on, str) else on)]
    for side, names in (("left", [a for a, _ in pairs if a not in left.columns]), ("right", [b for _, b in pairs if b not in right.columns])):
        if names:
            raise ValueError(f"the {side} table has no column {', '.join(names)}")
    shared = {a for a, b in pairs if a == b}
    both = (set(left.columns) & set(right.columns)) - shared
    l, r = left.alias("_l"), (right.hint(hint) if hint else right).alias("_r")  # noqa: E741
    l_col, r_col = (lambda c: F.col(f"_l.`{c}`")), (lambda c: F.col(f"_r.`{c}`"))
    conditions: list[Column] = [l_col(a).eqNullSafe(r_col(b)) if null_safe else l_col(a) == r_col(b) for a, b in pairs]
    out = l.join(r, reduce(lambda x, y: x & y, conditions), _HOW[how])
    key = {"right": r_col, "full": lambda c: F.coalesce(l_col(c), r_col(c))}.get(_HOW[how], l_col)
    return out.select(
        *((key(c) if c in shared else l_col(c)).alias(f"{c}{left_suffix}" if c in both else c) for c in left.columns),
        *(r_col(c).alias(f"{c}{right_suffix}" if c in both else c) for c in right.columns if c not in shared),
    )


def missing_references(source: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """Distinct values of a column that the target's column lacks."""
    values = source.select(F.col(column).alias("value")).filter("value is not null").distinct()
    return values.join(target.select(F.col(target_column).alias("value")).distinct(), "value", "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: str, order_by: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``existing`` with their key; the last of a key by ``order_by``
    counts, or, without one, the last in the order in which ``new`` holds its rows (of files: by file and place).
    Rows without the key are always kept."""
    keyed = new.filter(F.col(key).isNotNull())
    row = F.struct(*new.columns)
    place = F.col(order_by) if order_by else F.monotonically_increasing_id()
    last = keyed.select(F.col(key).alias("_key"), row.alias("_new"), place.alias("_place")).groupBy("_key").agg(F.max_by("_new", "_place").alias("_row")).select("_row.*")
    old = existing.join(last.select(F.col(key)), key, "left_anti").select(*existing.columns)  # a null key matches nothing, so it stays
    return old.unionByName(last, allowMissingColumns=True).unionByName(new.filter(F.col(key).isNull()), allowMissingColumns=True)
