"""Scalar predicates and normalisations as Columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_email(c: Column) -> Column:
    """Has an @, and a dot after the last one."""
    return c.contains("@") & F.substring_index(c, "@", -1).contains(".")


def matches(c: Column, pattern: str) -> Column:
    """Whether the pattern matches from the start of the text."""
    return c.rlike(f"^(?:{pattern})")


def in_range(c: Column, low: Any = None, high: Any = None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (c >= low)
    if high is not None:
        out = out & (c <= high)
    return out


def has_length(c: Column, least: int | None = None, most: int | None = None) -> Column:
    return in_range(F.length(c), least, most)


def one_of(c: Column, values: list) -> Column:
    return c.isin(list(values))


def has_type(c: Column, kind: str) -> Column:
    """Whether text can be read as the type; null can."""
    return c.isNull() | c.try_cast(kind).isNotNull()


def title_case(c: Column) -> Column:
    """A capital after anything that isn't a letter, small letters elsewhere."""
    first = F.lower(c)
    pieces = F.regexp_extract_all(first, F.lit(r"\P{L}*\p{L}+|\P{L}+"), F.lit(0))
    head = lambda x: F.regexp_extract(x, r"^(\P{L}*)", 1)
    rest = lambda x: F.regexp_extract(x, r"^\P{L}*(.*)$", 1)
    return F.array_join(F.transform(pieces, lambda x: F.concat(head(x), F.initcap(rest(x)))), "")
