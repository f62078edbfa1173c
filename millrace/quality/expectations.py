"""Fluent expectations, suites of them, and ways to combine checks.

    expect("price").to_be_between(0, 10).to_not_be_null().run(df)
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from millrace.quality import checks as C


class Expectations:
    """A chain of checks; each method adds one."""

    def __init__(self, names: tuple[str, ...] = (), found: tuple[C.Check, ...] = ()):
        self.names, self.checks = names, found

    def _and(self, check: C.Check) -> Expectations:
        return type(self)(self.names, (*self.checks, check))

    def __or__(self, other: Expectations) -> Expectations:
        """The checks of both."""
        return Expectations(self.names, (*self.checks, *other.checks))

    def as_warnings(self) -> Expectations:
        return type(self)(self.names, tuple(replace(c, severity="warning") for c in self.checks))

    def suite(self, name: str = "expectations", strategy: str = "collect_all") -> C.Suite:
        return C.Suite(name, list(self.checks), strategy)

    def run(self, df: DataFrame, strategy: str = "collect_all") -> C.SuiteResult:
        return self.suite(strategy=strategy).run(df)


def _adds(make: Callable[..., C.Check], columns: int) -> Callable[..., Expectations]:
    def method(self: Expectations, *args: Any, **kwargs: Any) -> Expectations:
        if len(self.names) < columns:
            raise ValueError(f"{make.__name__} needs {columns} columns")
        return self._and(make(*self.names[:columns], *args, **kwargs))

    method.__doc__ = make.__doc__
    return method


class ColumnExpectations(Expectations):
    """Of one column."""

    to_be_between = _adds(C.values_between, 1)
    to_be_in_set = _adds(C.values_in_set, 1)
    to_not_be_in_set = _adds(C.values_not_in_set, 1)
    to_be_unique = _adds(C.unique, 1)
    to_be_of_type = _adds(C.of_type, 1)
    to_not_be_null = _adds(C.not_null, 1)
    to_match_regex = _adds(C.match_regex, 1)
    to_not_match_regex = _adds(C.not_match_regex, 1)
    to_have_lengths_between = _adds(C.lengths_between, 1)
    to_be_increasing = _adds(C.increasing, 1)
    to_be_decreasing = _adds(C.decreasing, 1)
    to_be_dates = _adds(C.date_parseable, 1)
    to_have_mean_between = _adds(C.mean_between, 1)
    to_have_std_dev_between = _adds(C.std_dev_between, 1)
    to_have_min_between = _adds(C.min_between, 1)
    to_have_max_between = _adds(C.max_between, 1)
    to_have_median_between = _adds(C.median_between, 1)
    to_have_null_share_between = _adds(C.null_share_between, 1)
    to_have_no_outliers = _adds(C.no_anomalies_zscore, 1)


class ColumnsExpectations(Expectations):
    """Of several columns."""

    to_be_equal = _adds(C.pair_equal, 2)
    to_differ = _adds(C.pair_not_equal, 2)
    to_be_greater = _adds(C.pair_greater, 2)
    to_have_equal_sums = _adds(C.sums_equal, 2)
    to_have_group_means_between = _adds(C.group_means_between, 2)

    def to_be_unique_together(self, ignore_nulls: bool = True) -> Expectations:
        return self._and(C.unique(list(self.names), ignore_nulls))


class TableExpectations(Expectations):
    """Of the table."""

    to_have_rows_between = _adds(C.row_count_between, 0)
    to_have_rows = _adds(C.row_count_equals, 0)
    to_have_group_sizes_between = _adds(C.group_sizes_between, 0)
    to_pass = _adds(C.custom, 0)


def expect(*columns: str) -> ColumnExpectations | ColumnsExpectations | TableExpectations:
    """Of one column, several, or, without any, the table."""
    kind = (TableExpectations, ColumnExpectations)[len(columns)] if len(columns) < 2 else ColumnsExpectations
    return kind(tuple(columns))


def _combined(name: str, parts: tuple[C.Check, ...], passes: Callable[[list[bool]], bool]) -> C.Check:
    def judged(df: DataFrame) -> bool:
        return passes([r.passed for r in C.Suite(name, list(parts)).run(df).results])

    return C.custom(name, judged)


def all_of(*parts: C.Check) -> C.Check:
    return _combined(" and ".join(c.name for c in parts), parts, all)


def any_of(*parts: C.Check) -> C.Check:
    return _combined(" or ".join(c.name for c in parts), parts, any)


def negated(part: C.Check) -> C.Check:
    return _combined(f"not {part.name}", (part,), lambda r: not r[0])


@dataclass
class Library:
    """Checks and makers of checks by name."""

    makers: dict[str, Callable[..., C.Check]] = field(default_factory=dict)
    suites: dict[str, list[C.Check]] = field(default_factory=dict)

    def register(self, name: str, maker: Callable[..., C.Check]) -> Library:
        """A maker takes the parameters that the expectation is to be given."""
        self.makers[name] = maker
        return self

    def make(self, name: str, *args: Any, **kwargs: Any) -> C.Check:
        return self.makers[name](*args, **kwargs)

    def save(self, name: str, found: Iterable[C.Check]) -> None:
        self.suites[name] = list(found)

    def suite(self, *names: str, strategy: str = "collect_all") -> C.Suite:
        """The checks of saved suites, in order, each name once."""
        seen = {c.name: c for n in names for c in self.suites[n]}
        return C.Suite("+".join(names), list(seen.values()), strategy)
