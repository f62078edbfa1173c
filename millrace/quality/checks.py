"""Declarative checks, compiled: all simple ones of a suite share one aggregation.

A check has aggregates (evaluated together with those of other checks), or groups by columns, or needs a
row order.  Results say how many rows were looked at and how many failed, never row positions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import predicates as P
from millrace.operators.ranges import quantiles
from millrace.operators.rows import sort_key


@dataclass(frozen=True)
class CheckResult:
    name: str
    passed: bool
    total_rows: int = 0
    failed_rows: int = 0
    message: str = ""
    statistics: dict[str, Any] = field(default_factory=dict)
    severity: str = "error"


@dataclass(frozen=True)
class Check:
    """``aggregates``: name -> aggregate Column of the table.  ``judge``: from their values to a result.
    ``table``: from the table to another one on which the aggregates are to be made, if not itself."""

    name: str
    aggregates: dict[str, Column]
    judge: Callable[[dict[str, Any]], tuple[bool, int, str]]
    table: Callable[[DataFrame], DataFrame] | None = None
    severity: str = "error"


def _rows(name: str, bad: Column, message: str, of: Column | None = None) -> Check:
    """Passes if no row is ``bad``; null counts as not bad."""
    return Check(name, {"failed": F.count_if(bad)}, lambda v: (v["failed"] == 0, v["failed"], message))


def _statistic(name: str, value: Column, low: Any, high: Any) -> Check:
    def judge(v: dict[str, Any]) -> tuple[bool, int, str]:
        x = v["value"]
        return x is not None and (low is None or x >= low) and (high is None or x <= high), 0, f"{name} is {x}, not in [{low}, {high}]"

    return Check(name, {"value": value}, judge)


# of one column


def mean_between(c: str, low: float, high: float) -> Check:
    return _statistic(f"{c}: mean", F.avg(c), low, high)


def std_dev_between(c: str, low: float, high: float) -> Check:
    return _statistic(f"{c}: standard deviation", F.stddev_samp(c), low, high)


def min_between(c: str, low: Any, high: Any) -> Check:
    return _statistic(f"{c}: min", F.min(c), low, high)


def max_between(c: str, low: Any, high: Any) -> Check:
    return _statistic(f"{c}: max", F.max(c), low, high)


def median_between(c: str, low: float, high: float) -> Check:
    """Exact; it makes passes of its own, see ``ranges.quantiles``."""
    return replace(_statistic(f"{c}: median", F.lit(None), low, high), aggregates={}, table=lambda df: quantiles(df, {"value": (c, 0.5)}))


def null_share_between(c: str, low: float, high: float) -> Check:
    return _statistic(f"{c}: share of nulls", F.avg(F.col(c).isNull().cast("double")), low, high)


def match_regex(c: str, pattern: str, share: float = 1.0) -> Check:
    hit = P.matches(F.col(c), pattern)
    return Check(f"{c}: matches {pattern}", {"n": F.count(c), "hits": F.count_if(hit)}, lambda v: (v["n"] > 0 and v["hits"] >= share * v["n"], v["n"] - v["hits"], f"{v['hits']} of {v['n']} match"))


def not_match_regex(c: str, pattern: str) -> Check:
    return _rows(f"{c}: doesn't match {pattern}", P.matches(F.col(c), pattern), "some match")


def values_between(c: str, low: Any, high: Any) -> Check:
    return _rows(f"{c}: between {low} and {high}", ~F.col(c).between(low, high), "some are outside")


def values_in_set(c: str, values: list) -> Check:
    def odd(df: DataFrame) -> DataFrame:
        """One row: rows with other values, and the first ten of these."""
        counts = df.filter(~F.col(c).isin(list(values))).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
        some = counts.orderBy("v").limit(10).agg(F.sort_array(F.collect_list("v")).alias("some"))
        return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failed")).crossJoin(F.broadcast(some))

    return Check(f"{c}: in set", {}, lambda v: (v["failed"] == 0, v["failed"], f"unexpected: {v['some']}"), odd)


def values_not_in_set(c: str, values: list) -> Check:
    known = [v for v in values if v is not None]
    bad = F.coalesce(F.col(c).isin(known), F.lit(False)) if known else F.lit(False)
    return _rows(f"{c}: not in set", bad | F.col(c).isNull() if None in values else bad, "forbidden values")


def unique(c: str | list[str], ignore_nulls: bool = True) -> Check:
    keys = [c] if isinstance(c, str) else list(c)

    def groups(df: DataFrame) -> DataFrame:
        return (df.dropna(subset=keys) if ignore_nulls else df).groupBy(*keys).agg(F.count("*").alias("_n"))

    return Check(f"{', '.join(keys)}: unique", {"failed": F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)), "values": F.count_if(F.col("_n") > 1)}, lambda v: (v["failed"] == 0, v["failed"], f"{v['values']} values repeat"), groups)


def of_type(c: str, kind: str) -> Check:
    return _rows(f"{c}: of type {kind}", ~P.has_type(F.col(c).cast("string"), kind), "some can't be read so")


def not_null(c: str, allow_empty: bool = False) -> Check:
    bad = F.col(c).isNull() if allow_empty else F.col(c).isNull() | (F.col(c).cast("string") == "")
    return _rows(f"{c}: not null", bad, "nulls")


def lengths_between(c: str, least: int | None, most: int | None) -> Check:
    return _rows(f"{c}: length", ~P.has_length(F.col(c), least, most), "some are too short or long")


def date_parseable(c: str, formats: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "d MMM yyyy", "MMM d, yyyy")) -> Check:
    parsed = F.coalesce(*(F.try_to_timestamp(F.col(c), F.lit(f)) for f in formats))
    return _rows(f"{c}: a date", F.col(c).isNotNull() & parsed.isNull(), "some aren't dates")


def _ordered(c: str, strict: bool, order_by: list[str], partition_by: list[str], up: bool) -> Check:
    def steps(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*(partition_by or [F.lit(0)])).orderBy(*map(sort_key, order_by))
        return df.filter(F.col(c).isNotNull()).withColumn("_p", F.lag(c).over(w))

    a, b = (F.col("_p"), F.col(c)) if up else (F.col(c), F.col("_p"))
    bad = (a >= b) if strict else (a > b)
    return Check(f"{c}: {'in' if up else 'de'}creasing", {"failed": F.count_if(bad)}, lambda v: (v["failed"] == 0, v["failed"], "out of order"), steps)


def increasing(c: str, order_by: list[str], strict: bool = False, partition_by: list[str] | None = None) -> Check:
    """By the given order; nulls are passed over."""
    return _ordered(c, strict, order_by, partition_by or [], True)


def decreasing(c: str, order_by: list[str], strict: bool = False, partition_by: list[str] | None = None) -> Check:
    return _ordered(c, strict, order_by, partition_by or [], False)


# of two columns, groups, and the table


def pair_equal(a: str, b: str) -> Check:
    return _rows(f"{a} equals {b}", ~F.col(a).eqNullSafe(F.col(b)), "some differ")


def pair_not_equal(a: str, b: str) -> Check:
    return _rows(f"{a} differs from {b}", F.col(a).eqNullSafe(F.col(b)), "some are equal")


def pair_greater(a: str, b: str, or_equal: bool = False) -> Check:
    return _rows(f"{a} greater than {b}", ~(F.col(a) >= F.col(b)) if or_equal else ~(F.col(a) > F.col(b)), "some aren't")


def sums_equal(a: str, b: str, tolerance: float = 0.0) -> Check:
    return Check(f"sums of {a} and {b}", {"gap": F.abs(F.coalesce(F.sum(a), F.lit(0)) - F.coalesce(F.sum(b), F.lit(0)))}, lambda v: (v["gap"] <= tolerance, 0, f"they differ by {v['gap']}"))


def group_sizes_between(group: str, least: int, most: int) -> Check:
    return Check(f"rows a {group}", {"failed": F.count_if(~F.col("_n").between(least, most))}, lambda v: (v["failed"] == 0, v["failed"], f"{v['failed']} groups are too small or large"), lambda df: df.groupBy(group).agg(F.count("*").alias("_n")))


def group_means_between(c: str, group: str, low: float, high: float) -> Check:
    return Check(f"mean {c} a {group}", {"failed": F.count_if(~F.col("_m").between(low, high))}, lambda v: (v["failed"] == 0, v["failed"], f"{v['failed']} groups are outside"), lambda df: df.groupBy(group).agg(F.avg(c).alias("_m")))


def row_count_between(least: int | None, most: int | None) -> Check:
    return _statistic("rows", F.count(F.lit(1)), least, most)


def row_count_equals(n: int) -> Check:
    return row_count_between(n, n)


def no_anomalies_iqr(c: str, multiplier: float = 1.5, most: int = 0) -> Check:
    from millrace.quality.anomaly import iqr_outliers

    return Check(f"{c}: no outliers by quartiles", {"failed": F.count_if("is_anomaly")}, lambda v: (v["failed"] <= most, v["failed"], f"{v['failed']} outliers"), lambda df: iqr_outliers(df.select(c), c, multiplier))


def no_anomalies_isolation(c: str, contamination: float = 0.1, most: int = 0, seed: int = 42) -> Check:
    from millrace.quality.anomaly import isolation_outliers

    return Check(f"{c}: no outliers by isolation", {"failed": F.count_if("is_anomaly")}, lambda v: (v["failed"] <= most, v["failed"], f"{v['failed']} outliers"), lambda df: isolation_outliers(df.select(c), [c], contamination, seed=seed))


def record_filter(passes: Column, message: str = "filter failed") -> Check:
    """Rows for which the condition isn't true fail."""
    return Check(message, {"failed": F.count_if(~F.coalesce(passes, F.lit(False)))}, lambda v: (v["failed"] == 0, v["failed"], message))


def no_anomalies_zscore(c: str, threshold: float = 3.0, most: int = 0) -> Check:
    def scored(df: DataFrame) -> DataFrame:
        return df.select(F.col(c).alias("_v")).crossJoin(F.broadcast(df.agg(F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s"))))

    return Check(f"{c}: no outliers", {"failed": F.count_if(F.abs(F.col("_v") - F.col("_m")) > threshold * F.col("_s"))}, lambda v: (v["failed"] <= most, v["failed"], f"{v['failed']} outliers"), scored)


def custom(name: str, passes: Callable[[DataFrame], bool], severity: str = "error") -> Check:
    """Any function of the table; it runs by itself."""
    return Check(name, {}, lambda v: (bool(v["passed"]), 0, ""), lambda df: df.sparkSession.createDataFrame([(bool(passes(df)),)], "passed boolean"), severity)


# suites


@dataclass
class Suite:
    """``strategy``: collect_all, fail_fast (nothing is reported after the first failure) or
    continue_on_warning (only errors make the suite fail)."""

    name: str
    checks: list[Check] = field(default_factory=list)
    strategy: str = "collect_all"

    def add(self, *checks: Check) -> Suite:
        self.checks.extend(checks)
        return self

    def plan(self, df: DataFrame) -> DataFrame:
        """The one row that holds the aggregates of all simple checks, and the number of rows."""
        return df.agg(F.count(F.lit(1)).alias("_rows"), *(a.alias(f"{i}|{n}") for i, c in enumerate(self.checks) if c.table is None for n, a in c.aggregates.items()))

    def run(self, df: DataFrame) -> SuiteResult:
        shared = self.plan(df).first().asDict()
        out: list[CheckResult] = []
        for i, c in enumerate(self.checks):
            try:
                if c.table is None:
                    values = {n: shared[f"{i}|{n}"] for n in c.aggregates}
                else:
                    other = c.table(df)
                    values = (other.agg(*(a.alias(n) for n, a in c.aggregates.items())) if c.aggregates else other).first().asDict()
                passed, failed, message = c.judge(values)
                out.append(CheckResult(c.name, passed, shared["_rows"], failed, "" if passed else message, values, c.severity))
            except Exception as e:  # a check that can't run has failed
                out.append(CheckResult(c.name, False, shared["_rows"], 0, str(e).split("\n")[0], {}, c.severity))
            if self.strategy == "fail_fast" and not out[-1].passed:
                break
        bad = [r for r in out if not r.passed and not (self.strategy == "continue_on_warning" and r.severity == "warning")]
        return SuiteResult(self.name, not bad, out)


@dataclass(frozen=True)
class SuiteResult:
    name: str
    passed: bool
    results: list[CheckResult]

    @property
    def failures(self) -> list[CheckResult]:
        return [r for r in self.results if not r.passed]

    @property
    def pass_rate(self) -> float:
        return sum(r.passed for r in self.results) / len(self.results) if self.results else 1.0


class ValidationError(Exception):
    """A table failed a suite."""


def validate(suite: Suite, on_failure: str = "raise") -> Callable:
    """Decorator: runs a suite on the table that a function returns; raise, warn or ignore."""

    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(fn)
        def run(*args: Any, **kwargs: Any) -> DataFrame:
            df = fn(*args, **kwargs)
            if on_failure != "ignore":
                result = suite.run(df)
                if not result.passed:
                    text = "; ".join(f"{r.name}: {r.message}" for r in result.failures)
                    if on_failure == "raise":
                        raise ValidationError(text)
                    import warnings

                    warnings.warn(text, stacklevel=2)
            return df

        return run

    return wrap


# records against constraints


def record_errors(df: DataFrame, constraints: dict[str, dict[str, Any]]) -> Column:
    """An array of what is wrong with a row.  Constraints of a column: required, nullable, type,
    min_value, max_value, min_length, max_length, pattern, enum.  Null passes all but the first two."""
    errors: list[Column] = []
    for c, rules in constraints.items():
        if c not in df.columns:
            if rules.get("required", False):
                errors.append(F.lit(f"{c}: missing"))
            continue
        x = F.col(c)
        if rules.get("required") or rules.get("nullable") is False:
            errors.append(F.when(x.isNull(), F.lit(f"{c}: null")))
        tests = {
            "type": lambda v, x=x: ~P.has_type(x.cast("string"), v),
            "min_value": lambda v, x=x: x < v,
            "max_value": lambda v, x=x: x > v,
            "min_length": lambda v, x=x: F.length(x) < v,
            "max_length": lambda v, x=x: F.length(x) > v,
            "pattern": lambda v, x=x: ~P.matches(x, v),
            "enum": lambda v, x=x: ~x.isin(list(v)),
        }
        errors += [F.when(tests[k](v), F.lit(f"{c}: {k}")) for k, v in rules.items() if k in tests]
    return F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array().cast("array<string>")


def validate_records(df: DataFrame, constraints: dict[str, dict[str, Any]], strict: bool = False) -> DataFrame:
    """Adds errors (array) and is_valid.  Strict: columns without constraints are an error."""
    if strict and (more := [c for c in df.columns if c not in constraints]):
        raise ValidationError(f"undeclared columns: {', '.join(more)}")
    return df.withColumn("errors", record_errors(df, constraints)).withColumn("is_valid", F.size("errors") == 0)


def split_valid(df: DataFrame, constraints: dict[str, dict[str, Any]]) -> tuple[DataFrame, DataFrame]:
    marked = validate_records(df, constraints)
    return marked.filter("is_valid").drop("errors", "is_valid"), marked.filter("NOT is_valid").drop("is_valid")
