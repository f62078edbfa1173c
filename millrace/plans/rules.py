"""Rule sets in the shapes that data-quality tools use, compiled to one suite of checks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import missing_references
from millrace.quality import checks as C


def _one(rule: dict[str, Any]) -> C.Check:
    """A rule has a type, mostly a column, and what the type needs."""
    kind, c, k = rule["type"], rule.get("column"), rule
    match kind:
        case "not_null" | "expect_column_values_to_not_be_null":
            most = k.get("max_nulls", 0)
            return C.Check(f"{c}: at most {most} nulls", {"failed": F.count_if(F.col(c).isNull())}, lambda v: (v["failed"] <= most, v["failed"], f"{v['failed']} nulls"))
        case "unique" | "expect_column_values_to_be_unique":
            return C.unique(c)
        case "regex" | "expect_column_values_to_match_regex":
            return C.match_regex(c, k["pattern"] if "pattern" in k else k["regex"], k.get("mostly", 1.0))
        case "range" | "values_in_range" | "expect_column_values_to_be_between":
            return C.values_between(c, k.get("min", k.get("min_value")), k.get("max", k.get("max_value")))
        case "value_set" | "values_in_set" | "expect_column_values_to_be_in_set":
            return C.values_in_set(c, k.get("values", k.get("value_set")))
        case "row_count" | "expect_table_row_count_to_be_between":
            return C.row_count_between(k.get("min", k.get("min_value")), k.get("max", k.get("max_value")))
        case "expect_table_row_count_to_equal":
            return C.row_count_equals(k["value"])
        case "missing_values":
            return C.null_share_between(c, 0, k.get("max_percent", 0) / 100)
        case "duplicate_values":
            most = k.get("max_percent", 0) / 100
            return C.Check(f"{c}: duplicates", {"rows": F.sum("_n"), "distinct": F.count("*")}, lambda v: (not v["rows"] or 1 - v["distinct"] / v["rows"] <= most, (v["rows"] or 0) - v["distinct"], "too many duplicates"), lambda df: df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n")))
        case "freshness":
            hours, at = k.get("max_age_hours", 24), k.get("as_of")
            now = F.lit(at).cast("timestamp") if at else F.current_timestamp()
            return C.Check(f"{c}: fresh", {"age": (F.unix_micros(now) - F.unix_micros(F.max(c).cast("timestamp"))) / 3.6e9}, lambda v: (v["age"] is not None and v["age"] <= hours, 0, f"newest is {v['age']} hours old"))
        case "expect_column_to_exist":
            return C.custom(f"{c} is there", lambda df: c in df.columns)
        case "schema":
            return C.custom("schema", lambda df: all(n in df.columns and (t is None or dict(df.dtypes)[n] == t) for n, t in k["columns"].items()))
        case "reference":
            target: DataFrame = k["table"]
            return C.custom(f"{c} refers to {k['target_column']}", lambda df: missing_references(df, c, target, k["target_column"]).isEmpty())
    raise ValueError(f"unknown rule {kind!r}")


def checks_of(rules: Iterable[dict[str, Any]]) -> list[C.Check]:
    """A rule's ``severity`` is its check's."""
    return [replace(_one(r), severity=r.get("severity", "error")) for r in rules]


def merge_results(results: Iterable[C.SuiteResult], name: str = "combined") -> C.SuiteResult:
    every = [r for s in results for r in s.results]
    return C.SuiteResult(name, all(r.passed or r.severity == "warning" for r in every), every)


def report_text(result: C.SuiteResult) -> str:
    lines = [f"{result.name}: {'passed' if result.passed else 'FAILED'}, {result.pass_rate:.0%} of {len(result.results)} checks"]
    return "\n".join(lines + [f"- {r.name}: {r.message} ({r.failed_rows} of {r.total_rows} rows)" for r in result.failures])
