"""Pipelines from TOML or JSON: sources, assets with steps, expectations and sinks."""

from __future__ import annotations

import json
import re
import tomllib
import warnings
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import aggregates, joins, rows
from millrace.plans.graph import Asset, Context, Graph
from millrace.plans.rules import checks_of
from millrace.quality.checks import Suite, SuiteResult, ValidationError, split_valid
from millrace.sources.files import read_file, write_file

_AGG = {"sum": aggregates.Sum, "count": aggregates.Count, "avg": aggregates.Avg, "min": aggregates.Min, "max": aggregates.Max, "count_distinct": aggregates.CountDistinct}


def load(path: str | Path, variables: dict[str, str] | None = None) -> dict[str, Any]:
    """Reads a file; ``${NAME}`` stands for a variable, which must be given."""
    text = Path(path).read_text()

    def one(m: re.Match) -> str:
        if m[1] not in (variables or {}):
            raise KeyError(m[1])
        return variables[m[1]]

    text = re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", one, text)
    return tomllib.loads(text) if str(path).endswith(".toml") else json.loads(text)


def _validated(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """The table, if its ``rules`` hold and its rows keep the ``constraints``; else ``on_failure``: fail, warn or
    drop (rows that break a constraint)."""
    wrong = []
    if spec.get("rules"):
        wrong += [f"{r.name}: {r.message}" for r in Suite("validate", checks_of(spec["rules"])).run(df).failures if r.severity == "error"]
    constraints, what = spec.get("constraints", {}), spec.get("on_failure", "fail")
    if constraints and what == "drop":
        df = split_valid(df, constraints)[0]
    elif constraints:
        bad = split_valid(df, constraints)[1].count()
        wrong += [f"{bad} rows break a constraint"] if bad else []
    if wrong and what == "warn":
        warnings.warn("; ".join(wrong), stacklevel=2)
    elif wrong:
        raise ValidationError("; ".join(wrong))
    return df


def step(df: DataFrame, spec: dict[str, Any], tables: dict[str, DataFrame]) -> DataFrame:
    """One step of an asset.  Conditions and values are SQL expressions; an unknown kind is an error."""
    kind = spec.get("type")
    match kind:
        case "extract_fields":
            new = rows.extract_fields(spec["fields"])(df)
            return new.select(*spec["fields"], *(c for c in df.columns if c not in spec["fields"]))
        case "select":
            return rows.select_fields(spec["fields"])(df)
        case "drop":
            return rows.drop_fields(spec["fields"])(df)
        case "rename":
            return rows.rename_fields(spec["fields"])(df)
        case "cast":
            return rows.cast_field(spec["field"], spec["to"], spec.get("default"))(df)
        case "filter":
            return df.filter(spec["condition"])
        case "compute_field":
            value = spec["expression"]
            return df.withColumn(spec["field"], F.current_timestamp() if value == "now()" else F.expr(value))
        case "aggregate":
            return aggregates.group_by(df, spec["group_by"], [_AGG[a["function"]](a["column"], a.get("alias")) for a in spec["aggregations"]])
        case "sort":
            return rows.sort_rows(*spec["by"])(df)
        case "limit":
            return rows.limit_rows(spec["count"], spec.get("offset", 0))(df)
        case "join":
            on = spec["on"]
            return joins.join(df, tables[spec["with"]], tuple(on) if spec.get("pair") else on, spec.get("how", "inner"))
        case "validate":
            return _validated(df, spec)
    raise ValueError(f"unknown step {kind!r}")


def build(config: dict[str, Any]) -> Graph:
    """A graph of the configuration's sources and assets, each depending on what it reads."""
    graph = Graph()
    for name, spec in config.get("sources", {}).items():
        options = {k: v for k, v in spec.items() if k not in ("path", "format", "schema", "type")}

        def source(context: Context, spec: dict = spec, options: dict = options) -> DataFrame:
            return read_file(context.spark, spec["path"], spec.get("format"), spec.get("schema"), **options)

        graph.add(Asset(name, source))
    for name, spec in config.get("assets", {}).items():
        deps = list(dict.fromkeys([spec["source"], *spec.get("depends_on", []), *(s["with"] for s in spec.get("steps", []) if s.get("type") == "join")]))

        def asset(spec: dict = spec, **tables: DataFrame) -> DataFrame:
            df = tables[spec["source"]]
            for s in spec.get("steps", []):
                df = step(df, s, tables)
            return df

        asset.__signature__ = _keywords(deps)
        graph.add(Asset(name, asset, tuple(deps), **{k: spec[k] for k in ("keep", "key", "order_by", "retries") if k in spec}))
    return graph


def _keywords(names: list[str]):
    import inspect

    return inspect.Signature([inspect.Parameter(n, inspect.Parameter.KEYWORD_ONLY) for n in names])


def run(spark: SparkSession, config: dict[str, Any]) -> tuple[dict[str, DataFrame], dict[str, SuiteResult]]:
    """Runs all assets, checks their expectations and writes the sinks."""
    from millrace.plans.graph import Engine

    outcome = Engine(spark).run(build(config))
    if not outcome.success:
        raise RuntimeError("; ".join(f"{k}: {v}" for k, v in outcome.errors.items()))
    results = {}
    for name, spec in config.get("assets", {}).items():
        if spec.get("expectations"):
            results[name] = Suite(name, checks_of(spec["expectations"])).run(outcome.tables[name])
    for spec in config.get("sinks", {}).values():
        done = write_file(outcome.tables[spec["asset"]], spec["path"], spec.get("format"), spec.get("mode", "overwrite"), spec.get("partition_by"), spec.get("compression"))
        if not done.success:
            raise RuntimeError(done.error)
    return outcome.tables, results
