"""SQL assets: templates with ``{{ name }}`` for upstream tables and values, checked and run by Spark."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.graph import Asset, Graph

_SLOT = re.compile(r"\{\{\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\}\}")
_RISKY = {"DROP TABLE": r"\bdrop\s+table\b", "TRUNCATE": r"\btruncate\b", "DELETE FROM": r"\bdelete\s+from\b", "GRANT": r"\bgrant\b", "REVOKE": r"\brevoke\b"}


class TemplateError(ValueError):
    """A template names something that isn't given."""


def dependencies(template: str) -> list[str]:
    return list(dict.fromkeys(m.split(".")[0] for m in _SLOT.findall(template)))


def render(template: str, values: dict[str, Any]) -> str:
    """Fills the slots.  Strings are put in as they are, so give identifiers here and data as parameters."""

    def one(m: re.Match) -> str:
        out: Any = values
        for part in m[1].split("."):
            if not (isinstance(out, dict) and part in out):
                raise TemplateError(f"{m[1]} isn't given")
            out = out[part]
        return str(out)

    return _SLOT.sub(one, template)


def check(spark: SparkSession, text: str) -> tuple[list[str], list[str]]:
    """Errors of Spark's parser, and warnings about risky statements."""
    errors = []
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        errors.append(str(e).strip().split("\n")[0])
    return errors, [k for k, p in _RISKY.items() if re.search(p, text, re.IGNORECASE)]


def run_sql(spark: SparkSession, template: str, tables: dict[str, DataFrame] | None = None, values: dict[str, Any] | None = None, params: dict[str, Any] | None = None) -> DataFrame:
    """Renders and runs.  Tables are bound to their slots without touching the catalog; ``:name``
    parameters are bound by Spark, as values and not as text."""
    tables = tables or {}
    text = render(template, {n: "{" + n + "}" for n in tables} | (values or {}))
    return spark.sql(text, args=params or None, **tables)


def sql_asset(graph: Graph, name: str | None = None, **options: Any) -> Callable:
    """Decorator of a function that returns a template; its slots are what it depends on."""

    def wrap(fn: Callable[[], str]) -> Callable[[], str]:
        template = fn()
        deps = tuple(d for d in dependencies(template) if d in graph.assets)

        def make(**inputs: Any) -> DataFrame:
            spark = next(iter(inputs.values())).sparkSession if inputs else SparkSession.active()
            return run_sql(spark, template, inputs)

        make.__signature__ = inspect.Signature([inspect.Parameter(d, inspect.Parameter.KEYWORD_ONLY) for d in deps])
        graph.add(Asset(name or fn.__name__, make, deps, **options))
        return fn

    return wrap
