"""Schemas: declared types and constraints over Spark's, DDL, versions, differences and migrations."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared types and Spark's.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "datetime": T.TimestampNTZType(),
    "date": T.DateType(),
    "array": T.ArrayType(T.StringType()),
    "object": T.MapType(T.StringType(), T.StringType()),
    "any": T.StringType(),
}


def column(name: str, kind: str | T.DataType, required: bool = True, nullable: bool = False, description: str = "", **constraints: Any) -> T.StructField:
    """A field; constraints are kept in its metadata: min_value, max_value, min_length, max_length,
    pattern, enum, unique, default (ge and le stand for min_value and max_value)."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a name: {name!r}")
    for short, full in (("ge", "min_value"), ("le", "max_value")):
        if short in constraints:
            constraints[full] = constraints.pop(short)
    return T.StructField(name, TYPES[kind] if isinstance(kind, str) else kind, nullable or not required, {"required": required, "nullable": nullable, "description": description, "constraints": constraints})


def schema(*fields: T.StructField) -> T.StructType:
    names = [f.name for f in fields]
    if len(set(names)) < len(names):
        raise ValueError("two fields share a name")
    return T.StructType(list(fields))


def constraints_of(s: T.StructType) -> dict[str, dict[str, Any]]:
    """For ``quality.checks.validate_records``."""
    return {f.name: {"required": f.metadata.get("required", False), "nullable": f.metadata.get("nullable", f.nullable), **f.metadata.get("constraints", {})} for f in s}


class Declared:
    """A column of a declarative schema class."""

    def __init__(self, kind: str, **options: Any):
        self.kind, self.options = kind, options


String, Integer, Float, Boolean, DateTime, Date, Array, Object, AnyType = ((lambda k: lambda **o: Declared(k, **o))(k) for k in TYPES)


def define_schema(cls: type) -> type:
    """Class decorator: gathers ``Declared`` attributes, also of its bases, to ``cls.schema``."""
    found: dict[str, Declared] = {}
    for base in reversed(cls.__mro__):
        found.update({k: v for k, v in vars(base).items() if isinstance(v, Declared)})
    cls.schema = schema(*(column(k, d.kind, **d.options) for k, d in found.items()))
    return cls


def infer(df: DataFrame) -> T.StructType:
    """The table's schema with what its data show: nulls, longest text, least and largest number; one pass."""
    aggs = []
    for f in df.schema:
        x = F.col(f"`{f.name}`")
        number, text = isinstance(f.dataType, T.NumericType), isinstance(f.dataType, T.StringType)
        aggs.append(F.struct(F.count_if(x.isNull()).alias("nulls"), (F.max(F.length(x)) if text else F.lit(None)).alias("length"), (F.min(x) if number else F.lit(None)).alias("low"), (F.max(x) if number else F.lit(None)).alias("high")).alias(f"_{len(aggs)}"))
    row = df.agg(*aggs).first()
    out = []
    for i, f in enumerate(df.schema):
        s = row[f"_{i}"]
        c = {k: v for k, v in (("max_length", s.length), ("min_value", s.low), ("max_value", s.high)) if v is not None}
        out.append(T.StructField(f.name, f.dataType, s.nulls > 0, {"required": s.nulls == 0, "nullable": s.nulls > 0, "constraints": json.loads(json.dumps(c, default=str))}))
    return T.StructType(out)


def refine_nullability(df: DataFrame, threshold: float = 0.95) -> T.StructType:
    """A field is nullable if more than 1 - threshold of its values are null."""
    row = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in df.columns)).first()
    return T.StructType([T.StructField(f.name, f.dataType, (row[f.name] or 0.0) > 1 - threshold, f.metadata) for f in df.schema])


# expectations of a schema


def expect(s: T.StructType, has: list[str] = (), lacks: list[str] = (), types: dict[str, str] | None = None, columns: int | tuple[int, int] | None = None, exactly: set[str] | None = None, required: list[str] = (), optional: list[str] = (), nullable: list[str] = (), non_nullable: list[str] = (), constraint: dict[tuple[str, str], Any] | None = None) -> list[str]:
    """What a schema doesn't fulfil; a constraint expected to be ``...`` may have any value."""
    by = {f.name: f for f in s}
    out = [f"{c} is missing" for c in has if c not in by] + [f"{c} is there" for c in lacks if c in by]
    out += [f"{c} is {by[c].dataType.simpleString() if c in by else 'missing'}, not {t}" for c, t in (types or {}).items() if c not in by or by[c].dataType.simpleString() != (TYPES[t].simpleString() if t in TYPES else t)]
    if columns is not None:
        low, high = (columns, columns) if isinstance(columns, int) else columns
        out += [] if low <= len(s) <= high else [f"{len(s)} columns"]
    if exactly is not None and set(by) != set(exactly):
        out.append(f"columns differ: {sorted(set(by) ^ set(exactly))}")
    meta = lambda c, k, d=None: by[c].metadata.get(k, d) if c in by else d
    out += [f"{c} isn't required" for c in required if not meta(c, "required", False)] + [f"{c} isn't optional" for c in optional if meta(c, "required", False)]
    out += [f"{c} isn't nullable" for c in nullable if c not in by or not by[c].nullable] + [f"{c} is nullable" for c in non_nullable if c not in by or by[c].nullable]
    for (c, k), v in (constraint or {}).items():
        got = meta(c, "constraints", {}).get(k, ...)
        if got is ... or v is not ... and got != v:
            out.append(f"{c}: {k} is {'not set' if got is ... else got}")
    return out


# DDL

#: Type names of SQL dialects.
DIALECTS = {
    "postgresql": {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "float": "REAL", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "array": "JSONB", "map": "JSONB", "struct": "JSONB"},
    "mysql": {"string": "VARCHAR", "bigint": "BIGINT", "int": "INT", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "DATETIME", "date": "DATE", "array": "JSON", "map": "JSON", "struct": "JSON"},
    "snowflake": {"string": "VARCHAR", "bigint": "NUMBER(38,0)", "int": "NUMBER(38,0)", "double": "FLOAT", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP_LTZ", "timestamp_ntz": "TIMESTAMP_NTZ", "date": "DATE", "array": "VARIANT", "map": "VARIANT", "struct": "VARIANT"},
    "bigquery": {"string": "STRING", "bigint": "INT64", "int": "INT64", "double": "FLOAT64", "float": "FLOAT64", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "DATETIME", "date": "DATE", "array": "ARRAY<STRING>", "map": "STRUCT", "struct": "STRUCT"},
}


def _quoted(name: str, dialect: str) -> str:
    mark = "`" if dialect in ("mysql", "bigquery") else '"'
    return mark + name.replace(mark, mark * 2) + mark


def _literal(v: Any) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"


def create_table(table: str, s: T.StructType, dialect: str = "postgresql", keys: list[str] = ()) -> str:
    lines = []
    for f in s:
        kind = f.dataType.typeName().split("(")[0]
        kind = {"long": "bigint", "integer": "int"}.get(kind, kind)
        if isinstance(f.dataType, T.DecimalType):
            sql = f"DECIMAL({f.dataType.precision},{f.dataType.scale})"
        else:
            sql = DIALECTS[dialect].get(kind, DIALECTS[dialect]["string"])
        c = f.metadata.get("constraints", {})
        if sql == "VARCHAR":
            sql += f"({c.get('max_length', 255)})" if "max_length" in c or dialect == "mysql" else ""
        parts = [_quoted(f.name, dialect), sql]
        if f.metadata.get("required", False) and not f.nullable:
            parts.append("NOT NULL")
        if c.get("unique"):
            parts.append("UNIQUE")
        if "default" in c:
            parts.append(f"DEFAULT {_literal(c['default'])}")
        lines.append("  " + " ".join(parts))
    if keys:
        lines.append(f"  PRIMARY KEY ({', '.join(_quoted(k, dialect) for k in keys)})")
    return f"CREATE TABLE IF NOT EXISTS {_quoted(table, dialect)} (\n" + ",\n".join(lines) + "\n)"


def upsert_sql(table: str, columns: list[str], keys: list[str], dialect: str = "postgresql") -> str:
    """One-row upsert with ``:name`` parameters."""
    q = lambda c: _quoted(c, dialect)
    rest = [c for c in columns if c not in keys]
    insert = f"INSERT INTO {q(table)} ({', '.join(map(q, columns))}) VALUES ({', '.join(f':{c}' for c in columns)})"
    if dialect == "postgresql":
        change = f"DO UPDATE SET {', '.join(f'{q(c)} = EXCLUDED.{q(c)}' for c in rest)}" if rest else "DO NOTHING"
        return f"{insert} ON CONFLICT ({', '.join(map(q, keys))}) {change}"
    if dialect == "mysql":
        return f"{insert} ON DUPLICATE KEY UPDATE {', '.join(f'{q(c)} = VALUES({q(c)})' for c in rest or keys)}"
    source = ", ".join(f":{c} AS {q(c)}" for c in columns)
    on = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in keys)
    change = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{q(c)} = s.{q(c)}' for c in rest)}" if rest else ""
    return f"MERGE INTO {q(table)} t USING (SELECT {source}) s ON {on}{change} WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, columns))}) VALUES ({', '.join(f's.{q(c)}' for c in columns)})"


# versions


@dataclass(frozen=True, order=True)
class Version:
    major: int
    minor: int = 0
    patch: int = 0

    @classmethod
    def parse(cls, text: str) -> Version:
        m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)(?:[-+].*)?", text)
        if not m:
            raise ValueError(f"not a version: {text!r}")
        return cls(*map(int, m.groups()))

    def bump(self, breaking: bool, added: bool) -> Version:
        if breaking:
            return Version(self.major + 1)
        return Version(self.major, self.minor + 1) if added else Version(self.major, self.minor, self.patch + 1)

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.patch}"


@dataclass(frozen=True)
class Change:
    column: str
    kind: str
    breaking: bool
    detail: str = ""


def diff(old: T.StructType, new: T.StructType) -> list[Change]:
    """Removals, changes of type, and anything that is stricter than before, are breaking."""
    a, b = {f.name: f for f in old}, {f.name: f for f in new}
    out = [Change(c, "removed", True) for c in a if c not in b]
    out += [Change(c, "added", False) for c in b if c not in a]
    for c in a:
        if c not in b:
            continue
        x, y = a[c], b[c]
        if x.dataType != y.dataType:
            out.append(Change(c, "type", True, f"{x.dataType.simpleString()} to {y.dataType.simpleString()}"))
        if x.nullable != y.nullable:
            out.append(Change(c, "nullable", x.nullable))
        r, s = x.metadata.get("required", False), y.metadata.get("required", False)
        if r != s:
            out.append(Change(c, "required", s))
        p, q = x.metadata.get("constraints", {}), y.metadata.get("constraints", {})
        for k in sorted(p.keys() | q.keys()):
            if p.get(k) != q.get(k):
                tighter = {"min_value": lambda u, v: v is not None and (u is None or v > u), "min_length": lambda u, v: v is not None and (u is None or v > u), "max_value": lambda u, v: v is not None and (u is None or v < u), "max_length": lambda u, v: v is not None and (u is None or v < u)}.get(k, lambda u, v: False)
                out.append(Change(c, k, tighter(p.get(k), q.get(k)), f"{p.get(k)} to {q.get(k)}"))
    return out


@dataclass
class Migration:
    """Steps: ("add", name, type, default), ("remove", name), ("rename", old, new), ("cast", name, type),
    ("default", name, value)."""

    steps: list[tuple] = field(default_factory=list)

    @classmethod
    def plan(cls, old: T.StructType, new: T.StructType, renames: dict[str, str] | None = None) -> Migration:
        renames = renames or {}
        a, b = {renames.get(f.name, f.name): f for f in old}, {f.name: f for f in new}
        steps: list[tuple] = [("rename", o, n) for o, n in renames.items()]
        steps += [("remove", c) for c in a if c not in b]
        steps += [("add", c, f.dataType.simpleString(), f.metadata.get("constraints", {}).get("default")) for c, f in b.items() if c not in a]
        steps += [("cast", c, b[c].dataType.simpleString()) for c in a if c in b and a[c].dataType != b[c].dataType]
        return cls(steps)

    @property
    def reversible(self) -> bool:
        return not any(s[0] in ("remove", "cast") for s in self.steps)

    def apply(self, df: DataFrame) -> DataFrame:
        for kind, *args in self.steps:
            match kind, args:
                case "rename", [old, new]:
                    df = df.withColumnRenamed(old, new)
                case "remove", [name]:
                    df = df.drop(name)
                case "add", [name, to, default]:
                    df = df.withColumn(name, F.lit(default).cast(to))
                case "cast", [name, to]:
                    df = df.withColumn(name, F.col(name).try_cast(to))
                case "default", [name, value]:
                    df = df.withColumn(name, F.coalesce(name, F.lit(value)))
                case _:
                    raise ValueError(f"unknown step {kind!r}")
        return df


@dataclass
class History:
    """Versions of a schema; a change decides the next number."""

    entries: list[tuple[Version, T.StructType]] = field(default_factory=list)

    def add(self, s: T.StructType) -> Version:
        if not self.entries:
            version = Version(1)
        else:
            last, old = self.entries[-1]
            changes = diff(old, s)
            if not changes:
                return last
            version = last.bump(any(c.breaking for c in changes), any(c.kind == "added" for c in changes))
        self.entries.append((version, s))
        return version

    def migrate(self, df: DataFrame, start: Version, to: Version) -> DataFrame:
        by = dict(self.entries)
        return Migration.plan(by[start], by[to]).apply(df)


def compatible(old: T.StructType, new: T.StructType) -> bool:
    return not any(c.breaking for c in diff(old, new))


def empty(spark: SparkSession, s: T.StructType) -> DataFrame:
    return spark.createDataFrame([], s)

