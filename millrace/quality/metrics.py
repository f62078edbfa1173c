"""Quality scores and profiles, as aggregations to one row or a row a column."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ranges import quantiles


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: share of cells that aren't null, overall and (as ``<column>``) by column."""
    names = columns or df.columns
    share = {c: F.avg(F.col(c).isNotNull().cast("double")) for c in names}
    return df.agg((reduce(lambda a, b: a + b, share.values()) / len(names)).alias("completeness"), *(v.alias(c) for c, v in share.items()))


def validity(df: DataFrame, constraints: dict[str, dict[str, Any]]) -> DataFrame:
    """One row: share of rows that break no constraint."""
    from millrace.quality.checks import validate_records

    return validate_records(df, constraints).agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.avg(F.col("is_valid").cast("double")).alias("validity"))


def uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys over rows.  Nulls are values."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), (F.count("*") / F.sum("n")).alias("uniqueness"))


def once_share(df: DataFrame, column: str) -> DataFrame:
    """One row: share of values that occur exactly once."""
    groups = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(F.col("n") == 1).alias("once"), F.try_divide(F.count_if(F.col("n") == 1), F.sum("n")).alias("uniqueness"))


def freshness(df: DataFrame, timestamp: str, max_age_hours: float, as_of: Column | None = None) -> DataFrame:
    """One row: share of rows not older than ``max_age_hours`` at ``as_of`` (now, unless given)."""
    now = as_of if as_of is not None else F.current_timestamp()
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(timestamp).cast("timestamp"))) / 3.6e9
    stale = F.count_if(F.coalesce(age > max_age_hours, F.lit(True)))
    return df.agg(F.count("*").alias("total"), stale.alias("stale"), (1 - stale / F.count("*")).alias("freshness"), F.max(age).alias("oldest_hours"))


def consistency(df: DataFrame, a: str, b: str, kind: str = "equality") -> DataFrame:
    """One row: share of pairs without nulls for which a equals, exceeds or falls below b."""
    test = {"equality": F.col(a) == F.col(b), "greater_than": F.col(a) > F.col(b), "less_than": F.col(a) < F.col(b)}[kind]
    return df.agg(F.count(test).alias("pairs"), F.avg(test.cast("double")).alias("consistency"))


#: Weights of a score's parts.
WEIGHTS = {"completeness": 0.3, "validity": 0.3, "uniqueness": 0.2, "freshness": 0.1, "consistency": 0.1}


@dataclass(frozen=True)
class QualityScore:
    """0 to 100, with its parts; parts that weren't measured count as 100."""

    overall: float
    parts: dict[str, float]


def quality_score(df: DataFrame, constraints: dict[str, dict[str, Any]] | None = None, keys: list[str] | None = None, timestamp: str | None = None, max_age_hours: float = 24.0, as_of: Column | None = None, weights: dict[str, float] | None = None) -> QualityScore:
    parts = {"completeness": completeness(df).first()["completeness"]}
    if constraints:
        parts["validity"] = validity(df, constraints).first()["validity"]
    if keys:
        parts["uniqueness"] = uniqueness(df, keys).first()["uniqueness"]
    if timestamp:
        parts["freshness"] = freshness(df, timestamp, max_age_hours, as_of).first()["freshness"]
    parts = {k: round(100 * (parts[k] if parts.get(k) is not None else 1.0), 4) for k in WEIGHTS}
    w = weights or WEIGHTS
    return QualityScore(round(sum(w[k] * parts[k] for k in w) / sum(w.values()), 4), parts)


def profile(df: DataFrame) -> DataFrame:
    """A row a column: column_name, data_type, null_count, distinct_count, min_value, max_value (as
    text), mean, median, std_dev.  All statistics but medians (exact, see ``ranges.quantiles``) and distinct
    counts share one pass."""
    numbers = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    aggs: list[Column] = []
    plain = lambda c: not isinstance(df.schema[c].dataType, T.ArrayType | T.MapType | T.StructType)
    for c in df.columns:
        x = F.col(f"`{c}`")
        number = c in numbers
        none = F.lit(None)
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                F.count_if(x.isNull()).alias("null_count"),
                (F.min(x) if plain(c) else none).cast("string").alias("min_value"),
                (F.max(x) if plain(c) else none).cast("string").alias("max_value"),
                (F.avg(x) if number else none).cast("double").alias("mean"),
                none.cast("double").alias("median"),
                (F.stddev_samp(x) if number else none).cast("double").alias("std_dev"),
            ).alias(f"_{len(aggs)}")
        )
    row = df.agg(*aggs)
    if numbers:
        row = row.crossJoin(F.broadcast(quantiles(df, {f"_m{i}": (f"`{c}`", 0.5) for i, c in enumerate(df.columns) if c in numbers})))
    columns = (F.col(f"_{i}").withField("median", F.col(f"_m{i}")) if c in numbers else F.col(f"_{i}") for i, c in enumerate(df.columns))
    one = row.select(F.explode(F.array(*columns)).alias("p")).select("p.*")
    # distinct values of all columns in one shuffle: (column, value), first apart, then counted
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.to_json(F.struct(F.col(f"`{c}`").alias("v"))).alias("v")) for c in df.columns if plain(c)))).alias("x")).select("x.*").filter("v <> '{}'")
    distinct = cells.distinct().groupBy("column_name").agg(F.count("*").alias("distinct_count"))
    return one.join(distinct, "column_name", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))


def history_trend(history: DataFrame, value: str = "score", at: str = "at", flat: float = 0.1) -> DataFrame:
    """One row: least-squares slope by place in time, fit, and improving, declining or stable."""
    placed = history.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(at)).cast("double"))
    out = placed.agg(F.regr_slope(F.col(value).cast("double"), F.col("_i")).alias("slope"), F.regr_r2(F.col(value).cast("double"), F.col("_i")).alias("r2"), F.count("*").alias("n"))
    return out.withColumn("trend", F.when(F.col("slope") > flat, "improving").when(F.col("slope") < -flat, "declining").otherwise("stable"))


def alerts(score: QualityScore, least: float = 80.0) -> list[str]:
    return [f"{k} is {v}" for k, v in {"overall": score.overall, **score.parts}.items() if v < least]


def column_profile(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """One row: total, nulls, distinct_count, unique_count (values that occur once), mode, its count, the shortest
    and longest length (of texts), percentiles 5, 25, 50, 75 and 95 (of numbers, within a ten-thousandth of the
    rank), and the most frequent values as sample_values.  Values are counted first, so one that is very frequent
    is one row."""
    kind = df.schema[column].dataType
    x, n = F.col("v"), F.col("n")
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    known = x.isNotNull()
    none = F.lit(None)
    number, text = isinstance(kind, T.NumericType), isinstance(kind, T.StringType)
    mode = F.max_by(F.struct("v", "n"), F.when(known, F.struct(n, F.hash("v")))) if isinstance(kind, T.BooleanType) else F.min_by(F.struct("v", "n"), F.when(known, F.struct(-n, x)))
    out = counts.agg(
        F.sum(n).alias("total"),
        F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("null_count"),
        F.count_if(known).alias("distinct_count"),
        F.count_if(known & (n == 1)).alias("unique_count"),
        mode.alias("_mode"),
        (F.min(F.length(x)) if text else none).cast("long").alias("min_length"),
        (F.max(F.length(x)) if text else none).cast("long").alias("max_length"),
    )
    some = counts.filter(known).orderBy(n.desc(), x).limit(top).agg(F.transform(F.array_sort(F.collect_list(F.struct((-n).alias("k"), x.cast("string").alias("v")))), lambda e: e["v"]).alias("sample_values"))
    out = out.select("total", "null_count", "distinct_count", "unique_count", F.col("_mode.v").cast("string").alias("mode"), F.col("_mode.n").alias("mode_count"), "min_length", "max_length").crossJoin(F.broadcast(some))
    shares = [0.05, 0.25, 0.5, 0.75, 0.95]
    points = df.agg((F.percentile_approx(F.col(column).cast("double"), shares, 10_000) if number else none.cast("array<double>")).alias("percentiles"))
    return out.crossJoin(F.broadcast(points))


def column_quality(df: DataFrame, column: str, constraints: dict[str, Any] | None = None) -> DataFrame:
    """One row: completeness, validity (of values that aren't null), uniqueness (values that occur once), and their
    mean as score, each 0 to 1."""
    from millrace.quality.checks import record_errors

    ok = F.size(record_errors(df, {column: constraints or {}})) == 0
    known = F.col(column).isNotNull()
    one = df.agg(F.avg(known.cast("double")).alias("completeness"), F.avg(F.when(known, ok.cast("double"))).alias("validity"))
    out = one.crossJoin(F.broadcast(once_share(df, column).select("uniqueness")))
    return out.withColumn("score", (F.col("completeness") + F.coalesce("validity", F.lit(0.0)) + F.coalesce("uniqueness", F.lit(0.0))) / 3)


def recommendations(score: QualityScore, least: float = 80.0) -> list[str]:
    """What to do about the parts of a score that are low."""
    advice = {
        "completeness": "fill nulls, or find out where they come from",
        "validity": "look at the rows that break constraints",
        "uniqueness": "remove rows that repeat a key",
        "freshness": "load newer data",
        "consistency": "compare the columns that ought to agree",
    }
    return [f"{k} is {v}: {advice[k]}" for k, v in score.parts.items() if v < least]


def required(score: QualityScore, least: dict[str, float]) -> QualityScore:
    """The score, if all its named parts (or ``overall``) reach what is asked."""
    low = {k: v for k, v in least.items() if (score.overall if k == "overall" else score.parts[k]) < v}
    if low:
        raise ValueError("; ".join(f"{k} is below {v}" for k, v in low.items()))
    return score
