"""Drift between a baseline and a current table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranges import running_sums


def ks_statistic(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """One row: the largest gap between the two cumulative distributions, and both sizes.

    Rows are counted by value first; only the running sum over distinct values needs an order, and it is
    made by ranges of values whose totals are added up, so no one task sees all of them.
    """
    tag = lambda df, k: df.select(F.col(column).cast("double").alias("v"), F.lit(k).alias("k")).filter("v is not null")
    values = tag(baseline, 0).union(tag(current, 1)).groupBy("v").agg(F.count_if(F.col("k") == 0).alias("a"), F.count_if(F.col("k") == 1).alias("b"))
    ends = values.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    placed = running_sums(values, "v", ["a", "b"]).crossJoin(F.broadcast(ends))
    gap = F.abs(F.col("a_upto") / F.col("na") - F.col("b_upto") / F.col("nb"))
    return placed.agg(F.max(gap).alias("statistic"), F.max("na").alias("n_baseline"), F.max("nb").alias("n_current"))


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value."""
    if not n or not m:
        return 1.0
    x = d * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def psi(baseline: DataFrame, current: DataFrame, column: str, bins: int = 10, formula: str = "log") -> DataFrame:
    """One row: population stability index over equal bins of the joint range.  ``log``:
    (n - h) ln(n / h); ``chi``: (n - h)(n / h - 1).  Bins that either lacks count 0 in ``chi`` and, in
    ``log``, a share of 0.0001."""
    tag = lambda df, k: df.select(F.col(column).cast("double").alias("v"), F.lit(k).alias("k")).filter("v is not null")
    both = tag(baseline, 0).union(tag(current, 1))
    ends = both.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.col("k") == 0).alias("na"), F.count_if(F.col("k") == 1).alias("nb"))
    b = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins)), F.lit(0))
    shares = both.crossJoin(F.broadcast(ends)).groupBy(b.cast("int").alias("bin")).agg((F.count_if(F.col("k") == 0) / F.max("na")).alias("h"), (F.count_if(F.col("k") == 1) / F.max("nb")).alias("n"))
    if formula == "log":
        h, n = F.greatest("h", F.lit(1e-4)), F.greatest("n", F.lit(1e-4))
        term = (n - h) * F.log(n / h)
    else:
        term = F.when((F.col("h") > 0) & (F.col("n") > 0), (F.col("n") - F.col("h")) * (F.col("n") / F.col("h") - 1)).otherwise(0.0)
    return shares.agg(F.sum(term).alias("psi"))


def chi_square(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """One row: chi-square of the two-by-k table of counts, degrees of freedom and a score of at most 1."""
    tag = lambda df, k: df.select(F.col(column).alias("c"), F.lit(k).alias("k")).filter("c is not null")
    t = tag(baseline, 0).union(tag(current, 1)).groupBy("c").agg(F.count_if(F.col("k") == 0).alias("a"), F.count_if(F.col("k") == 1).alias("b"))
    total = t.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count("*").alias("cells"))
    e = lambda n: (F.col("a") + F.col("b")) * F.col(n) / (F.col("na") + F.col("nb"))
    term = F.try_divide(F.pow(F.col("a") - e("na"), 2), e("na")) + F.try_divide(F.pow(F.col("b") - e("nb"), 2), e("nb"))
    out = t.crossJoin(F.broadcast(total)).agg(F.sum(term).alias("statistic"), F.max("cells").alias("cells"))
    return out.select("statistic", (F.col("cells") - 1).alias("df"), F.least(F.col("statistic") / (2 * F.col("cells")), F.lit(1.0)).alias("score"))


def chi_square_p_value(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by the regularised incomplete gamma function."""
    if df <= 0 or x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-14:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    tiny = 1e-300
    b, c = z + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h


def drift_report(baseline: DataFrame, current: DataFrame, columns: list[str], significance: float = 0.05, psi_threshold: float = 0.25) -> dict[str, dict]:
    out = {}
    for c in columns:
        ks, p = ks_statistic(baseline, current, c).first(), psi(baseline, current, c).first()["psi"]
        value = ks_p_value(ks.statistic or 0.0, ks.n_baseline or 0, ks.n_current or 0)
        out[f"{c}_ks"] = {"statistic": ks.statistic, "p_value": value, "drifted": value < significance}
        out[f"{c}_psi"] = {"statistic": p, "drifted": (p or 0) > psi_threshold}
    return out
