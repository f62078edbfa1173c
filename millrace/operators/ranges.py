"""Running sums over the distinct values of a column, and quantiles, without one task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are dealt to.
RANGES = 256
#: Quantiles are looked for among values whose rank is at most this share of the rows away; the sketch is off by a third of it.
NEAR = 0.0003


def running_sums(counts: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """Adds ``<column>_upto``: the sum over all rows of ``counts`` (a row a value) up to the row's value.

    Values are dealt to ranges that hold about as many of them each, whatever their distribution; sums
    run within a range and start from what the ranges before hold, which is a row a range.
    """
    ends = counts.agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 10_000).alias("_ends"))
    placed = counts.crossJoin(F.broadcast(ends)).withColumn("_p", F.size(F.filter("_ends", lambda e: e < F.col(value)))).drop("_ends")
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_p").agg(*(F.sum(c).alias(f"_t_{c}") for c in columns))
    totals = totals.select("_p", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns))
    within = Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({f"{c}_upto": F.sum(c).over(within) for c in columns}).join(F.broadcast(totals), "_p")
    return out.select(*counts.columns, *((F.col(f"{c}_upto") + F.col(f"_b_{c}")).alias(f"{c}_upto") for c in columns))


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: for each name, the exact quantile of a number column at a share, interpolated as ``percentile`` does, and null
    where there are no values.

    ``percentile`` brings the distinct values of all tasks to one.  Here a sketch says between which values a quantile is to be
    expected, a count of the rows below and up to them whether it is there (if not, that side is left open), and only values
    between are grouped.  So ``df`` is computed three times, and one task sees some ``2 * NEAR`` of its rows, if these differ.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    values = df.select(*(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)))
    at = [(columns.index(c), p) for c, p in wanted.values()]
    around = {i: [x for j, p in at if j == i for x in (max(p - NEAR, 0.0), min(p + NEAR, 1.0))] for i in range(len(columns))}
    ends = values.agg(*(x for i, shares in around.items() for x in (F.count(f"v{i}").alias(f"n{i}"), F.percentile_approx(f"v{i}", shares, 10_000).alias(f"e{i}"))))
    used = dict.fromkeys(around, 0)
    counts, places = [F.first(c).alias(c) for c in ends.columns], []
    for k, (i, p) in enumerate(at):
        low, high = F.get(f"e{i}", F.lit(used[i])), F.get(f"e{i}", F.lit(used[i] + 1))
        used[i] += 2
        counts += [F.count_if(F.col(f"v{i}") < low).alias(f"below{k}"), F.count_if(F.col(f"v{i}") <= high).alias(f"upto{k}")]
        place = (F.col(f"n{i}") - 1) * F.lit(p)
        fits = F.col(f"below{k}") <= F.floor(place)
        places += [place.alias(f"p{k}"), F.when(fits, low).alias(f"low{k}"), F.when(fits, F.col(f"below{k}")).otherwise(0).alias(f"before{k}"), F.when(F.col(f"upto{k}") > F.ceil(place), high).alias(f"high{k}")]
    placed = values.crossJoin(F.broadcast(values.crossJoin(F.broadcast(ends)).agg(*counts).select(*places)))
    between = []
    for k, (i, _) in enumerate(at):
        v, low, high = F.col(f"v{i}"), F.col(f"low{k}"), F.col(f"high{k}")
        inside = v.isNotNull() & (low.isNull() | (v >= low)) & (high.isNull() | (v <= high))
        between.append(F.when(inside, F.struct(F.lit(k).alias("k"), v.alias("v"), F.col(f"p{k}").alias("p"), F.col(f"before{k}").alias("before"))))
    near = placed.select(F.explode(F.array(*between)).alias("x")).filter("x IS NOT NULL").groupBy("x.k", "x.v", "x.p", "x.before").count()
    near = near.withColumn("upto", F.col("before") + F.sum("count").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda k, rank: F.min(F.when((F.col("k") == k) & (F.col("upto") > rank("p")), F.col("v")))
    found = near.agg(*(x for k in range(len(at)) for x in (first(k, F.floor).alias(f"a{k}"), first(k, F.ceil).alias(f"b{k}"), F.max(F.when(F.col("k") == k, F.col("p"))).alias(f"p{k}"))))
    line = lambda a, b, p: F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)
    return found.select(*(line(F.col(f"a{k}"), F.col(f"b{k}"), F.col(f"p{k}")).alias(n) for k, n in enumerate(wanted)))
