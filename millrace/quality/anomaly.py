"""Outliers of a column, against itself or a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranges import quantiles, running_sums


def zscores(df: DataFrame, column: str, threshold: float = 3.0, modified: bool = False) -> DataFrame:
    """Adds score and is_anomaly.  Modified: by the median and 1.4826 times the median deviation.  A spread
    of 0 counts as 1."""
    x = F.col(column).cast("double")
    if modified:
        df = df.crossJoin(F.broadcast(quantiles(df, {"_m": (column, 0.5)})))
        off = df.select(F.abs(x - F.col("_m")).alias("off"))
        df = df.crossJoin(F.broadcast(quantiles(off, {"_s": ("off", 0.5)}).select((1.4826 * F.col("_s")).alias("_s"))))
    else:
        df = df.crossJoin(F.broadcast(df.agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))))
    spread = F.when(F.coalesce(F.col("_s"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("_s"))
    out = df.withColumn("score", F.abs(x - F.col("_m")) / spread)
    return out.withColumn("is_anomaly", F.coalesce(F.col("score") > threshold, F.lit(False))).drop("_m", "_s")


def exclusive_quartiles(df: DataFrame, column: str) -> DataFrame:
    """One row: q1 and q3 at places k (n + 1) / 4 of the sorted values, linear between; null below 4 values.

    Values are first counted, so that ranks come from running sums over distinct values, by ranges.
    """
    x = F.col(column).cast("double").alias("v")
    counts = df.select(x).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    placed = running_sums(counts, "v", ["n"]).withColumnRenamed("n_upto", "upto").crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))

    def at(k: int) -> tuple[Column, Column, Column]:
        p = (F.col("total") + 1) * k / 4
        lo = F.greatest(F.lit(1), F.least(F.floor(p), F.col("total") - 1))
        here = lambda r: F.max(F.when((F.col("upto") >= r) & (F.col("upto") - F.col("n") < r), F.col("v")))
        return here(lo), here(lo + 1), F.max(p - lo)

    q1, q3 = at(1), at(3)
    row = placed.agg(*(c.alias(f"{n}{k}") for n, q in (("a", q1), ("b", q3)) for k, c in enumerate(q)), F.max("total").alias("total"))
    value = lambda n: F.when(F.col("total") >= 4, F.col(f"{n}0") + (F.col(f"{n}1") - F.col(f"{n}0")) * F.col(f"{n}2"))
    return row.select(value("a").alias("q1"), value("b").alias("q3"), "total")


def iqr_outliers(df: DataFrame, column: str, multiplier: float = 1.5) -> DataFrame:
    out = df.crossJoin(F.broadcast(exclusive_quartiles(df, column)))
    reach = multiplier * (F.col("q3") - F.col("q1"))
    odd = (F.col(column) < F.col("q1") - reach) | (F.col(column) > F.col("q3") + reach)
    return out.withColumn("is_anomaly", F.coalesce(odd, F.lit(False))).drop("q1", "q3", "total")


def rank_anomalies(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    return zscores(df, column).orderBy(F.col("score").desc(), F.col(column)).limit(top_n)


def against_baseline(df: DataFrame, baseline: DataFrame, column: str, threshold: float = 3.0, multiplier: float = 1.5) -> DataFrame:
    """Adds is_anomaly: outside the baseline by z-score or by quartiles."""
    stats = baseline.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s")).crossJoin(F.broadcast(exclusive_quartiles(baseline, column)))
    out = df.crossJoin(F.broadcast(stats))  # one row
    reach = multiplier * (F.col("q3") - F.col("q1"))
    odd = (F.abs(F.col(column) - F.col("_m")) > threshold * F.col("_s")) | (F.col(column) < F.col("q1") - reach) | (F.col(column) > F.col("q3") + reach)
    return out.withColumn("is_anomaly", F.coalesce(odd, F.lit(False))).select(*df.columns, "is_anomaly")


def baseline_shift(df: DataFrame, baseline: DataFrame, column: str) -> DataFrame:
    """One row: shift of the mean in fifths of the baseline's deviation, at most 1."""
    a = df.agg(F.avg(column).alias("mean"))
    b = baseline.agg(F.avg(column).alias("base_mean"), F.stddev_samp(column).alias("base_std"))
    return a.crossJoin(F.broadcast(b)).withColumn("drift", F.least(F.try_divide(F.abs(F.col("mean") - F.col("base_mean")), F.col("base_std")) / 5, F.lit(1.0)))


def _method(df: DataFrame, column: str, method: str, contamination: float, nu: float) -> DataFrame:
    make = {
        "zscore": lambda: zscores(df, column),
        "modified_zscore": lambda: zscores(df, column, 3.5, True),
        "iqr": lambda: iqr_outliers(df, column),
        "isolation_forest": lambda: isolation_outliers(df, [column], contamination),
        "one_class_svm": lambda: kernel_outliers(df, column, nu),
    }
    return make[method]()


def vote(df: DataFrame, column: str, methods: tuple[str, ...] = ("zscore", "iqr"), least: int = 2, contamination: float = 0.1, nu: float = 0.1) -> DataFrame:
    """Adds votes, the number of methods that find the row anomalous, and is_anomaly: at least ``least`` do."""
    votes, out = F.lit(0), df
    for m in methods:
        out = _method(out, column, m, contamination, nu).withColumnRenamed("is_anomaly", f"_by_{m}").drop("score")
        votes = votes + F.col(f"_by_{m}").cast("int")
    return out.withColumn("votes", votes).withColumn("is_anomaly", F.col("votes") >= least).drop(*(f"_by_{m}" for m in methods))


def multi_method(df: DataFrame, column: str, methods: tuple[str, ...] = ("zscore", "iqr"), contamination: float = 0.1, nu: float = 0.1) -> DataFrame:
    """A row a method: anomalies and rows."""
    parts = [_method(df, column, m, contamination, nu).agg(F.lit(m).alias("method"), F.count_if("is_anomaly").alias("anomalies"), F.count("*").alias("total")) for m in methods]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def isolation_outliers(df: DataFrame, columns: list[str], contamination: float = 0.1, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Adds score and is_anomaly: the ``contamination`` share of rows with the highest isolation scores, within
    a thousandth of it."""
    scored = isolation_scores(df, columns, trees, sample, seed)
    cut = scored.agg(F.percentile_approx("score", 1 - contamination, 1000).alias("_cut"))
    return scored.crossJoin(F.broadcast(cut)).withColumn("is_anomaly", F.coalesce(F.col("score") > F.col("_cut"), F.lit(False))).drop("_cut")


def kernel_outliers(df: DataFrame, column: str, nu: float = 0.1, sample: int = 2000) -> DataFrame:
    """Adds score and is_anomaly by a one-class kernel machine with a Gaussian kernel of a column.

    Its centre is fitted on a bounded sample, the rows with the smallest hashes: the weights that minimise the norm of
    their mean in the kernel's space, none above 1 / (nu * sample).  A row's score is the kernel's mean
    over these weights; rows that score below the ``nu`` quantile of the sample are anomalies.
    """
    import numpy as np

    x = F.col(column).cast("double")
    rows = df.filter(x.isNotNull() & ~F.isnan(x)).select(x.alias("v")).orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    v = np.array([r.v for r in rows], float)
    if len(v) < 2:
        return df.withColumn("score", F.lit(None).cast("double")).withColumn("is_anomaly", F.lit(False))
    gamma = 1 / max(float(v.var()), 1e-12)
    most = 1 / (nu * len(v))
    w = np.full(len(v), 1 / len(v))
    k = np.exp(-gamma * (v[:, None] - v[None]) ** 2)
    for step in range(200):  # projected gradient steps on the capped simplex
        w = w - (k @ w) / (np.sqrt(step + 1) * len(v))
        low, high = w.min() - most, w.max()
        for _ in range(60):
            shift = (low + high) / 2
            low, high = (shift, high) if np.clip(w - shift, 0, most).sum() > 1 else (low, shift)
        w = np.clip(w - (low + high) / 2, 0, most)
    edge = float(np.quantile(k @ w, nu))
    bins = np.round((v - v.min()) / max(float(np.ptp(v)), 1e-12) * 200).astype(int)  # points of the centre that lie close are one
    weights = np.bincount(bins, w)
    points = np.bincount(bins, w * v) / np.maximum(weights, 1e-300)
    centre = F.array(*(F.struct(F.lit(float(points[i])).alias("v"), F.lit(float(weights[i])).alias("w")) for i in np.flatnonzero(weights > 1e-9)))
    score = F.aggregate(centre, F.lit(0.0), lambda t, c: t + c["w"] * F.exp(-gamma * F.pow(x - c["v"], 2)))
    out = df.withColumn("score", F.when(x.isNotNull(), score))
    return out.withColumn("is_anomaly", F.coalesce(F.col("score") < edge - 1e-6, F.lit(False)))


def isolation_scores(df: DataFrame, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Adds score: an isolation forest's, near 1 for rows that few random cuts set apart.

    Trees are grown on the driver from a bounded sample of rows and applied to all rows in Arrow batches.
    """
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    rows = df.dropna(subset=columns).select(*(F.col(c).cast("double") for c in columns)).orderBy(F.xxhash64(*columns)).limit(trees * sample // 4).collect()
    data = np.array(rows, float).reshape(-1, len(columns))
    size = min(sample, len(data))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    harmonic = lambda n: 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(x: np.ndarray, d: int):
        if d >= depth or len(x) <= 1 or not (spread := np.flatnonzero(x.max(axis=0) > x.min(axis=0))).size:
            return d + harmonic(len(x))
        k = int(rng.choice(spread))
        cut = rng.uniform(x[:, k].min(), x[:, k].max())
        return k, cut, grow(x[x[:, k] < cut], d + 1), grow(x[x[:, k] >= cut], d + 1)

    forest = [grow(data[rng.choice(len(data), size, replace=False)], 0) for _ in range(trees if len(data) else 0)]

    def path(tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        k, cut, a, b = tree
        left, out = x[:, k] < cut, np.empty(len(x))
        out[left], out[~left] = path(a, x[left]), path(b, x[~left])
        return out

    def score(batches):
        at = None
        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in columns]
            x = np.stack([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in at], axis=1) if batch.num_rows else np.empty((0, len(columns)))
            known = ~np.isnan(x).any(axis=1)
            s = np.full(len(x), np.nan)
            if forest and known.any():
                s[known] = 2 ** (-np.mean([path(t, x[known]) for t in forest], axis=0) / max(harmonic(size), 1e-9))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64(), mask=np.isnan(s))], names=[*batch.schema.names, "score"])

    from pyspark.sql import types as T

    return df.mapInArrow(score, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))
