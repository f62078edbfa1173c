"""Histories of validation runs and of baselines, as tables."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.quality.checks import SuiteResult
from millrace.sources.materialize import Store

SCHEMA = "run_id string, asset string, at timestamp, suite_passed boolean, check_name string, passed boolean, severity string, failed_rows long, total_rows long, message string"


class History:
    """A row a check and run, appended to a stored table."""

    def __init__(self, store: Store, name: str = "validation_history"):
        self.store, self.name = store, name

    def record(self, result: SuiteResult, asset: str, run_id: str, at: datetime) -> None:
        rows = [(run_id, asset, at, result.passed, r.name, r.passed, r.severity, r.failed_rows, r.total_rows, r.message) for r in result.results]
        self.store.append(self.name, self.store.spark.createDataFrame(rows, SCHEMA))

    def table(self) -> DataFrame:
        return self.store.load(self.name) if self.store.exists(self.name) else self.store.spark.createDataFrame([], SCHEMA)

    def runs(self, asset: str) -> DataFrame:
        """A row a run: run_id, at, pass_rate, failed."""
        return self.table().filter(F.col("asset") == asset).groupBy("run_id").agg(F.min("at").alias("at"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.count_if(~F.col("passed")).alias("failed"))

    def trend(self, asset: str, flat: float = 0.01) -> DataFrame:
        """One row: least-squares slope of the pass rate by run, fit as confidence, and the trend's name."""
        placed = self.runs(asset).withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")).cast("double"))
        out = placed.agg(F.regr_slope("pass_rate", "i").alias("slope"), F.regr_r2("pass_rate", "i").alias("confidence"), F.count("*").alias("runs"))
        return out.withColumn("trend", F.when(F.col("slope") > flat, "improving").when(F.col("slope") < -flat, "declining").otherwise("stable"))

    def recurring_failures(self, asset: str, least: int = 3) -> DataFrame:
        return self.table().filter((F.col("asset") == asset) & ~F.col("passed")).groupBy("check_name").agg(F.count("*").alias("failures"), F.max("at").alias("last")).filter(F.col("failures") >= least)

    def against_baseline(self, asset: str, last: int = 10, warn: float = 0.1, fail: float = 0.2) -> DataFrame:
        """One row: the newest pass rate, the mean of up to ``last`` runs before it, and ok, warning or critical."""
        placed = self.runs(asset).withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("at").desc())))
        out = placed.agg(F.max(F.when(F.col("i") == 1, F.col("pass_rate"))).alias("newest"), F.avg(F.when((F.col("i") > 1) & (F.col("i") <= last + 1), F.col("pass_rate"))).alias("baseline"))
        drop = F.try_divide(F.col("baseline") - F.col("newest"), F.col("baseline"))
        return out.withColumn("status", F.when(drop > fail, "critical").when(drop > warn, "warning").otherwise("ok"))

    def summary(self) -> DataFrame:
        return self.table().groupBy("asset").agg(F.count_distinct("run_id").alias("runs"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))


class Baselines:
    """Named baseline tables for drift checks, and the drift found over time."""

    def __init__(self, store: Store):
        self.store = store

    def save(self, name: str, df: DataFrame, columns: list[str]) -> None:
        self.store.replace(f"baseline_{name}", df.select(*columns))

    def load(self, name: str) -> DataFrame:
        return self.store.load(f"baseline_{name}")

    def note(self, name: str, report: dict[str, dict[str, Any]], at: datetime) -> None:
        rows = [(name, k, at, float(v.get("statistic") or 0.0), bool(v["drifted"])) for k, v in report.items()]
        self.store.append("drift_history", self.store.spark.createDataFrame(rows, "baseline string, measure string, at timestamp, statistic double, drifted boolean"))

    def trend(self, name: str) -> DataFrame:
        """A row a measure: mean of the newest three against the mean of those before."""
        w = Window.partitionBy("measure").orderBy(F.col("at").desc())
        h = self.store.load("drift_history").filter(F.col("baseline") == name).withColumn("k", F.row_number().over(w))
        out = h.groupBy("measure").agg(F.avg(F.when(F.col("k") <= 3, F.col("statistic"))).alias("recent"), F.avg(F.when(F.col("k") > 3, F.col("statistic"))).alias("earlier"))
        ratio = F.try_divide(F.col("recent") - F.col("earlier"), F.col("earlier"))
        return out.withColumn("trend", F.when(ratio > 0.2, "increasing").when(ratio < -0.2, "decreasing").otherwise("stable"))
