import math

import pytest
from pyspark.sql import functions as F

from millrace.plans import rules
from millrace.quality import anomaly, drift, metrics
from millrace.quality import checks as C


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0), (3, "", 10.0)], "i int, s string, v double")


def test_suite_shares_one_aggregation(df):
    suite = C.Suite("s", [C.mean_between("v", 3, 5), C.not_null("s"), C.not_null("s", True), C.unique("i"), C.values_between("v", 0, 5), C.increasing("v", ["v"], True), C.std_dev_between("v", 0, 1), C.row_count_equals(4), C.sums_equal("v", "v"), C.pair_equal("i", "i"), C.group_sizes_between("i", 1, 1), C.lengths_between("s", 0, 1), C.median_between("v", 2.5, 2.5), C.null_share_between("s", 0.25, 0.25)])
    got = suite.run(df)
    assert [r.passed for r in got.results] == [True, False, False, False, False, True, False, True, True, True, False, True, True, True]
    assert {r.name: r.failed_rows for r in got.failures}["i: unique"] == 2 and not got.passed
    assert suite.plan(df)._jdf.queryExecution().toString().count("Aggregate") <= 8  # one aggregation in each of the plan's forms


def test_fused_equals_single(df):
    checks = [C.values_in_set("s", ["a", "b"]), C.match_regex("s", "[ab]", 0.5), C.not_match_regex("s", "z"), C.values_not_in_set("s", ["a", None]), C.max_between("v", 0, 9), C.no_anomalies_zscore("v", 1.4), C.date_parseable("s"), C.of_type("s", "int"), C.pair_greater("v", "i", True), C.group_means_between("v", "i", 0, 5)]
    together = C.Suite("a", checks).run(df).results
    assert [(r.passed, r.failed_rows) for r in together] == [(r.passed, r.failed_rows) for c in checks for r in C.Suite("b", [c]).run(df).results]


def test_strategies(df):
    bad, good = C.values_between("v", 0, 1), C.not_null("v")
    assert len(C.Suite("s", [bad, good], "fail_fast").run(df).results) == 1
    warn = rules.checks_of([{"type": "range", "column": "v", "min": 0, "max": 1, "severity": "warning"}])
    assert C.Suite("s", warn, "continue_on_warning").run(df).passed
    assert not C.Suite("s", [C.mean_between("absent", 0, 1)]).strategy == "x"
    with pytest.raises(C.ValidationError):
        C.validate(C.Suite("s", [bad]))(lambda: df)()


def test_records(df):
    out = C.validate_records(df, {"s": {"nullable": False, "min_length": 1}, "i": {"enum": [1, 2]}, "z": {"required": True}})
    assert [r.errors for r in out.orderBy("v").collect()] == [["z: missing"], ["z: missing"], ["s: null", "i: enum", "z: missing"], ["s: min_length", "i: enum", "z: missing"]]
    good, bad = C.split_valid(df, {"i": {"max_value": 2}})
    assert (good.count(), bad.count()) == (2, 2)


def test_metrics(df, spark):
    assert metrics.validity(df, {"i": {"max_value": 2}}).first().valid == 2
    assert metrics.once_share(df, "i").first().once == 2
    assert metrics.consistency(df, "v", "i", "greater_than").first().consistency == 0.25
    p = {r.column_name: r for r in metrics.profile(df).collect()}
    assert p["s"].null_count == 1 and p["s"].distinct_count == 3 and p["v"].median == 2.5 and p["i"].max_value == "3"
    score = metrics.quality_score(df, {"i": {"max_value": 2}}, ["i"])
    assert score.parts["validity"] == 50 and metrics.alerts(score)
    h = spark.createDataFrame([(1, 50.0), (2, 60.0), (3, 70.0)], "at int, score double")
    assert metrics.history_trend(h).first().trend == "improving"


def test_anomalies(spark):
    one = spark.createDataFrame([(float(x),) for x in [*range(1, 12), 100]], "v double")
    q = anomaly.exclusive_quartiles(one, "v").first()
    assert (q.q1, q.q3) == (3.25, 9.75)
    assert [r.v for r in anomaly.iqr_outliers(one, "v").filter("is_anomaly").collect()] == [100.0]
    assert anomaly.zscores(one, "v", 3.5, True).filter("is_anomaly").count() == 1
    assert anomaly.rank_anomalies(one, "v", 1).first().v == 100.0
    assert anomaly.against_baseline(one, one.filter("v < 50"), "v").filter("is_anomaly").count() == 1
    assert {r.method: r.anomalies for r in anomaly.multi_method(one, "v").collect()}["iqr"] == 1
    assert anomaly.isolation_scores(one, ["v"], 50, 12).orderBy(F.desc("score")).first().v == 100.0
    assert anomaly.exclusive_quartiles(one.limit(3), "v").first().q1 is None


def test_drift(spark):
    a = spark.range(1000).selectExpr("CAST(id AS DOUBLE) v", "id % 3 c")
    b = spark.range(1000).selectExpr("CAST(id + 500 AS DOUBLE) v", "0 c")
    assert drift.ks_statistic(a, a, "v").first().statistic == 0
    assert drift.ks_statistic(a, b, "v").first().statistic == 0.5
    assert drift.ks_p_value(0.5, 1000, 1000) < 1e-6 and drift.ks_p_value(0.0, 10, 10) == 1
    assert drift.psi(a, a, "v").first().psi == 0 and drift.psi(a, b, "v").first().psi > 0.25
    assert drift.psi(a, a, "v", formula="chi").first().psi == 0
    x = drift.chi_square(a, b, "c").first()
    assert x.df == 2 and drift.chi_square_p_value(x.statistic, x.df) < 1e-6
    assert math.isclose(drift.chi_square_p_value(3.841458820694124, 1), 0.05, rel_tol=1e-6)
    assert drift.drift_report(a, b, ["v"])["v_psi"]["drifted"]


def test_rules(df):
    made = rules.checks_of([{"type": "not_null", "column": "s", "max_nulls": 1}, {"type": "duplicate_values", "column": "i", "max_percent": 10}, {"type": "missing_values", "column": "s", "max_percent": 30}, {"type": "schema", "columns": {"i": "int"}}, {"type": "regex", "column": "s", "pattern": "[ab]", "mostly": 0.6}])
    got = C.Suite("r", made).run(df)
    assert [r.passed for r in got.results] == [True, False, True, True, True]
    assert "FAILED" in rules.report_text(rules.merge_results([got]))
    with pytest.raises(ValueError):
        rules.checks_of([{"type": "unknown"}])


def test_medians_without_one_task_that_sees_all_values(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 10.0)], "i int, `v.x` double")
    p = metrics.profile(df)
    assert {r.column_name: r.median for r in p.collect()} == {"i": 2.5, "v.x": 2.0}
    z = anomaly.zscores(df, "i", 3.5, True)
    assert [round(r.score, 4) for r in z.orderBy("i").collect()] == [1.0117, 0.3372, 0.3372, 1.0117]
    for d in (p, z):
        plan = d._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "median(" not in plan and "percentile(" not in plan
    assert not C.median_between("i", 1, 4).aggregates
