"""Literal rows for what documentation and habit disagree on."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import predicates as P
from millrace.functions.expressions import ExpressionError
from millrace.operators import aggregates as A
from millrace.operators import cleaning, joins, ranges, reshape, rows, windows


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def customers(spark):
    return spark.createDataFrame([(1, "Alice", "North"), (2, "Bob", "South"), (3, "Charlie", "North")], "customer_id long, name string, region string")


@pytest.fixture
def orders(spark):
    return spark.createDataFrame([(101, 1, 100.0), (102, 1, 150.0), (103, 2, 200.0)], "order_id long, customer_id long, amount double")


def test_left_join_pads_and_empty_side_too(customers, orders):
    out = joins.join(customers, orders, "customer_id", "left").orderBy("customer_id", "order_id")
    assert [(r.customer_id, r.order_id) for r in out.collect()] == [(1, 101), (1, 102), (2, 103), (3, None)]
    assert [r.order_id for r in joins.join(customers, orders.limit(0), "customer_id", "left").collect()] == [None] * 3


def test_full_join_fills_the_key(spark, customers):
    other = spark.createDataFrame([(3, "x"), (4, "y")], "customer_id long, name string")
    out = joins.join(customers, other, "customer_id", "full").orderBy("customer_id")
    assert out.columns == ["customer_id", "name_x", "region", "name_y"]
    assert [r.customer_id for r in out.collect()] == [1, 2, 3, 4]


def test_null_keys_match_only_if_asked(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("k", 4)], "k string, b int")
    assert joins.join(a, b, "k").count() == 1
    assert joins.join(a, b, "k", null_safe=True).count() == 2
    with pytest.raises(ValueError):
        joins.join(a, b, "absent")


def test_upsert_keeps_rows_without_key_and_takes_the_last(spark):
    old = spark.createDataFrame([(1, "a", 0), (None, "n", 0), (2, "b", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "m", 1), (3, "z", 1)], "k int, v string, at int")
    assert sorted((r.k or 0, r.v) for r in joins.upsert(old, new, "k", "at").collect()) == [(0, "m"), (0, "n"), (1, "y"), (2, "b"), (3, "z")]
    assert joins.upsert(old, new.limit(0), "k").count() == 3


def test_group_by_drops_null_keys_and_sums_nulls_to_0(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 5.0)], "k string, v double")
    assert values(A.group_by(df, "k", [A.Sum("v"), A.Count("v")])) == [("a", 0.0, 0)]
    assert A.group_by(df, "k", [A.Sum("v")], keep_null_keys=True).count() == 2
    with pytest.raises(ValueError):
        A.group_by(df, "absent", [])


def test_rollup_subtotals_add_up(spark):
    df = spark.createDataFrame([("A", "P1", 100), ("A", "P2", 150), ("B", "P1", 200), ("B", "P2", 250)], "c string, p string, v long")
    out = {(r.c, r.p): r.s for r in A.rollup(df, ["c", "p"], [A.Sum("v", "s")]).collect()}
    assert out[("A", None)] == 250 and out[("B", None)] == 450 and out[(None, None)] == 700 and len(out) == 7
    assert A.cube(df, ["c", "p"], [A.Sum("v", "s")]).count() == 9


def test_ranks_share_ties_and_lag_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 10), (2, 10), (3, None), (4, 20)], "i int, v int")
    out = windows.window(df, {"r": windows.window_function("rank"), "d": windows.window_function("dense_rank")}, order_by=["v"])
    assert sorted((r.i, r.r, r.d) for r in out.collect()) == [(1, 1, 1), (2, 1, 1), (3, 4, 3), (4, 3, 2)]
    lag = windows.window(df, {"p": windows.window_function("lag", "v", 1, -1)}, order_by=["i"])
    assert [r.p for r in lag.orderBy("i").collect()] == [-1, 10, 10, None]


def test_unpivot_undoes_pivot(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "x", 3.0)], "k int, c string, v double")
    wide = reshape.pivot(df, "k", "c", "v", "sum", fill_value=0.0)
    assert values(wide.orderBy("k")) == [(1, 1.0, 2.0), (2, 3.0, 0.0)]
    back = reshape.unpivot(wide, "k", var_name="c", value_name="v").filter("v <> 0").orderBy("k", "c")
    assert values(back) == values(df.orderBy("k", "c"))


def test_predicates_never_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, s string")
    ids = lambda step: [r.i for r in df.transform(step).orderBy("i").collect()]
    assert ids(rows.filter_by_field("s", None)) == [2]
    assert ids(rows.filter_by_field("s", "a", "ne")) == [2, 3]
    assert ids(rows.filter_by_field("s", ["a"], "not_in")) == [2, 3]
    assert ids(rows.filter_by_field("s", "a", "gt")) == [3]
    with pytest.raises(ValueError):
        rows.predicate("s", 1, "like")


def test_casts_and_expressions_fail_to_null(spark):
    df = spark.createDataFrame([("7", 0), ("x", 2), (None, 3)], "s string, n int")
    assert [r.s for r in df.transform(rows.cast_field("s", "int", -1)).collect()] == [7, -1, -1]
    out = df.transform(rows.compute_field_from_expression("q", "10 / n if n is not None else 0"))
    assert [r.q for r in out.collect()][:2] == [None, 5.0]
    for bad in ("__import__('os')", "unknown + 1", "n +", "(lambda: 1)()", "n.__class__()"):
        with pytest.raises(ExpressionError):
            rows.compute_field_from_expression("q", bad)(df)


def test_lookup_and_remap(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    lk = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 9, 1)], "k string, v int, at int")
    out = df.transform(rows.enrich_from_lookup(lk, "k", "k", ["v"], "l_", "at"))
    assert sorted(values(out), key=str) == [("a", 2), ("b", None), (None, None)]
    assert [r.k for r in df.transform(rows.map_field("k", {"a": "A"})).collect()] == ["A", "b", None]
    assert [r.k for r in df.transform(rows.map_field("k", {"a": "A"}, "?")).collect()] == ["A", "?", "?"]
    assert df.transform(rows.rename_fields({"k": "z"})).columns == ["z"]


def test_fills_keep_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 10.0, "x"), (3, None, "x"), (4, 40.0, "x"), (5, None, "x")], "i int, v double, o string")
    fill = lambda s: [r.v for r in cleaning.handle_nulls(df, s, columns=["v"], order_by=["i"]).orderBy("i").collect()]
    assert fill("fill_forward") == [10.0, 10.0, 10.0, 40.0, 40.0]
    assert fill("fill_backward") == [10.0, 10.0, 40.0, 40.0, 40.0]
    assert fill("interpolate") == [None, 10.0, 25.0, 40.0, 40.0]
    assert fill("fill_mean") == [25.0, 10.0, 25.0, 40.0, 25.0]
    assert cleaning.handle_nulls(df, "fill_mean", columns=["v"]).columns == df.columns
    with pytest.raises(ValueError):
        cleaning.handle_nulls(df, "fill_forward", columns=["v"])


def test_mode_takes_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert sorted(r.s for r in cleaning.handle_nulls(df, "fill_mode").collect()) == ["a", "a", "a", "b", "b"]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "i int, s string")
    keep = lambda k: sorted(r.i for r in cleaning.remove_duplicates(df, ["s"], k, ["i"]).collect())
    assert (keep("first"), keep("last"), keep("none")) == ([1, 3], [2, 4], [])


def test_outliers_use_the_methods_own_bounds(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(1, 20), 1000]], "v double")
    top = lambda m, th: cleaning.handle_outliers(df, m, "cap", th).agg(F.max("v")).first()[0]
    assert top("iqr", 1.5) < 50 and top("zscore", 2.0) > 300
    assert cleaning.handle_outliers(df, "iqr", "drop").count() == 19
    assert cleaning.detect_outliers(df, "modified_zscore", 3.5).filter("v_is_outlier").count() == 1


def test_text(spark):
    df = spark.createDataFrame([("\t o'neil-smith  ", 1), (None, 2)], "s string, i int")
    assert cleaning.clean_text(df, case="title").first().s == "O'Neil-Smith"
    assert cleaning.clean_text(spark.createDataFrame([("ﬁ",)], "s string"), normalize=True).first().s == "fi"
    assert cleaning.normalize_types(df, {"s": "int"}).first().s is None
    assert dict(cleaning.infer_types(spark.createDataFrame([("1", "1.5", "x")], "a string, b string, c string")).dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    emails = spark.createDataFrame([("a@b.c",), ("a.b@c",), ("ab",)], "e string")
    assert [r[0] for r in emails.select(P.is_email(F.col("e"))).collect()] == [True, False, False]


def test_constant_column_has_no_score(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    for m in ("zscore", "minmax", "robust"):
        assert [r.v for r in cleaning.standardize_columns(df, ["v"], m).collect()] == [None, None]


def nearest(spark, strategy):
    rows_ = [("a", i, float(i) if i % 4 == 1 else None) for i in range(8)] + [("b", 0, None), ("b", 1, None), ("b", 2, 7.0)]
    df = spark.createDataFrame(rows_, "g string, i int, v double")
    out = cleaning.handle_nulls(df, strategy, columns=["v"], order_by=["i"], partition_by=["g"])
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()  # goes over the group again for each row
    assert out.columns == df.columns
    return [r.v for r in out.orderBy("g", "i").collect()]


def test_interpolation_goes_over_a_group_once(spark):
    assert nearest(spark, "interpolate") == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 5.0, 5.0, None, None, 7.0]


def test_backward_fill_goes_over_a_group_once(spark):
    assert nearest(spark, "fill_backward") == [1.0, 1.0, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 7.0, 7.0, 7.0]


def test_forward_fill_goes_over_a_group_once(spark):
    assert nearest(spark, "fill_forward") == [1.0, 1.0, 1.0, 1.0, 1.0, 5.0, 5.0, 5.0, 7.0, 7.0, 7.0]


def test_quantiles_are_exact_and_no_task_sees_all_values(spark):
    n, nan = 20_001, float("nan")
    df = spark.range(n).select(((F.col("id") * 7919 % n) / 3).alias("v"), F.when(F.col("id") % 5 != 0, (F.col("id") % 3).cast("int")).alias("few"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") < 9000, nan).otherwise(F.col("id")).alias("odd"))
    shares = [0.0, 0.0001, 0.25, 1 / 3, 0.5, 0.75, 0.9999, 1.0]
    wanted = {f"{c}{k}": (c, p) for c in df.columns for k, p in enumerate(shares)}
    for d in (df, df.limit(0), df.limit(1), df.limit(2), df.limit(7)):
        d = d.localCheckpoint()
        want = d.agg(*(F.percentile(c, p).alias(x) for x, (c, p) in wanted.items())).first()
        got = ranges.quantiles(d, wanted).first()
        assert [str(x) for x in got] == [str(x) for x in want]
    plan = cleaning.handle_outliers(df, "iqr", "cap", columns=["v"])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile(" not in plan  # brings the distinct values of all tasks to one
    near = ranges.quantiles(df, {"a": ("v", 0.25), "b": ("v", 0.5)})
    assert near.first() == (n // 4 / 3, n // 2 / 3)


def test_quantiles_do_not_rely_on_the_sketch(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    for wrong in ([-5.0, 3.0], [990.0, 2000.0], [3.0, 3.0]):
        monkeypatch.setattr(ranges.F, "percentile_approx", lambda *_, ends=wrong: F.max(F.array(*map(F.lit, ends))))
        assert ranges.quantiles(df, {"m": ("v", 0.5)}).first().m == 499.5
