"""Registered queries over checks, rule sets, cleaning, quality, outliers, drift, schemas, sinks and
user-defined functions, with rows that pass and rows that fail."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schema as S
from millrace import streaming
from millrace.functions import predicates as P
from millrace.functions import user
from millrace.operators import aggregates as A
from millrace.operators import cleaning, joins, reshape, rows, windows
from millrace.plans import config as pipeline_config
from millrace.plans import rules
from millrace.plans.builder import transform
from millrace.plans.registry import query, scratch, t
from millrace.plans.registry import rounded as _r
from millrace.quality import anomaly, checks, drift, metrics
from millrace.quality.expectations import all_of, any_of, expect, negated
from millrace.sources.databases import QueryBuilder
from millrace.sources.files import read_file, write_file
from millrace.sources.materialize import Store


def outcomes(spark: SparkSession, df: DataFrame, named: dict[str, checks.Check], strategy: str = "collect_all") -> DataFrame:
    """name, passed and failed_rows of checks."""
    suite = checks.Suite("queries", [replace(c, name=n) for n, c in named.items()], strategy)
    return spark.createDataFrame([(r.name, r.passed, r.failed_rows) for r in suite.run(df).results], "name string, passed boolean, failed_rows long")


def _sql(table: str, cases: dict[str, tuple[str, str]]) -> str:
    """The same by SQL: an expression for passed and one for failed_rows."""
    return " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({p} AS BOOLEAN) AS passed, CAST({f} AS BIGINT) AS failed_rows FROM {table}" for n, (p, f) in cases.items())


def _bad(condition: str) -> tuple[str, str]:
    return f"count(*) FILTER (WHERE {condition}) = 0", f"count(*) FILTER (WHERE {condition})"


# checks

_SOME = "(SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders)"


def _some(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").withColumn("price", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))


@query(
    _sql(
        _SOME,
        {
            "mean": ("avg(price) BETWEEN 0 AND 1000000", "0"),
            "mean low": ("avg(price) BETWEEN 0 AND 10", "0"),
            "deviation": ("stddev_samp(price) BETWEEN 1 AND 1000000", "0"),
            "deviation low": ("stddev_samp(price) BETWEEN 0 AND 1", "0"),
            "min": ("min(price) BETWEEN 0 AND 1000000", "0"),
            "min high": ("min(price) BETWEEN 900000 AND 1000000", "0"),
            "max": ("max(price) BETWEEN 0 AND 1000000", "0"),
            "max low": ("max(price) BETWEEN 0 AND 10", "0"),
            "median": ("median(price) BETWEEN 1 AND 1000000", "0"),
            "median low": ("median(price) BETWEEN 0 AND 1", "0"),
            "nulls": ("1 - count(price) / count(*) BETWEEN 0 AND 0.2", "0"),
            "nulls few": ("1 - count(price) / count(*) BETWEEN 0 AND 0.1", "0"),
            "rows": ("count(*) BETWEEN 1 AND 100000000", "0"),
            "rows few": ("count(*) BETWEEN 1 AND 5", "0"),
            "rows equal": ("count(*) = 3", "0"),
        },
    )
)
def check_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = checks
    return outcomes(
        spark,
        _some(spark, d),
        {
            "mean": c.mean_between("price", 0, 1000000),
            "mean low": c.mean_between("price", 0, 10),
            "deviation": c.std_dev_between("price", 1, 1000000),
            "deviation low": c.std_dev_between("price", 0, 1),
            "min": c.min_between("price", 0, 1000000),
            "min high": c.min_between("price", 900000, 1000000),
            "max": c.max_between("price", 0, 1000000),
            "max low": c.max_between("price", 0, 10),
            "median": c.median_between("price", 1, 1000000),
            "median low": c.median_between("price", 0, 1),
            "nulls": c.null_share_between("price", 0, 0.2),
            "nulls few": c.null_share_between("price", 0, 0.1),
            "rows": c.row_count_between(1, 100000000),
            "rows few": c.row_count_between(1, 5),
            "rows equal": c.row_count_equals(3),
        },
    )


_TEXTS = "(SELECT *, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 9 = 0 THEN 'soon' ELSE '2024-03-05' END AS day, CASE WHEN c_custkey % 4 = 0 THEN 'x1' ELSE CAST(c_custkey AS VARCHAR) END AS code FROM customer)"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    seg = F.when(k % 5 == 0, None).when(k % 11 == 0, "").otherwise(F.col("c_mktsegment"))
    return t(spark, d, "customer").withColumns({"seg": seg, "day": F.when(k % 9 == 0, "soon").otherwise("2024-03-05"), "code": F.when(k % 4 == 0, "x1").otherwise(k.cast("string"))})


@query(
    _sql(
        _TEXTS,
        {
            "pattern absent": _bad("regexp_matches(seg, '^(QQ)')"),
            "pattern there": _bad("regexp_matches(seg, '^(BUILD|MACH)')"),
            "not in set": _bad("seg IN ('NOWHERE')"),
            "not in set with null": _bad("seg IN ('BUILDING') OR seg IS NULL"),
            "in set": _bad("seg NOT IN ('BUILDING', 'MACHINERY', '')"),
            "whole numbers": _bad("TRY_CAST(code AS BIGINT) IS NULL"),
            "numbers": _bad("c_acctbal IS NULL"),
            "not null": _bad("seg IS NULL OR seg = ''"),
            "not null but empty": _bad("seg IS NULL"),
            "lengths": _bad("length(seg) NOT BETWEEN 0 AND 100"),
            "lengths short": _bad("length(seg) NOT BETWEEN 1 AND 8"),
            "dates": _bad("day = 'soon'"),
            "between": _bad("c_acctbal NOT BETWEEN 0 AND 5000"),
            "condition": _bad("NOT coalesce(length(seg) > 0, false)"),
            "e-mail": _bad("NOT coalesce(contains(seg, '@'), false)"),
        },
    )
)
def check_values(spark: SparkSession, d: str) -> DataFrame:
    c = checks
    return outcomes(
        spark,
        _texts(spark, d),
        {
            "pattern absent": c.not_match_regex("seg", "QQ"),
            "pattern there": c.not_match_regex("seg", "BUILD|MACH"),
            "not in set": c.values_not_in_set("seg", ["NOWHERE"]),
            "not in set with null": c.values_not_in_set("seg", ["BUILDING", None]),
            "in set": c.values_in_set("seg", ["BUILDING", "MACHINERY", ""]),
            "whole numbers": c.of_type("code", "bigint"),
            "numbers": c.of_type("c_acctbal", "double"),
            "not null": c.not_null("seg"),
            "not null but empty": c.not_null("seg", allow_empty=True),
            "lengths": c.lengths_between("seg", 0, 100),
            "lengths short": c.lengths_between("seg", 1, 8),
            "dates": c.date_parseable("day"),
            "between": c.values_between("c_acctbal", 0, 5000),
            "condition": c.record_filter(P.has_length(F.col("seg"), 1)),
            "e-mail": c.record_filter(P.is_email(F.col("seg"))),
        },
    )


@query(
    _sql(
        "lineitem",
        {
            "equal": _bad("l_quantity IS DISTINCT FROM l_quantity + 0"),
            "equal fails": _bad("l_discount IS DISTINCT FROM l_tax"),
            "differ": _bad("l_discount IS NOT DISTINCT FROM l_tax"),
            "greater": _bad("NOT l_extendedprice > l_quantity"),
            "greater fails": _bad("NOT l_discount > l_tax"),
            "greater or equal": _bad("NOT l_discount >= l_tax"),
            "sums": ("abs(sum(l_quantity) - sum(l_quantity)) <= 0", "0"),
            "sums fail": ("abs(sum(l_discount) - sum(l_tax)) <= 0.001", "0"),
            "sums near": ("abs(sum(l_discount) - sum(l_tax)) <= 1000000", "0"),
        },
    )
)
def check_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = checks
    df = t(spark, d, "lineitem").withColumn("same", F.col("l_quantity") + 0)
    return outcomes(
        spark,
        df,
        {
            "equal": c.pair_equal("l_quantity", "same"),
            "equal fails": c.pair_equal("l_discount", "l_tax"),
            "differ": c.pair_not_equal("l_discount", "l_tax"),
            "greater": c.pair_greater("l_extendedprice", "l_quantity"),
            "greater fails": c.pair_greater("l_discount", "l_tax"),
            "greater or equal": c.pair_greater("l_discount", "l_tax", True),
            "sums": c.sums_equal("l_quantity", "same"),
            "sums fail": c.sums_equal("l_discount", "l_tax", 0.001),
            "sums near": c.sums_equal("l_discount", "l_tax", 1000000),
        },
    )


@query("""
WITH g AS (SELECT user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY 1),
s AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lag(ts) OVER (ORDER BY event_id) AS q FROM events),
z AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events),
u AS (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)
SELECT 'sizes' AS name, count(*) FILTER (WHERE n NOT BETWEEN 1 AND 3) = 0 AS passed, count(*) FILTER (WHERE n NOT BETWEEN 1 AND 3) AS failed_rows FROM g
UNION ALL SELECT 'sizes wide', count(*) FILTER (WHERE n NOT BETWEEN 1 AND 1000000) = 0, count(*) FILTER (WHERE n NOT BETWEEN 1 AND 1000000) FROM g
UNION ALL SELECT 'means', count(*) FILTER (WHERE m NOT BETWEEN 40 AND 60) = 0, count(*) FILTER (WHERE m NOT BETWEEN 40 AND 60) FROM g
UNION ALL SELECT 'unique', true, 0 FROM z
UNION ALL SELECT 'unique together', coalesce(max(n), 0) <= 1, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM u
UNION ALL SELECT 'increasing', count(*) FILTER (WHERE q > ts) = 0, count(*) FILTER (WHERE q > ts) FROM s
UNION ALL SELECT 'decreasing', count(*) FILTER (WHERE value > p) = 0, count(*) FILTER (WHERE value > p) FROM s
UNION ALL SELECT 'increasing strictly', count(*) FILTER (WHERE p >= value) = 0, count(*) FILTER (WHERE p >= value) FROM s
UNION ALL SELECT 'no outliers', count(*) FILTER (WHERE abs(value - m) > 1.5 * s) = 0, count(*) FILTER (WHERE abs(value - m) > 1.5 * s) FROM events, z
UNION ALL SELECT 'custom', false, 0 FROM z""")
def check_groups(spark: SparkSession, d: str) -> DataFrame:
    c = checks
    return outcomes(
        spark,
        t(spark, d, "events"),
        {
            "sizes": c.group_sizes_between("user_id", 1, 3),
            "sizes wide": c.group_sizes_between("user_id", 1, 1000000),
            "means": c.group_means_between("value", "user_id", 40, 60),
            "unique": c.unique("event_id"),
            "unique together": c.unique(["user_id", "event_type"]),
            "increasing": c.increasing("ts", ["event_id"]),
            "decreasing": c.decreasing("value", ["ts", "event_id"], partition_by=["user_id"]),
            "increasing strictly": c.increasing("value", ["ts", "event_id"], True, ["user_id"]),
            "no outliers": c.no_anomalies_zscore("value", 1.5),
            "custom": c.custom("custom", lambda df: df.filter("event_type = 'nothing'").count() > 0),
        },
    )


@query("""SELECT 'first' AS name, true AS passed, 0 AS failed_rows UNION ALL SELECT 'second', false, CAST(count(*) AS BIGINT) FROM orders WHERE o_totalprice > 1000""")
def check_fail_fast(spark: SparkSession, d: str) -> DataFrame:
    """Nothing is reported after the first failure."""
    c = checks
    return outcomes(spark, t(spark, d, "orders"), {"first": c.not_null("o_orderkey"), "second": c.values_between("o_totalprice", 0, 1000), "third": c.not_null("o_custkey")}, "fail_fast").withColumn("failed_rows", F.col("failed_rows"))


@query("""SELECT 'any' AS name, true AS passed UNION ALL SELECT 'all', false UNION ALL SELECT 'not', true UNION ALL SELECT 'o_orderstatus: in set', false UNION ALL SELECT 'o_totalprice: mean', true UNION ALL SELECT 'o_orderkey: unique', true
UNION ALL SELECT 'o_totalprice greater than o_custkey', (SELECT count(*) FILTER (WHERE NOT o_totalprice > o_custkey) = 0 FROM orders) UNION ALL SELECT 'rows', true""")
def expectation_chain(spark: SparkSession, d: str) -> DataFrame:
    """Fluent expectations, and combinations of checks."""
    a, b = checks.not_null("o_orderkey"), checks.values_in_set("o_orderstatus", ["O"])
    chain = expect("o_orderstatus").to_be_in_set(["O"]) | expect("o_totalprice").to_have_mean_between(0, 1e9) | expect("o_orderkey").to_be_unique() | expect("o_totalprice", "o_custkey").to_be_greater() | expect().to_have_rows_between(1, None)
    suite = chain.suite().add(replace(any_of(a, b), name="any"), replace(all_of(a, b), name="all"), replace(negated(b), name="not"))
    return spark.createDataFrame([(r.name, r.passed) for r in suite.run(t(spark, d, "orders")).results], "name string, passed boolean")


_RULES = [
    {"type": "expect_column_values_to_not_be_null", "column": "price"},
    {"type": "expect_column_values_to_be_unique", "column": "o_custkey"},
    {"type": "expect_column_values_to_match_regex", "column": "o_orderpriority", "regex": "[0-9]"},
    {"type": "expect_column_values_to_be_between", "column": "price", "min_value": 0, "max_value": 100000},
    {"type": "expect_column_values_to_be_in_set", "column": "o_orderstatus", "value_set": ["O", "F"]},
    {"type": "expect_table_row_count_to_be_between", "min_value": 1, "max_value": 10},
    {"type": "missing_values", "column": "price", "max_percent": 20},
    {"type": "duplicate_values", "column": "o_custkey", "max_percent": 1},
    {"type": "freshness", "column": "o_orderdate", "max_age_hours": 1, "as_of": "2030-01-01 00:00:00"},
    {"type": "expect_column_to_exist", "column": "o_orderkey"},
    {"type": "schema", "columns": {"o_orderkey": "bigint", "absent": None}},
]


@query(f"""SELECT * FROM (SELECT unnest(range(11)) AS rule, unnest([count(*) = count(price), count(DISTINCT o_custkey) = count(*), true, count(*) FILTER (WHERE price NOT BETWEEN 0 AND 100000) = 0, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) = 0,
 count(*) BETWEEN 1 AND 10, 1 - count(price) / count(*) <= 0.2, 1 - count(DISTINCT o_custkey) / count(o_custkey) <= 0.01, false, true, false]) AS passed FROM {_SOME})""")
def rule_sets(spark: SparkSession, d: str) -> DataFrame:
    """Rule sets of both shapes, with rules that fail."""
    made = [replace(c, name=str(i)) for i, c in enumerate(rules.checks_of(_RULES))]
    result = rules.merge_results([checks.Suite("a", made[:6]).run(_some(spark, d)), checks.Suite("b", made[6:]).run(_some(spark, d))])
    return spark.createDataFrame([(int(r.name), r.passed) for r in result.results], "rule long, passed boolean")


@query("SELECT o_orderkey, o_orderstatus AS status, c_name, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS price, c_nationkey * 2 AS twice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice <= 100000 ORDER BY o_orderkey LIMIT 40 OFFSET 5")
def configured_steps(spark: SparkSession, d: str) -> DataFrame:
    """Joins, sorting, limits, casts and validation from a configuration."""
    spec = {
        "sources": {n: {"path": f"{d}/{n}.parquet", "format": "parquet"} for n in ("orders", "customer")},
        "assets": {
            "few": {
                "source": "orders",
                "steps": [
                    {"type": "validate", "constraints": {"o_totalprice": {"max_value": 100000}}, "on_failure": "drop"},
                    {"type": "validate", "rules": [{"type": "unique", "column": "o_orderkey"}]},
                    {"type": "join", "with": "customer", "on": ["o_custkey", "c_custkey"], "pair": True},
                    {"type": "compute_field", "field": "twice", "expression": "c_nationkey * 2"},
                    {"type": "compute_field", "field": "price", "expression": "floor(o_totalprice + 0.5)"},
                    {"type": "cast", "field": "price", "to": "bigint"},
                    {"type": "rename", "fields": {"o_orderstatus": "status"}},
                    {"type": "select", "fields": ["o_orderkey", "status", "c_name", "price", "twice"]},
                    {"type": "sort", "by": ["o_orderkey"]},
                    {"type": "limit", "count": 40, "offset": 5},
                ],
            }
        },
    }
    return pipeline_config.run(spark, spec)[0]["few"]


# cleaning

_GAPS = "(SELECT p_partkey, p_brand, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS kind FROM part)"


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return t(spark, d, "part").select(k, "p_brand", F.when(k % 5 != 0, F.col("p_retailprice")).alias("price"), F.when(k % 3 != 0, F.col("p_type")).alias("kind"))


@query(f"SELECT p_partkey, coalesce(kind, 'none') AS kind FROM {_GAPS}")
def fill_default(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.fill_nulls(_gaps(spark, d), "none", ["kind"]).select("p_partkey", "kind")


@query(f"SELECT p_partkey, coalesce(kind, (SELECT kind FROM {_GAPS} WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM {_GAPS}")
def impute_mode(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.handle_nulls(_gaps(spark, d), "fill_mode", columns=["kind"]).select("p_partkey", "kind")


@query(f"""SELECT p_partkey, p_brand, coalesce(first_value(price IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(price IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS price FROM {_GAPS}""")
def impute_backward(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.handle_nulls(_gaps(spark, d), "fill_backward", columns=["price"], order_by=["p_partkey"], partition_by=["p_brand"]).select("p_partkey", "p_brand", "price")


@query(f"""WITH n AS (SELECT *, row_number() OVER w AS i FROM {_GAPS} WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
k AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(price IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
 max(CASE WHEN price IS NOT NULL THEN i END) OVER (PARTITION BY p_brand ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i0, min(CASE WHEN price IS NOT NULL THEN i END) OVER (PARTITION BY p_brand ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM n)
SELECT p_partkey, round(CASE WHEN price IS NOT NULL THEN price WHEN b IS NULL THEN a ELSE a + (b - a) * (i - i0) / (i1 - i0) END, 6) AS price FROM k""")
def impute_interpolated(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.handle_nulls(_gaps(spark, d), "interpolate", columns=["price"], order_by=["p_partkey"], partition_by=["p_brand"]).select("p_partkey", _r("price", 6))


@query(f"SELECT p_partkey, price FROM {_GAPS}")
def keep_nulls(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.handle_nulls(_gaps(spark, d), "keep").select("p_partkey", "price")


@query(f"SELECT p_partkey, kind FROM {_GAPS} WHERE kind IS NOT NULL")
def drop_null_kinds(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.drop_nulls(_gaps(spark, d), ["kind"]).select("p_partkey", "kind")


@query("SELECT max(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.remove_duplicates(t(spark, d, "documents"), ["text"], "last", ["doc_id"]).select("doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text HAVING count(*) = 1")
def dedup_keep_none(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.remove_duplicates(t(spark, d, "documents"), ["text"], "none").select("doc_id")


_B = "(SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, median(l_quantity) AS md, quantile_cont(l_quantity, 0.05) AS p5, quantile_cont(l_quantity, 0.95) AS p95 FROM lineitem)"


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"SELECT l_orderkey, l_linenumber, l_quantity < q1 - 0.3 * (q3 - q1) OR l_quantity > q3 + 0.3 * (q3 - q1) AS l_quantity_is_outlier FROM lineitem, {_B}")
def flag_iqr(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.detect_outliers(_quantities(spark, d), "iqr", 0.3, ["l_quantity"]).drop("l_quantity")


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem, {_B} WHERE NOT abs(l_quantity - m) > 1.2 * s")
def drop_outliers(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.handle_outliers(_quantities(spark, d), "zscore", "drop", 1.2, ["l_quantity"])


@query(f"SELECT l_orderkey, l_linenumber, round(greatest(l_quantity, p5), 6) AS l_quantity FROM lineitem, {_B}")
def floor_outliers(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.handle_outliers(_quantities(spark, d), "percentile", "floor", 5, ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 6))


@query(f"SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity < p5 OR l_quantity > p95 THEN m ELSE l_quantity END, 6) AS l_quantity FROM lineitem, {_B}")
def mean_outliers(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.handle_outliers(_quantities(spark, d), "percentile", "mean_replace", 5, ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 6))


@query(f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_quantity - md) > 0.8 * mad / 0.6745 THEN md ELSE l_quantity END, 6) AS l_quantity FROM lineitem, {_B}, (SELECT median(abs(l_quantity - md)) AS mad FROM lineitem, {_B})""")
def median_outliers(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.handle_outliers(_quantities(spark, d), "modified_zscore", "median_replace", 0.8, ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 6))


@query("SELECT p_partkey, round((p_retailprice - m) / s, 6) AS p_retailprice FROM part, (SELECT median(p_retailprice) AS m, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS s FROM part)")
def standardize_robust(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.standardize_columns(t(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], "robust").withColumn("p_retailprice", F.round("p_retailprice", 6))


@query(f"SELECT c_custkey, TRY_CAST(code AS BIGINT) AS code, CAST(c_acctbal AS VARCHAR) IS NOT NULL AS text_balance FROM {_TEXTS}")
def convert_types(spark: SparkSession, d: str) -> DataFrame:
    out = cleaning.normalize_types(_texts(spark, d), {"code": "bigint", "c_acctbal": "string"})
    return out.select("c_custkey", "code", F.col("c_acctbal").isNotNull().alias("text_balance"))


@query("SELECT 'bigint' AS whole, 'double' AS fraction, 'string' AS text FROM nation LIMIT 1")
def inferred_types(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("whole"), F.concat(F.col("c_custkey"), F.lit(".5")).alias("fraction"), F.col("c_name").alias("text"))
    return spark.createDataFrame([tuple(dict(cleaning.infer_types(df).dtypes).values())], "whole string, fraction string, text string")


@query("SELECT n_nationkey, 'Straße Ǆ ' || upper(n_name[1]) || lower(n_name[2:]) AS n_name FROM nation WHERE n_name NOT LIKE '% %'")
def clean_unicode(spark: SparkSession, d: str) -> DataFrame:
    """NFKC, trimming and capitals."""
    df = t(spark, d, "nation").filter("n_name NOT LIKE '% %'").select("n_nationkey", F.concat(F.lit(" straße Ｄž "), F.lower("n_name"), F.lit(" ")).alias("n_name"))
    out = cleaning.clean_text(df, True, True, "title")
    return out.select("n_nationkey", F.regexp_replace("n_name", "^Straße Dž", "Straße Ǆ").alias("n_name"))


@query(f"SELECT p_partkey, upper(p_brand) AS p_brand, round((coalesce(price, 0) - m) / s, 6) AS price FROM {_GAPS}, (SELECT avg(coalesce(price, 0)) AS m, stddev_samp(coalesce(price, 0)) AS s FROM {_GAPS})")
def clean_everything(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates, nulls, text and scaling by one configuration, through the decorator."""
    config = cleaning.CleaningConfig(null_strategy="fill_default", null_fill_value=0, null_columns=["price"], case="upper", text_columns=["p_brand"], trim=True, standardize="zscore", standardize_columns=["price"])

    @cleaning.clean_data(config)
    def table() -> DataFrame:
        df = _gaps(spark, d).select("p_partkey", "p_brand", "price")
        return df.union(df)

    return table().withColumn("price", F.round("price", 6))


@query(f"SELECT 2 * count(*) AS original_count, count(*) AS final_count, 2 * (count(*) - count(price)) AS nulls_before, 0 AS nulls_after, count(*) AS rows_removed FROM {_GAPS}")
def cleaning_report(spark: SparkSession, d: str) -> DataFrame:
    df = _gaps(spark, d).select("p_partkey", "price")
    twice = df.union(df)
    report = cleaning.cleaning_report(twice, cleaning.fill_nulls(cleaning.remove_duplicates(twice), 0, ["price"]))
    return spark.createDataFrame([tuple(report[k] for k in ("original_count", "final_count", "nulls_before", "nulls_after", "rows_removed"))], "original_count long, final_count long, nulls_before long, nulls_after long, rows_removed long")


@query(f"SELECT count(*) AS n, 3 AS columns, count(*) - count(price) AS nulls, 0 AS duplicates FROM {_GAPS}")
def data_profile(spark: SparkSession, d: str) -> DataFrame:
    p = cleaning.data_profile(_gaps(spark, d).select("p_partkey", "p_brand", "price"))
    return spark.createDataFrame([(p["rows"], len(p["columns"]), p["nulls"]["price"], p["duplicate_rows"])], "n long, columns int, nulls long, duplicates long")


# rows, groups and user-defined functions


@query("SELECT o_orderkey, 'web' AS channel FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' AND o_custkey IS NOT NULL")
def filters_and_constants(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "orders").transform(rows.filter_rows("o_totalprice > 1000")).transform(rows.filter_field_equals("o_orderstatus", "F")).transform(rows.filter_field_not_null("o_custkey"))
    return df.transform(rows.add_field("channel", F.lit("web"), "string")).select("o_orderkey", "channel")


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem")
def whole_table_aggregates(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "lineitem")
    return A.aggregate_count(df).select(F.col("count").alias("n")).crossJoin(A.aggregate_sum(df, "l_quantity").select(F.round("sum", 2).alias("total")))


@query("SELECT c_custkey, upper(c_name[1:3]) || '-' || c_nationkey AS tag FROM customer WHERE c_acctbal > 0")
def user_scalar(spark: SparkSession, d: str) -> DataFrame:
    tag = user.scalar(lambda name, nation: f"{name[:3].upper()}-{nation}", "string")
    return t(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", tag("c_name", "c_nationkey").alias("tag"))


@query("SELECT l_returnflag, round(max(l_quantity) - min(l_quantity), 4) AS spread FROM lineitem GROUP BY 1")
def user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A function that is merged from parts of a group, as the groups are large."""
    part = lambda v: {"low": v.min(), "high": v.max()}
    merge = lambda s: float(s["high"].max() - s["low"].min())
    out = user.aggregate_parts(t(spark, d, "lineitem"), "l_returnflag", "l_quantity", part, "low double, high double", merge, "spread", "double")
    return out.select("l_returnflag", _r("spread", 4))


@query("SELECT event_id, round(max(value) OVER w - min(value) OVER w, 6) AS spread FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def user_window(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    spread = user.aggregate(lambda v: float(v.max() - v.min()), "double")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return t(spark, d, "events").select("event_id", F.round(spread("value").over(w), 6).alias("spread"))


@query("SELECT c_nationkey, count(*) AS n, round(max(c_acctbal), 2) AS best FROM customer GROUP BY 1")
def user_group(spark: SparkSession, d: str) -> DataFrame:
    """A function of a group's rows."""
    one = lambda g: {"c_nationkey": int(g["c_nationkey"].iloc[0]), "n": len(g), "best": round(float(g["c_acctbal"].max()), 2)}
    return user.group_apply(t(spark, d, "customer").select("c_nationkey", "c_acctbal"), "c_nationkey", one, "c_nationkey int, n long, best double")


@query("SELECT s_suppkey, s_acctbal * 2 AS doubled FROM supplier WHERE s_acctbal >= 0")
def user_rows(spark: SparkSession, d: str) -> DataFrame:
    """A function of rows that may leave them out."""
    fn = lambda r: {"s_suppkey": r["s_suppkey"], "doubled": r["s_acctbal"] * 2} if r["s_acctbal"] >= 0 else None
    return user.row_function(t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), fn, "s_suppkey long, doubled double")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersection(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).transform(rows.intersection(t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def difference(spark: SparkSession, d: str) -> DataFrame:
    rich = t(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return t(spark, d, "orders").select(F.col("o_custkey").alias("k")).transform(rows.difference(rich))


@query("""SELECT n_regionkey, 'nations' AS measure, CAST(count(*) AS DOUBLE) AS amount FROM nation GROUP BY 1""")
def chained_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Pivot and unpivot in a chain."""
    df = t(spark, d, "nation").withColumn("measure", F.lit("nations")).withColumn("one", F.lit(1.0))
    chain = transform(df).pivot(["n_regionkey"], "measure", "one", "sum", expected=["nations"]).unpivot(["n_regionkey"], ["nations"], var_name="measure", value_name="amount")
    return chain.execute()


@query("SELECT l_returnflag, round(median(l_quantity) FILTER (WHERE l_linestatus = 'F'), 4) AS \"F\", round(median(l_quantity) FILTER (WHERE l_linestatus = 'O'), 4) AS \"O\" FROM lineitem GROUP BY 1")
def pivot_found_values(spark: SparkSession, d: str) -> DataFrame:
    """Columns from the data, with an aggregate given as a function."""
    out = reshape.pivot(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", F.median)
    return out.withColumns({"F": F.round("F", 4), "O": F.round("O", 4)})


@query("SELECT c_nationkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000")
def hinted_join(spark: SparkSession, d: str) -> DataFrame:
    t(spark, d, "orders").createOrReplaceTempView("_hint_orders")
    t(spark, d, "customer").createOrReplaceTempView("_hint_customer")
    a = QueryBuilder("_hint_orders AS o").select("c_nationkey", "o_orderkey").join("_hint_customer AS c", "o_custkey = c_custkey").where("o_totalprice > :least", least=150000).hint("MERGE", "c").run(spark)
    b = joins.join(t(spark, d, "orders"), t(spark, d, "customer"), ("o_custkey", "c_custkey"), hint="shuffle_hash").select("c_nationkey", "o_orderkey")
    return a.intersectAll(b)


@query("SELECT p_partkey, CAST(ntile(4) OVER (ORDER BY p_retailprice, p_partkey) AS BIGINT) AS quarter, round(percent_rank() OVER (ORDER BY p_retailprice), 8) AS share FROM part")
def window_shares(spark: SparkSession, d: str) -> DataFrame:
    df = windows.window(t(spark, d, "part"), {"quarter": windows.window_function("ntile", offset=4)}, None, ["p_retailprice", "p_partkey"])
    df = windows.window(df, {"share": windows.window_function("percent_rank")}, None, ["p_retailprice"])
    return df.select("p_partkey", F.col("quarter").cast("long").alias("quarter"), _r("share", 8))


# quality


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS valid, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS validity FROM (SELECT seg IS NOT NULL AND length(seg) >= 1 AND seg IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND c_acctbal >= 0 AS ok FROM {_TEXTS})")
def validity(spark: SparkSession, d: str) -> DataFrame:
    rules_of = {"seg": {"required": True, "min_length": 1, "enum": ["BUILDING", "MACHINERY", "AUTOMOBILE"]}, "c_acctbal": {"min_value": 0}}
    return metrics.validity(_texts(spark, d), rules_of).select("total", "valid", _r("validity", 6))


@query("SELECT CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (WHERE n = 1) AS once, round(count(*) FILTER (WHERE n = 1) / sum(n), 6) AS uniqueness FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def once_share(spark: SparkSession, d: str) -> DataFrame:
    return metrics.once_share(t(spark, d, "orders"), "o_custkey").select("total", "once", _r("uniqueness", 6))


@query("SELECT count(*) AS pairs, round(avg(CASE WHEN l_discount > l_tax THEN 1.0 ELSE 0.0 END), 6) AS consistency FROM lineitem")
def consistency(spark: SparkSession, d: str) -> DataFrame:
    return metrics.consistency(t(spark, d, "lineitem"), "l_discount", "l_tax", "greater_than").select("pairs", _r("consistency", 6))


@query(f"""WITH p AS (SELECT 100 * (2 + avg(CASE WHEN price IS NOT NULL THEN 1.0 ELSE 0.0 END)) / 3 AS c, 100 * avg(CASE WHEN coalesce(price, 0) <= 1500 THEN 1.0 ELSE 0.0 END) AS v, 100 * count(DISTINCT p_brand) / count(*) AS u FROM {_GAPS})
SELECT round(CAST(0.3 * c + 0.3 * v + 0.2 * u + 20 AS DOUBLE), 2) AS overall, round(CAST(c AS DOUBLE), 2) AS completeness, round(CAST(v AS DOUBLE), 2) AS validity, round(CAST(u AS DOUBLE), 2) AS uniqueness,
 CAST((c < 80)::INT + (v < 80)::INT + (u < 80)::INT + ((0.3 * c + 0.3 * v + 0.2 * u + 20) < 80)::INT AS BIGINT) AS alerts FROM p""")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.quality_score(_gaps(spark, d).select("p_partkey", "p_brand", "price"), {"price": {"max_value": 1500}}, ["p_brand"])
    return spark.createDataFrame([(round(s.overall, 2), *(round(s.parts[k], 2) for k in ("completeness", "validity", "uniqueness")), len(metrics.alerts(s)))], "overall double, completeness double, validity double, uniqueness double, alerts long")


@query(f"""WITH o AS (SELECT count(*) AS n, count(*) FILTER (WHERE n = 1) AS once, sum(n) AS total FROM (SELECT price, count(*) AS n FROM {_GAPS} WHERE price IS NOT NULL GROUP BY 1))
SELECT round(count(price) / count(*), 6) AS completeness, round(count(*) FILTER (WHERE price >= 1000) / count(price), 6) AS validity, round(max(once) / max(total), 6) AS uniqueness,
 round((count(price) / count(*) + count(*) FILTER (WHERE price >= 1000) / count(price) + max(once) / max(total)) / 3, 6) AS score FROM {_GAPS}, o""")
def column_quality(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.column_quality(_gaps(spark, d), "price", {"min_value": 1000})
    return out.select(*(_r(c, 6) for c in ("completeness", "validity", "uniqueness", "score")))


@query(f"""WITH c AS (SELECT seg AS v, count(*) AS n FROM {_TEXTS} GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS null_count, count(v) AS distinct_count, count(*) FILTER (WHERE v IS NOT NULL AND n = 1) AS unique_count,
 arg_min(v, (-n, v)) FILTER (WHERE v IS NOT NULL) AS mode, max(n) FILTER (WHERE v IS NOT NULL) AS mode_count, min(length(v)) AS min_length, max(length(v)) AS max_length,
 (SELECT string_agg(v, ',' ORDER BY n DESC, v) FROM (SELECT * FROM c WHERE v IS NOT NULL ORDER BY n DESC, v LIMIT 3)) AS sample_values FROM c""")
def deep_profile(spark: SparkSession, d: str) -> DataFrame:
    return metrics.column_profile(_texts(spark, d), "seg", 3).drop("percentiles").withColumn("sample_values", F.array_join("sample_values", ","))


@query("WITH s AS (SELECT p_size AS score, p_partkey AS i FROM part WHERE p_partkey <= 60) SELECT round(regr_slope(score, i), 6) AS slope, count(*) AS n, CASE WHEN regr_slope(score, i) > 0.1 THEN 'improving' WHEN regr_slope(score, i) < -0.1 THEN 'declining' ELSE 'stable' END AS trend FROM s")
def quality_trend(spark: SparkSession, d: str) -> DataFrame:
    history = t(spark, d, "part").filter("p_partkey <= 60").select(F.col("p_size").alias("score"), F.col("p_partkey").alias("at"))
    return metrics.history_trend(history).select(_r("slope", 6), "n", "trend")


# outliers and drift

_Z = "(SELECT median(value) AS m FROM events)"
_EX = """(WITH s AS (SELECT value AS v, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events), a AS (SELECT v, i, (n + 1) / 4.0 AS p, 3 * (n + 1) / 4.0 AS q FROM s)
SELECT max(v) FILTER (WHERE i = floor(p)) + (max(v) FILTER (WHERE i = floor(p) + 1) - max(v) FILTER (WHERE i = floor(p))) * max(p - floor(p)) AS q1,
 max(v) FILTER (WHERE i = floor(q)) + (max(v) FILTER (WHERE i = floor(q) + 1) - max(v) FILTER (WHERE i = floor(q))) * max(q - floor(q)) AS q3 FROM a)"""


@query(f"SELECT event_id, round(abs(value - m) / s, 6) AS score, abs(value - m) / s > 1.2 AS is_anomaly FROM events, {_Z}, (SELECT 1.4826 * median(abs(value - m)) AS s FROM events, {_Z})")
def anomaly_modified(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.zscores(t(spark, d, "events"), "value", 1.2, True).select("event_id", _r("score", 6), "is_anomaly")


@query(f"SELECT event_id, value < q1 - 0.2 * (q3 - q1) OR value > q3 + 0.2 * (q3 - q1) AS is_anomaly FROM events, {_EX}")
def anomaly_iqr(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.iqr_outliers(t(spark, d, "events"), "value", 0.2).select("event_id", "is_anomaly")


@query("SELECT event_id, round(abs(value - m) / s, 6) AS score FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) ORDER BY abs(value - m) / s DESC, value LIMIT 5")
def anomaly_ranking(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.rank_anomalies(t(spark, d, "events"), "value", 5).select("event_id", _r("score", 6))


@query(f"SELECT 2 * event_id AS event_id, 1.4 * value < q1 - 0.3 * (q3 - q1) OR 1.4 * value > q3 + 0.3 * (q3 - q1) OR abs(1.4 * value - m) > 1.6 * s AS is_anomaly FROM events, {_EX}, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)")
def anomaly_baseline(spark: SparkSession, d: str) -> DataFrame:
    base = t(spark, d, "events").select("event_id", "value")
    now = base.select((F.col("event_id") * 2).alias("event_id"), (1.4 * F.col("value")).alias("value"))
    return anomaly.against_baseline(now, base, "value", 1.6, 0.3).select("event_id", "is_anomaly")


@query("SELECT round(least(abs(avg(1.4 * value) - avg(value)) / stddev_samp(value) / 5, 1), 8) AS drift FROM events")
def baseline_shift(spark: SparkSession, d: str) -> DataFrame:
    base = t(spark, d, "events").select("value")
    return anomaly.baseline_shift(base.select((1.4 * F.col("value")).alias("value")), base, "value").select(_r("drift", 8))


_HEAVY = "(SELECT event_id, value * value * value AS v FROM events)"


@query(f"""WITH z AS (SELECT avg(v) AS m, stddev_samp(v) AS s, median(v) AS md FROM {_HEAVY}), k AS (SELECT 1.4826 * median(abs(v - md)) AS mad FROM {_HEAVY}, z), q AS {_EX.replace("value AS v", "value * value * value AS v").replace("ORDER BY value", "ORDER BY value * value * value")},
f AS (SELECT abs(v - m) / s > 3 AS a, abs(v - md) / mad > 3.5 AS b, v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) AS c FROM {_HEAVY}, z, k, q)
SELECT 'zscore' AS method, count(*) FILTER (WHERE a) AS anomalies, count(*) AS total FROM f UNION ALL SELECT 'modified_zscore', count(*) FILTER (WHERE b), count(*) FROM f UNION ALL SELECT 'iqr', count(*) FILTER (WHERE c), count(*) FROM f
UNION ALL SELECT 'two of three', count(*) FILTER (WHERE a::INT + b::INT + c::INT >= 2), count(*) FROM f""")
def anomaly_methods(spark: SparkSession, d: str) -> DataFrame:
    """Counts by method, and by vote."""
    df = t(spark, d, "events").select("event_id", (F.col("value") * F.col("value") * F.col("value")).alias("v"))
    names = ("zscore", "modified_zscore", "iqr")
    voted = anomaly.vote(df, "v", names).agg(F.lit("two of three").alias("method"), F.count_if("is_anomaly").alias("anomalies"), F.count("*").alias("total"))
    return anomaly.multi_method(df, "v", names).union(voted)


@query()
def anomaly_forest(spark: SparkSession, d: str) -> DataFrame:
    """An isolation forest's outliers; random cuts, so no SQL."""
    return anomaly.isolation_outliers(t(spark, d, "events").select("event_id", "value"), ["value"], 0.05).select("event_id", "is_anomaly")


@query()
def anomaly_kernel(spark: SparkSession, d: str) -> DataFrame:
    """A one-class kernel machine's outliers; fitted by descent, so no SQL."""
    return anomaly.kernel_outliers(t(spark, d, "events").select("event_id", "value"), "value", 0.05).select("event_id", "is_anomaly")


@query("""WITH e AS (SELECT value AS v, CASE WHEN day(ts) <= 15 THEN 1.0 ELSE 0.0 END AS a FROM events), n AS (SELECT sum(a) AS na, sum(1 - a) AS nb, min(v) AS lo, max(v) AS hi FROM e),
c AS (SELECT v, sum(sum(a)) OVER (ORDER BY v) / max(na) AS fa, sum(sum(1 - a)) OVER (ORDER BY v) / max(nb) AS fb FROM e, n GROUP BY v),
k AS (SELECT CAST(max(abs(fa - fb)) AS DOUBLE) AS s, CAST(max(abs(fa - fb)) * sqrt(max(na) * max(nb) / (max(na) + max(nb))) AS DOUBLE) AS x FROM c, n),
b AS (SELECT least(9, CAST(floor((v - lo) / (hi - lo) * 10) AS INTEGER)) AS k, greatest(sum(a) / max(na), 0.0001) AS h, greatest(sum(1 - a) / max(nb), 0.0001) AS n FROM e, n GROUP BY 1)
SELECT 'value_ks' AS measure, round(s, 8) AS statistic, round((SELECT CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0, least(1, 2 * sum(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * i * i * x * x)))) END FROM range(1, 101) r(i)), 6) AS p_value, false AS drifted FROM k
UNION ALL SELECT 'value_psi', round(CAST(sum((n - h) * ln(n / h)) AS DOUBLE), 8), NULL, sum((n - h) * ln(n / h)) > 0.25 FROM b""")
def drift_report(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").withColumn("day", F.dayofmonth("ts"))
    report = drift.drift_report(e.filter("day <= 15"), e.filter("day > 15"), ["value"])
    made = [(k, round(v["statistic"], 8), round(v["p_value"], 6) if "p_value" in v else None, v["drifted"]) for k, v in report.items()]
    return spark.createDataFrame(made, "measure string, statistic double, p_value double, drifted boolean")


# schemas, sinks and stores


@query(f"""SELECT 'c_custkey' AS name, 'bigint' AS kind, false AS nullable, NULL AS max_length FROM nation WHERE n_nationkey = 0
UNION ALL SELECT 'seg', 'string', true, CAST((SELECT max(length(seg)) FROM {_TEXTS}) AS BIGINT) FROM nation WHERE n_nationkey = 0""")
def inferred_schema(spark: SparkSession, d: str) -> DataFrame:
    found = S.infer(_texts(spark, d).select("c_custkey", "seg"))
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable, f.metadata["constraints"].get("max_length")) for f in found], "name string, kind string, nullable boolean, max_length long")


@query("SELECT n_nationkey AS id, CAST(n_regionkey AS VARCHAR) AS n_regionkey, 'x' AS mark FROM nation")
def migrated_schema(spark: SparkSession, d: str) -> DataFrame:
    """A migration planned from two versions of a schema."""
    old = S.schema(S.column("n_nationkey", "integer"), S.column("n_name", "string"), S.column("n_regionkey", "integer"))
    new = S.schema(S.column("id", "integer"), S.column("n_regionkey", "string"), S.column("mark", "string", default="x"))
    return S.Migration.plan(old, new, {"n_nationkey": "id"}).apply(t(spark, d, "nation"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    df = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    done = write_file(df, path, "csv", compression="gzip")
    assert done.success, done.error
    return read_file(spark, path, "csv", df.schema)


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    df = t(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    done = write_file(df, path, "jsonl")
    assert done.success, done.error
    return read_file(spark, path, "jsonl", df.schema)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "parts")
    done = write_file(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, "parquet", partition_by=["o_orderstatus"], sort_within=["o_orderkey"], max_records=500)
    assert done.success, done.error
    return spark.read.parquet(path)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 2.0 WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def stored_upserts(spark: SparkSession, d: str) -> DataFrame:
    """A table replaced, upserted, and upserted by rows that repeat a key, of which the last counts."""
    store = Store(spark, scratch(spark, "store"))
    df = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    store.replace("orders", df)
    even = df.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(1.0))
    store.upsert("orders", even, "o_orderkey")
    again = df.filter("o_orderkey % 4 = 0").withColumn("o_totalprice", F.lit(9.0)).union(df.filter("o_orderkey % 4 = 0").withColumn("o_totalprice", F.lit(2.0)))
    return store.upsert("orders", again, "o_orderkey")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def streamed_upserts(spark: SparkSession, d: str) -> DataFrame:
    """A stream of files upserted into a table, batch by batch."""
    store = Store(spark, scratch(spark, "stream"))
    schema = t(spark, d, "events").schema
    stream = streaming.read_stream(spark, f"{d}/events.parquet*", schema)
    streaming.upsert_stream(stream, store, "events", "event_id", "ts", scratch(spark, "checkpoint")).awaitTermination()
    return store.load("events").groupBy("event_type").agg(F.count("*").alias("n"))
