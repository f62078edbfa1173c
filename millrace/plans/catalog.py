"""Registered queries over the test tables, and the same in DuckDB's SQL.

Each query goes through the operators.  Sums of doubles are rounded on both sides, as their last digits
depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import streaming
from millrace.operators import aggregates as A
from millrace.operators import cleaning, joins, reshape, rows, windows
from millrace.plans import catalog_quality  # noqa: F401  registers further queries
from millrace.plans import config as pipeline_config
from millrace.plans.builder import transform
from millrace.plans.graph import Asset, Engine, Graph
from millrace.plans.registry import QUERIES, SQL, query, t  # noqa: F401
from millrace.plans.registry import rounded as _r
from millrace.plans.sql import run_sql, sql_asset
from millrace.quality import anomaly, checks, drift, metrics
from millrace.sources.databases import QueryBuilder, above_watermark

REVENUE = "l_extendedprice * (1 - l_discount)"


@query("""
SELECT n_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_items, round(avg(l_quantity), 4) AS avg_qty,
       CAST(rank() OVER (PARTITION BY n_name ORDER BY round(sum(l_extendedprice * (1 - l_discount)), 2) DESC) AS BIGINT) AS segment_rank
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus <> 'P' GROUP BY n_name, c_mktsegment""")
def flagship_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by nation and segment, ranked: scan, predicate, three joins, projection, grouping, window."""
    orders = t(spark, d, "orders").transform(rows.filter_by_field("o_orderstatus", "P", "ne")).select("o_orderkey", "o_custkey")
    out = joins.join(t(spark, d, "lineitem"), orders, ("l_orderkey", "o_orderkey"))
    out = joins.join(out, t(spark, d, "customer"), ("o_custkey", "c_custkey"))
    out = joins.join(out, t(spark, d, "nation"), ("c_nationkey", "n_nationkey"))
    out = out.transform(rows.compute_field("amount", REVENUE))
    out = A.group_by(out, ["n_name", "c_mktsegment"], [A.Sum("amount", "revenue"), A.Count("*", "n_items"), A.Avg("l_quantity", "avg_qty")])
    out = out.select("n_name", "c_mktsegment", _r("revenue", 2), "n_items", _r("avg_qty"))
    return windows.window(out, {"segment_rank": windows.window_function("rank")}, ["n_name"], ["revenue DESC"]).withColumn("segment_rank", F.col("segment_rank").cast("long"))


# rows and predicates


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000")
def select_filter(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").transform(rows.filter_by_field("o_totalprice", 200000, "gte")).transform(rows.select_fields(["o_totalprice", "o_orderkey", "absent"]))


@query("""SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'MACHINERY'""")
def filter_ne_keeps_nulls(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return df.transform(rows.filter_by_field("segment", "MACHINERY", "ne"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
def filter_in_sets(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").transform(rows.filter_by_field("o_orderpriority", ["1-URGENT", "2-HIGH"], "in")).transform(rows.filter_by_field("o_orderstatus", ["F"], "not_in")).select("o_orderkey", "o_orderpriority")


@query("SELECT n_nationkey AS id, n_name AS label FROM nation")
def rename_drop(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "nation").transform(rows.drop_fields(["n_regionkey"])).transform(rows.rename_fields({"n_nationkey": "id", "n_name": "label"}))


@query("SELECT event_id, coalesce(TRY_CAST(event_type AS BIGINT), -1) AS type_number, CAST(user_id AS VARCHAR) AS user_text FROM events")
def cast_with_default(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", F.col("event_type").alias("type_number"), F.col("user_id").alias("user_text")).transform(rows.cast_field("type_number", "bigint", -1)).transform(rows.cast_field("user_text", "string"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity > 25 AND l_discount < 0.05 AS big FROM lineitem")
def computed_expression(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "lineitem").transform(rows.compute_field_from_expression("charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)"))
    return df.transform(rows.compute_field_from_expression("big", "l_quantity > 25 and l_discount < 0.05")).select("l_orderkey", "l_linenumber", "charge", "big")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").transform(rows.extract_fields({"k": "props.k"})).select("event_id", F.col("k").cast("bigint").alias("k"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS o_orderstatus FROM orders")
def remap_values(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").transform(rows.map_field("o_orderstatus", {"O": "open", "F": "filled"}, "other")).select("o_orderkey", "o_orderstatus")


@query("SELECT s_suppkey, s_nationkey, n_name AS nation_n_name, n_regionkey AS nation_n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_enrich(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").select("s_suppkey", "s_nationkey").transform(rows.enrich_from_lookup(t(spark, d, "nation"), "n_nationkey", "s_nationkey", ["n_name", "n_regionkey"], "nation_"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k_orders(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").transform(rows.top_k(20, "o_totalprice DESC", "o_orderkey"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 15 OFFSET 10")
def sort_limit_offset(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", "p_retailprice").transform(rows.sort_rows("p_retailprice", "p_partkey")).transform(rows.limit_rows(15, 10))


@query("""SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3""")
def top_k_per_nation(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal").transform(rows.top_k_per_group(["c_nationkey"], 3, "c_acctbal DESC", "c_custkey"))


@query("SELECT c_nationkey AS nation, c_acctbal AS balance, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    b = t(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return a.transform(rows.union_all(b))


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    return joins.join(t(spark, d, "orders"), t(spark, d, "customer"), ("o_custkey", "c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    return joins.join(t(spark, d, "customer"), t(spark, d, "orders"), ("c_custkey", "o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark: SparkSession, d: str) -> DataFrame:
    return joins.join(t(spark, d, "supplier"), t(spark, d, "nation"), ("s_nationkey", "n_nationkey"), "right").select("s_suppkey", "n_name")


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS n_x, b.n AS n_y FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def join_full_suffixes(spark: SparkSession, d: str) -> DataFrame:
    a = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return joins.join(a, b, "k", "full")


@query("""SELECT a.c_custkey, b.seg AS seg FROM (SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg FROM customer) a JOIN (SELECT DISTINCT NULLIF(c_mktsegment, 'BUILDING') AS seg FROM customer) b ON a.seg IS NOT DISTINCT FROM b.seg""")
def join_null_safe(spark: SparkSession, d: str) -> DataFrame:
    a = t(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return joins.join(a, a.select("seg").distinct(), "seg", null_safe=True)


@query("""SELECT DISTINCT c_custkey AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def missing_references(spark: SparkSession, d: str) -> DataFrame:
    return joins.missing_references(t(spark, d, "customer"), "c_custkey", t(spark, d, "orders"), "o_custkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders""")
def incremental_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return joins.upsert(old, old.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), "o_orderkey")


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def watermark_load(spark: SparkSession, d: str) -> DataFrame:
    import datetime

    return above_watermark(t(spark, d, "events"), "ts", datetime.datetime(2024, 1, 20)).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


# aggregates


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def group_sums(spark: SparkSession, d: str) -> DataFrame:
    out = A.group_by(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [A.Sum("l_quantity", "sum_qty"), A.Avg("l_discount", "avg_disc"), A.Min("l_extendedprice", "min_price"), A.Max("l_extendedprice", "max_price"), A.Count("*", "n")])
    return out.withColumns({"sum_qty": F.round("sum_qty", 2), "avg_disc": F.round("avg_disc", 6)})


@query("""SELECT seg, count(*) AS n FROM (SELECT NULLIF(c_mktsegment, 'BUILDING') AS seg FROM customer) WHERE seg IS NOT NULL GROUP BY 1""")
def group_drops_null_keys(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return A.group_by(df, "seg", [A.Count("*", "n")])


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, CAST(GROUPING_ID(l_returnflag, l_linestatus) AS BIGINT) AS grouping_id FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_quantities(spark: SparkSession, d: str) -> DataFrame:
    return A.rollup(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [A.Sum("l_quantity", "qty")], True).withColumns({"qty": F.round("qty", 2), "grouping_id": F.col("grouping_id").cast("long")})


@query("""SELECT o_orderstatus, o_orderpriority, count(o_orderkey) AS n, CAST(GROUPING_ID(o_orderstatus, o_orderpriority) AS BIGINT) AS grouping_id FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.cube(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], [A.Count("o_orderkey", "n")], True).withColumn("grouping_id", F.col("grouping_id").cast("long"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.value_counts(t(spark, d, "events"), "event_type", 3)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def daily_aggregation(spark: SparkSession, d: str) -> DataFrame:
    out = A.by_period(t(spark, d, "events"), "ts", "day", [A.Avg("value", "mean"), A.Count("*", "n")])
    return out.select(F.col("period").cast("timestamp_ntz").alias("period"), _r("mean", 6), "n")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def distinct_parts(spark: SparkSession, d: str) -> DataFrame:
    return A.group_by(t(spark, d, "lineitem"), "l_suppkey", [A.CountDistinct("l_partkey", "parts")])


# windows and shapes


@query("""SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr, lag(value) OVER w AS previous, lead(value, 2, 0.0) OVER w AS later
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY event_type)""")
def window_functions(spark: SparkSession, d: str) -> DataFrame:
    w = windows.window_function
    df = windows.window(t(spark, d, "events"), {"rn": w("row_number"), "previous": w("lag", "value"), "later": w("lead", "value", 2, 0.0)}, ["user_id"], ["ts", "event_id"])
    df = windows.window(df, {"rk": w("rank"), "dr": w("dense_rank")}, ["user_id"], ["event_type"])
    return df.select("event_id", *(F.col(c).cast("long").alias(c) for c in ("rn", "rk", "dr")), "previous", "later")


@query("""SELECT event_id, round(CASE WHEN row_number() OVER w >= 3 THEN avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 6) AS moving_avg FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    return windows.moving_average(t(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"], 3).select("event_id", _r("moving_avg", 6))


@query("""SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p <> 0 AND abs((value - p) / abs(p)) > 0.2""")
def change_points(spark: SparkSession, d: str) -> DataFrame:
    return windows.change_points(t(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id")


@query("""SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 2) AS "F", round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS "O" FROM lineitem GROUP BY 1""")
def pivot_quantities(spark: SparkSession, d: str) -> DataFrame:
    return reshape.pivot(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "sum", expected=["F", "O"]).withColumns({"F": F.round("F", 2), "O": F.round("O", 2)})


@query("""SELECT p_partkey, 'p_size' AS measure, CAST(p_size AS DOUBLE) AS amount FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def unpivot_measures(spark: SparkSession, d: str) -> DataFrame:
    return reshape.unpivot(t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"], "measure", "amount")


# cleaning


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.remove_duplicates(t(spark, d, "documents"), ["text"], "first", ["doc_id"]).select("doc_id", "source")


@query("SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k > 1")
def find_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.find_duplicates(t(spark, d, "documents"), ["text"], ["doc_id"]).select("doc_id")


def _holes(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("price"))


_HOLES = "(SELECT p_partkey, p_brand, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price FROM part)"


@query(f"SELECT p_partkey, round(coalesce(price, (SELECT avg(price) FROM {_HOLES})), 6) AS price FROM {_HOLES}")
def impute_mean(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.handle_nulls(_holes(spark, d), "fill_mean", columns=["price"]).select("p_partkey", _r("price", 6))


@query(f"SELECT p_partkey, round(coalesce(price, (SELECT median(price) FROM {_HOLES})), 6) AS price FROM {_HOLES}")
def impute_median(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.handle_nulls(_holes(spark, d), "fill_median", columns=["price"]).select("p_partkey", _r("price", 6))


@query(f"""SELECT p_partkey, p_brand, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(price IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM {_HOLES}""")
def impute_forward(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.handle_nulls(_holes(spark, d), "fill_forward", columns=["price"], order_by=["p_partkey"], partition_by=["p_brand"])


@query(f"SELECT p_partkey, p_brand, price FROM {_HOLES} WHERE price IS NOT NULL")
def drop_nulls(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.handle_nulls(_holes(spark, d), "drop")


_Q = "(SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, q1 - 0.2 * (q3 - q1)), q3 + 0.2 * (q3 - q1)), 4) AS l_extendedprice FROM lineitem, {_Q}")
def cap_outliers(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return cleaning.handle_outliers(df, "iqr", "cap", 0.2, ["l_extendedprice"]).withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query("SELECT l_orderkey, l_linenumber, abs(l_extendedprice - m) > 1.5 * s AS l_extendedprice_is_outlier FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem)")
def flag_zscore(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return cleaning.handle_outliers(df, "zscore", "flag", 1.5, ["l_extendedprice"]).drop("l_extendedprice")


@query("SELECT p_partkey, round((p_retailprice - m) / s, 6) AS p_retailprice FROM part, (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part)")
def standardize_zscore(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.standardize_columns(t(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).withColumn("p_retailprice", F.round("p_retailprice", 6))


@query("SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS p_retailprice FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def standardize_minmax(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.standardize_columns(t(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], "minmax").withColumn("p_retailprice", F.round("p_retailprice", 6))


@query("SELECT p_partkey, upper(trim(p_name)) AS p_name FROM part")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"))
    return cleaning.clean_text(df, True, case="upper")


@query("SELECT doc_id, regexp_replace(source, '[^a-zA-Z]', '', 'g') AS source FROM (SELECT doc_id, regexp_replace(source, '[0-9]+', '') AS source FROM documents)")
def remove_special(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "documents").select("doc_id", F.concat(F.regexp_replace("source", "[0-9]+", ""), F.lit(" -_!")).alias("source"))
    return cleaning.remove_special_chars(df, ["source"], True, False)


@query(f"SELECT CAST(sum(CASE WHEN p_partkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS p_partkey, CAST(sum(CASE WHEN p_brand IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS p_brand, CAST(sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS price FROM {_HOLES}")
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.null_counts(_holes(spark, d))


# checks, quality and drift


@query("""SELECT 'o_totalprice: between 0 and 1000000' AS name, count(*) FILTER (WHERE NOT o_totalprice BETWEEN 0 AND 1000000) = 0 AS passed, count(*) FILTER (WHERE NOT o_totalprice BETWEEN 0 AND 1000000) AS failed_rows FROM orders
UNION ALL SELECT 'o_orderstatus: in set', count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) = 0, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) FROM orders
UNION ALL SELECT 'o_orderpriority: matches [1-3]', count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-3]')) = 0, count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-3]')) FROM orders
UNION ALL SELECT 'o_custkey: unique', false, CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 1""")
def check_suite(spark: SparkSession, d: str) -> DataFrame:
    suite = checks.Suite("orders", [checks.values_between("o_totalprice", 0, 1000000), checks.values_in_set("o_orderstatus", ["O", "F"]), checks.match_regex("o_orderpriority", "[1-3]"), checks.unique("o_custkey")])
    return spark.createDataFrame([(r.name, r.passed, r.failed_rows) for r in suite.run(t(spark, d, "orders")).results], "name string, passed boolean, failed_rows long")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 AND o_orderpriority NOT LIKE '1%' THEN 'o_totalprice: max_value,o_orderpriority: pattern' WHEN o_totalprice > 300000 THEN 'o_totalprice: max_value' WHEN o_orderpriority NOT LIKE '1%' THEN 'o_orderpriority: pattern' ELSE '' END AS errors FROM orders")
def validate_records(spark: SparkSession, d: str) -> DataFrame:
    out = checks.validate_records(t(spark, d, "orders"), {"o_totalprice": {"max_value": 300000}, "o_orderpriority": {"pattern": "1"}})
    return out.select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query(f"SELECT round((1.0 + 1.0 + avg(CASE WHEN price IS NOT NULL THEN 1.0 ELSE 0.0 END)) / 3, 6) AS completeness, CAST(1 AS DOUBLE) AS p_partkey, CAST(1 AS DOUBLE) AS p_brand, round(avg(CASE WHEN price IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS price FROM {_HOLES}")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return metrics.completeness(_holes(spark, d)).withColumns({"completeness": F.round("completeness", 6), "price": F.round("price", 6)})


@query("SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_values, round(count(*) / sum(n), 6) AS uniqueness FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return metrics.uniqueness(t(spark, d, "documents"), ["text"]).select("total", F.col("distinct").alias("distinct_values"), _r("uniqueness", 6))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-25 00:00:00') AS stale, round(1 - count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-25 00:00:00') / count(*), 6) AS freshness FROM events")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return metrics.freshness(t(spark, d, "events"), "ts", 120, F.lit("2024-01-30 00:00:00").cast("timestamp")).select("total", "stale", _r("freshness", 6))


@query("""SELECT column_name, null_count, distinct_count, round(mean, 4) AS mean, round(median, 4) AS median FROM (
SELECT 's_suppkey' AS column_name, count(*) - count(s_suppkey) AS null_count, count(DISTINCT s_suppkey) AS distinct_count, avg(s_suppkey) AS mean, median(s_suppkey) AS median FROM supplier
UNION ALL SELECT 's_name', count(*) - count(s_name), count(DISTINCT s_name), NULL, NULL FROM supplier
UNION ALL SELECT 's_nationkey', count(*) - count(s_nationkey), count(DISTINCT s_nationkey), avg(s_nationkey), median(s_nationkey) FROM supplier
UNION ALL SELECT 's_acctbal', count(*) - count(s_acctbal), count(DISTINCT s_acctbal), avg(s_acctbal), median(s_acctbal) FROM supplier)""")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return metrics.profile(t(spark, d, "supplier")).select("column_name", "null_count", "distinct_count", _r("mean"), _r("median"))


@query("SELECT event_id, round(abs(value - m) / s, 6) AS score, abs(value - m) / s > 1.5 AS is_anomaly FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)")
def anomaly_zscore(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.zscores(t(spark, d, "events"), "value", 1.5).select("event_id", _r("score", 6), "is_anomaly")


@query("""WITH s AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) AS i, count(*) OVER () AS n FROM part),
q AS (SELECT max(CASE WHEN i = floor((n + 1) / 4.0) THEN v END) AS a, max(CASE WHEN i = floor((n + 1) / 4.0) + 1 THEN v END) AS b, max((n + 1) / 4.0 - floor((n + 1) / 4.0)) AS f,
 max(CASE WHEN i = floor(3 * (n + 1) / 4.0) THEN v END) AS c, max(CASE WHEN i = floor(3 * (n + 1) / 4.0) + 1 THEN v END) AS e, max(3 * (n + 1) / 4.0 - floor(3 * (n + 1) / 4.0)) AS g, max(n) AS total FROM s)
SELECT round(CAST(a + (b - a) * f AS DOUBLE), 6) AS q1, round(CAST(c + (e - c) * g AS DOUBLE), 6) AS q3, total FROM q""")
def exclusive_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.exclusive_quartiles(t(spark, d, "part"), "p_retailprice").select(_r("q1", 6), _r("q3", 6), "total")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = t(spark, d, "events").withColumn("day", F.dayofmonth("ts"))
    return e.filter("day <= 15"), e.filter("day > 15")


@query("""WITH e AS (SELECT value AS v, CASE WHEN day(ts) <= 15 THEN 1.0 ELSE 0.0 END AS a FROM events), n AS (SELECT sum(a) AS na, sum(1 - a) AS nb FROM e),
c AS (SELECT v, sum(sum(a)) OVER (ORDER BY v) / max(na) AS fa, sum(sum(1 - a)) OVER (ORDER BY v) / max(nb) AS fb FROM e, n GROUP BY v)
SELECT round(CAST(max(abs(fa - fb)) AS DOUBLE), 8) AS statistic, CAST(max(na) AS BIGINT) AS n_baseline, CAST(max(nb) AS BIGINT) AS n_current FROM c, n""")
def drift_ks(spark: SparkSession, d: str) -> DataFrame:
    return drift.ks_statistic(*_halves(spark, d), "value").select(_r("statistic", 8), "n_baseline", "n_current")


@query("""WITH e AS (SELECT value AS v, day(ts) <= 15 AS a FROM events), m AS (SELECT min(v) AS lo, max(v) AS hi, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE NOT a) AS nb FROM e),
b AS (SELECT least(9, CAST(floor((v - lo) / (hi - lo) * 10) AS INTEGER)) AS k, greatest(count(*) FILTER (WHERE a) / CAST(max(na) AS DOUBLE), 0.0001) AS h, greatest(count(*) FILTER (WHERE NOT a) / CAST(max(nb) AS DOUBLE), 0.0001) AS n FROM e, m GROUP BY 1)
SELECT round(sum((n - h) * ln(n / h)), 8) AS psi FROM b""")
def drift_psi(spark: SparkSession, d: str) -> DataFrame:
    return drift.psi(*_halves(spark, d), "value").select(_r("psi", 8))


@query("""WITH c AS (SELECT event_type, count(*) FILTER (WHERE day(ts) <= 15) AS a, count(*) FILTER (WHERE day(ts) > 15) AS b FROM events GROUP BY 1), n AS (SELECT sum(a) AS na, sum(b) AS nb, count(*) AS k FROM c)
SELECT round(CAST(sum(power(a - (a + b) * na / (na + nb), 2) / ((a + b) * na / (na + nb)) + power(b - (a + b) * nb / (na + nb), 2) / ((a + b) * nb / (na + nb))) AS DOUBLE), 6) AS statistic, max(k) - 1 AS df FROM c, n""")
def drift_chi_square(spark: SparkSession, d: str) -> DataFrame:
    return drift.chi_square(*_halves(spark, d), "event_type").select(_r("statistic", 6), "df")


# plans


@query("SELECT c_nationkey, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1")
def fluent_chain(spark: SparkSession, d: str) -> DataFrame:
    chain = transform(t(spark, d, "orders")).filter(field="o_orderstatus", value="F").join(t(spark, d, "customer"), ("o_custkey", "c_custkey"))
    return chain.groupby("c_nationkey", [A.Sum("o_totalprice", "total")]).execute().withColumn("total", F.round("total", 2))


@query("SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def asset_graph(spark: SparkSession, d: str) -> DataFrame:
    g = Graph([Asset("nation", lambda: t(spark, d, "nation")), Asset("region", lambda: t(spark, d, "region"))])

    @sql_asset(g, "by_region")
    def by_region() -> str:
        return "SELECT r_name, count(*) AS nations FROM {{ nation }} JOIN {{ region }} ON n_regionkey = r_regionkey GROUP BY 1"

    return Engine(spark).run(g, ["by_region"]).tables["by_region"]


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 100.5")
def sql_template(spark: SparkSession, d: str) -> DataFrame:
    return run_sql(spark, "SELECT s_suppkey, s_acctbal FROM {{ s }} WHERE s_acctbal > :least", {"s": t(spark, d, "supplier")}, params={"least": 100.5})


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority HAVING count(*) > 1 ORDER BY n DESC, o_orderpriority LIMIT 3")
def query_builder(spark: SparkSession, d: str) -> DataFrame:
    t(spark, d, "orders").createOrReplaceTempView("_orders")
    q = QueryBuilder("_orders").select("o_orderpriority", "count(*) AS n").where("o_totalprice > :least", least=1000)
    return q.group_by("o_orderpriority").having("count(*) > 1").order_by("n DESC", "o_orderpriority").limit(3).run(spark)


@query("SELECT status, count(*) AS n, round(sum(price), 2) AS total FROM (SELECT o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_totalprice > 50000) GROUP BY 1")
def configured_pipeline(spark: SparkSession, d: str) -> DataFrame:
    spec = {
        "sources": {"orders": {"path": f"{d}/orders.parquet", "format": "parquet"}},
        "assets": {
            "big": {"source": "orders", "steps": [{"type": "filter", "condition": "o_totalprice > 50000"}, {"type": "rename", "fields": {"o_orderstatus": "status", "o_totalprice": "price"}}]},
            "totals": {"source": "big", "steps": [{"type": "aggregate", "group_by": ["status"], "aggregations": [{"function": "count", "column": "*", "alias": "n"}, {"function": "sum", "column": "price", "alias": "total"}]}]},
        },
    }
    return pipeline_config.run(spark, spec)[0]["totals"].withColumn("total", F.round("total", 2))


@query("""SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = streaming.windowed(t(spark, d, "events"), "ts", "1 day", ["event_type"], {"n": F.count("*"), "total": F.round(F.sum("value"), 4)})
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("""SELECT user_id, count(*) AS n, min(ts) AS session_start FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 DAY > ts THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = streaming.sessions(t(spark, d, "events"), "ts", "1 day", ["user_id"], {"n": F.count("*")})
    return out.select("user_id", "n", F.col("session_start").cast("timestamp_ntz").alias("session_start"))
