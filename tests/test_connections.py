"""Databases, compression, web clients, expectations, and the repairs of stores and statements."""

import json
import os
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import user
from millrace.operators.joins import upsert
from millrace.plans import config
from millrace.plans.runtime import ResultCache
from millrace.quality import anomaly, checks, metrics
from millrace.quality.expectations import Library, expect
from millrace.sources import api, compression, files, protocols
from millrace.sources.connections import Database
from millrace.sources.databases import QueryBuilder
from millrace.sources.materialize import Store


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "db.sqlite")
    return Database(lambda: sqlite3.connect(path, timeout=30))


def test_database(spark, database):
    assert database.test() and not database.table_exists("people")
    df = spark.createDataFrame([(i, f"p{i}", i * 1.5) for i in range(50)], "id long, name string, score double")
    done = database.write(df, "people", ["id"], partitions=1)
    assert done.success and done.records_written == 50 and database.table_exists("people") and database.columns("people") == ["id", "name", "score"]
    new = spark.createDataFrame([(3, "three", 0.0), (99, "new", 1.0)], "id long, name string, score double")
    for _ in range(2):  # the same rows once more change nothing
        assert database.write(new, "people", ["id"], partitions=1).success
    got = {r["id"]: r["name"] for r in database.query("SELECT id, name FROM people")}
    assert len(got) == 51 and got[3] == "three" and got[99] == "new"
    assert database.execute("UPDATE people SET name = :n WHERE id = :i", {"n": "x", "i": 4}) == 1
    assert database.execute_many("INSERT INTO people (id, name, score) VALUES (:id, :name, :score)", [{"id": 200, "name": "a", "score": 1.0}]) == 1
    with pytest.raises(ZeroDivisionError), database.transaction() as c:
        c.execute("DELETE FROM people")
        raise ZeroDivisionError
    assert database.query("SELECT count(*) AS n FROM people")[0]["n"] == 52
    assert database.read(spark, "SELECT id, name FROM people WHERE id < :m", "id long, name string", {"m": 5}).count() == 5
    assert not database.write(df, "people", mode="fail_if_exists").success
    assert database.write(df, "people", mode="overwrite", partitions=1).success and database.query("SELECT count(*) AS n FROM people")[0]["n"] == 50
    assert not database.write(df.withColumn("more", F.lit(1)), "people").success
    assert Database(lambda: None, style="pyformat")._text("a = :b::int") == "a = %(b)s::int"


def test_protocols(spark, tmp_path, database):
    df = spark.range(5)
    for x in (protocols.Files(str(tmp_path / "a.parquet")), protocols.Stored(Store(spark, str(tmp_path / "s")), "t"), protocols.Table(database, "t", "id long", ["id"])):
        assert isinstance(x, protocols.Source) and isinstance(x, protocols.Sink)
        assert x.save(df.coalesce(1)).success and x.load(spark).count() == 5


@pytest.mark.parametrize("kind", ["gzip", "bz2", "xz", "zip"])
def test_compression(tmp_path, kind):
    data = b"some text\n" * 1000
    assert compression.decompress(compression.compress(data, kind)) == data and compression.detect(head=compression.compress(data, kind)) == kind
    (tmp_path / "a").write_bytes(data)
    compression.compress_file(str(tmp_path / "a"), str(tmp_path / "b"), kind)
    compression.decompress_file(str(tmp_path / "b"), str(tmp_path / "c"))
    assert (tmp_path / "c").read_bytes() == data and compression.detect("x.csv.gz") == "gzip"


def test_zipped_tables(spark, tmp_path):
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("a.csv", "id,name\n" + "".join(f"{k * 10 + i},n{i}\r\n" for i in range(10)))
    got = compression.read_zipped_csv(spark, str(tmp_path / "*.zip"), "id long, name string")
    assert sorted((r.id, r.name) for r in got.collect()) == [(i, f"n{i % 10}") for i in range(30)]
    with zipfile.ZipFile(tmp_path / "j.zip", "w") as z:
        z.writestr("a.json", '{"a": 1}\n\n{"a": 2}')
    assert [r.a for r in compression.read_zipped_json(spark, str(tmp_path / "j.zip"), "a long").orderBy("a").collect()] == [1, 2]


def test_web_clients(spark):
    seen = []

    def transport(path, params):
        seen.append((path, params))
        if path == "token":
            return 200, {}, {"access_token": f"t{len(seen)}", "expires_in": 100}
        if path == "graph":
            return 200, {}, {"data": {"x": 1}} if params["query"] == "ok" else {"errors": [{"message": "no"}]}
        return 200, {}, {"items": [{"id": 1, "v": 5}, {"id": 2, "v": 50}]}

    api.basic(api.bearer(api.api_key(transport, "k"), "b"), "u", "p")("x", {})
    assert seen[-1][1]["headers"]["X-API-Key"] == "k" and seen[-1][1]["headers"]["Authorization"] == "Bearer b"
    api.api_key(transport, "k", "key", True)("x", {"a": 1})
    assert seen[-1][1] == {"a": 1, "key": "k"}
    now = [0.0]
    login = api.ClientCredentials(transport, "token", "c", "s", clock=lambda: now[0])
    first = login.token()
    now[0] = 60
    assert login.token() == first
    now[0] = 80
    assert login.token() != first
    waits = []

    def wait(s):
        waits.append(s)
        now[0] += s

    limited = api.RateLimit(2, 10, lambda: now[0], wait).around(transport)
    for _ in range(5):
        limited("x", {})
    assert waits == [10, 10]
    assert api.graphql(transport, "graph", "ok") == {"x": 1}
    with pytest.raises(OSError, match="no"):
        api.graphql(transport, "graph", "bad")
    good, bad = api.read_validated(spark, transport, "x", api.Offset(size=10), "id long, v long", {"v": {"max_value": 10}})
    assert [r.id for r in good.collect()] == [1] and [r.errors for r in bad.collect()] == [["v: max_value"]]
    import hashlib
    import hmac

    body = json.dumps({"type": "push"}).encode()
    assert api.signed_event(body, "sha256=" + hmac.new(b"s", body, hashlib.sha256).hexdigest(), "s")["type"] == "push"
    with pytest.raises(PermissionError):
        api.signed_event(body, "00", "s")


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    chain = expect("id").to_be_unique().to_be_between(0, 1)
    assert [r.passed for r in chain.run(df).results] == [True, False]
    assert expect("id").to_be_between(0, 1).as_warnings().run(df, "continue_on_warning").passed
    with pytest.raises(ValueError, match="2 columns"):
        expect("a", "b").to_be_equal() and expect("a").suite() and type(expect("a", "b"))(("a",)).to_be_equal()
    lib = Library().register("small", lambda c, most: checks.values_between(c, 0, most))
    lib.save("ids", [lib.make("small", "id", 5), checks.unique("id")])
    lib.save("more", [checks.unique("id"), checks.not_null("s")])
    assert lib.suite("ids", "more").run(df).passed and len(lib.suite("ids", "more").checks) == 3


def test_upsert_keeps_the_last_new_row(spark, tmp_path):
    old = spark.createDataFrame([("k", "old", {"a": 1})], "k string, v string, m map<string,int>")
    new = spark.createDataFrame([("k", "z", {"a": 2}), ("k", "a", {"a": 3})], "k string, v string, m map<string,int>").coalesce(1)
    assert [(r.v, r.m) for r in upsert(old, new, "k").collect()] == [("a", {"a": 3})]
    store = Store(spark, str(tmp_path))
    store.replace("t", old.drop("m"))
    before = store.load("t")
    store.upsert("t", new.drop("m"), "k")
    assert [r.v for r in store.load("t").collect()] == ["a"] and [r.v for r in before.collect()] == ["old"]  # a plan on the old state goes on
    store.replace("t", new.drop("m"))
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2


def test_partitioned_writes_are_the_same_each_time(spark, tmp_path):
    df = spark.range(1000).withColumn("p", F.col("id") % 3)
    for n in "ab":
        assert files.write_file(df, str(tmp_path / n), partition_by=["p"]).success
    parts = [sorted(tuple(sorted(r.id for r in spark.read.parquet(str(f)).collect())) for f in (tmp_path / n).rglob("*.parquet")) for n in "ab"]
    assert parts[0] == parts[1] and spark.read.parquet(str(tmp_path / "a")).count() == 1000


def test_statements_need_conditions():
    with pytest.raises(ValueError, match="condition"):
        QueryBuilder("t").update({"a": 1})
    with pytest.raises(ValueError, match="condition"):
        QueryBuilder("t").delete()
    assert QueryBuilder("t").where("a = :a", a=1).delete() == ("DELETE FROM t WHERE (a = :a)", {"a": 1})


def test_sheets_are_whole_or_not_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SHEET_ROWS", 3)
    assert not files.write_excel(spark.range(4), str(tmp_path / "a.xlsx")).success


def test_cache_removes_tables(spark, tmp_path):
    cache = ResultCache(Store(spark, str(tmp_path)))
    cache.get("a", lambda: spark.range(3))
    assert cache.invalidate("a") == 1 and not (tmp_path / "a").exists()


def test_validate_step(spark):
    df = spark.createDataFrame([(1,), (20,)], "v long")
    spec = {"type": "validate", "constraints": {"v": {"max_value": 10}}}
    with pytest.raises(checks.ValidationError):
        config.step(df, spec, {})
    assert config.step(df, spec | {"on_failure": "drop"}, {}).count() == 1
    with pytest.warns(UserWarning):
        assert config.step(df, {"type": "validate", "rules": [{"type": "range", "column": "v", "min": 0, "max": 5}], "on_failure": "warn"}, {}).count() == 2
    with pytest.raises(checks.ValidationError):
        checks.validate_records(df, {}, strict=True)


def test_outlier_models(spark):
    rows = [(float(i % 10),) for i in range(500)] + [(1000.0,), (-900.0,)]
    df = spark.createDataFrame(rows, "v double")
    for found in (anomaly.isolation_outliers(df, ["v"], 0.01), anomaly.kernel_outliers(df, "v", 0.01)):
        assert {1000.0, -900.0} <= {r.v for r in found.filter("is_anomaly").collect()} and found.filter("is_anomaly").count() < 60
    checked = checks.Suite("s", [checks.no_anomalies_iqr("v", most=2), checks.no_anomalies_isolation("v", 0.01, 60), checks.no_anomalies_iqr("v")]).run(df)
    assert [r.passed for r in checked.results] == [True, True, False]


def test_scores_and_profiles(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "a"), (4, "bcd")], "n long, s string")
    p = metrics.column_profile(df, "n").first()
    assert (p.total, p.distinct_count, p.unique_count, p.mode) == (4, 4, 4, "1") and len(p.percentiles) == 5
    s = metrics.quality_score(df, {"s": {"required": True}}, ["s"])
    assert any("validity" in x for x in metrics.recommendations(s)) and metrics.required(s, {"overall": 10}) is s
    with pytest.raises(ValueError):
        metrics.required(s, {"validity": 99})


def test_user_functions(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 9.0)], "k long, v double")
    assert [r.x for r in df.select(user.scalar(lambda v: v + 1, "double")("v").alias("x")).collect()] == [3.0, 5.0, 10.0]
    assert {r.k: r.m for r in df.groupBy("k").agg(user.aggregate(lambda v: v.median(), "double")("v").alias("m")).collect()} == {1: 3.0, 2: 9.0}


def test_aggregates_of_parts(spark, monkeypatch):
    """No call sees more than a part and a batch; groups of null keys and without values are there too."""
    monkeypatch.setattr(user, "PART_ROWS", 1000)
    monkeypatch.setattr(user, "PART_BYTES", 1 << 30)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        n = 20_000
        df = spark.range(0, n, 1, 3).select(F.when(F.col("id") % 4 != 0, F.col("id") % 4).alias("k"), (F.col("id") % 2 == 0).alias("even"), F.when(F.col("id") % 4 != 1, F.col("id")).alias("v"))
        part = lambda v: {"n": len(v), "known": v.count(), "low": v.min(), "high": v.max()}
        args = (part, "n long, known long, low double, high double")
        out = user.aggregate_parts(df, ["k", "even"], "v", *args, lambda s: float(s["high"].max() - s["low"].min()), "spread", "double")
        assert out.columns == ["k", "even", "spread"]
        assert {(r.k, r.even, r.spread) for r in out.collect()} == {(None, True, n - 4.0), (1, False, None), (2, True, n - 4.0), (3, False, n - 4.0)}
        most = user.aggregate_parts(df.withColumn("k", F.lit("x")), "k", "v", *args, lambda s: int(s["n"].max()), "most", "long").first().most
        rows, known = (user.aggregate_parts(df.withColumn("k", F.lit("x")), "k", "v", *args, lambda s, c=c: int(s[c].sum()), "x", "long").first().x for c in ("n", "known"))
        assert most <= 1000 + 500 and (rows, known) == (n, n * 3 // 4)
        assert user.aggregate_parts(df.limit(0), "k", "v", *args, lambda s: 1, "x", "long").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_query_user_aggregate_shuffles_states_only(spark):
    from millrace.plans.catalog_quality import user_aggregate

    if os.path.isdir("/root/testdata/sf0.001"):
        plan = user_aggregate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.index("MapInArrow") > plan.index("Exchange")  # written from the result to the table: parts come before the shuffle
