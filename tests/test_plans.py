import datetime
import json

import pytest
from pyspark.sql import types as T

from millrace import schema as S
from millrace import streaming
from millrace.plans import config
from millrace.plans.graph import Asset, Backoff, Checkpoints, CircuitBreaker, CircuitOpen, Cron, DeadLetters, Engine, Graph, checksum, days
from millrace.plans.sql import TemplateError, check, dependencies, render, sql_asset
from millrace.sources import api
from millrace.sources.databases import Connection, QueryBuilder, WatermarkStore, incremental_query
from millrace.sources.files import chunks, read_file, sniff_delimiter, write_file
from millrace.sources.materialize import Store


def test_graph_order_lineage_and_cycles(spark):
    g = Graph()

    @g.asset()
    def a():
        return spark.range(3)

    @g.asset()
    def b(a):
        return a.filter("id > 0")

    @g.asset(depends_on=["a", "b"])
    def c(a, b):
        return a.join(b, "id")

    assert g.order() == ["a", "b", "c"] and g.upstream("c") == {"a", "b"} and g.downstream("a", 1) == {"b", "c"}
    assert Engine(spark, workers=3).run(g).tables["c"].count() == 2
    assert "a --> b" in g.to_mermaid()
    with pytest.raises(ValueError, match="cycle"):
        Graph([Asset("x", a, ("y",)), Asset("y", a, ("x",))]).order()


def test_errors_retries_and_resume(spark, tmp_path):
    calls = {"n": 0, "k": 0}

    def kept():
        calls["k"] += 1
        return spark.range(2)

    def flaky():
        calls["n"] += 1
        if calls["n"] < 3:
            raise OSError("again")
        return spark.range(1)

    g = Graph([Asset("kept", kept, keep="table"), Asset("flaky", flaky, ("kept",)), Asset("after", lambda: spark.range(1), ("flaky",)), Asset("apart", lambda: spark.range(1))])
    engine = Engine(spark, Store(spark, str(tmp_path / "s")), "continue", backoff=Backoff(0), checkpoints=Checkpoints(tmp_path / "c.json"))
    out = engine.run(g, run="r")
    assert out.status == {"apart": "done", "kept": "done", "flaky": "failed", "after": "skipped"} and out.errors == {"flaky": "again"}
    engine.backoff = Backoff(2, base=0)
    out = engine.run(g, run="r")
    assert out.success and out.status["kept"] == "resumed" and calls["k"] == 1
    assert set(engine.backfill(g, days(datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)), ["apart"])) == {datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)}


def test_breaker_backoff_and_letters():
    now = [0.0]
    b = CircuitBreaker(2, 10, lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b.call(lambda: 1 / 0)
    with pytest.raises(CircuitOpen):
        b.call(lambda: 1)
    now[0] = 11
    assert b.state == "half_open" and b.call(lambda: 1) == 1 and b.state == "closed"
    assert [Backoff(kind=k, jitter=0).delay(2) for k in ("fixed", "linear", "exponential")] == [1, 3, 4]
    d = DeadLetters(2)
    for i in range(3):
        d.add(i, ValueError("x"))
    assert [i[0] for i in d.items] == [1, 2] and d.retry(lambda x: 1 / (x - 1)) == 1 and len(d.items) == 1


def test_cron():
    at = datetime.datetime(2024, 2, 28, 23, 59)
    assert Cron("0 0 29 2 *").next(at) == datetime.datetime(2024, 2, 29)
    assert Cron("*/15 9-17 * * 1-5").next(datetime.datetime(2024, 3, 1, 17, 50)) == datetime.datetime(2024, 3, 4, 9)
    for bad in ("* * * *", "61 * * * *"):
        with pytest.raises(ValueError):
            Cron(bad)


def test_checksum_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert checksum(a) == checksum(a.orderBy("i", ascending=False)) != checksum(a.limit(1))


def test_sql(spark):
    assert dependencies("SELECT * FROM {{ a }} JOIN {{ b.c }} ON {{a}}") == ["a", "b"]
    with pytest.raises(TemplateError):
        render("{{ x }}", {})
    errors, warnings = check(spark, "SELEC 1; DROP TABLE x")
    assert errors and warnings == ["DROP TABLE"] and check(spark, "SELECT 1") == ([], [])
    g = Graph([Asset("t", lambda: spark.range(5))])
    sql_asset(g, "big")(lambda: "SELECT id FROM {{ t }} WHERE id > 2")
    assert Engine(spark).run(g).tables["big"].count() == 2


def test_query_builder():
    q = QueryBuilder("t").select("a").distinct().join("u", "t.i = u.i", "LEFT").where("a > :x", x=1).hint("BROADCAST", "u").limit(2).offset(1)
    assert q.build() == "SELECT /*+ BROADCAST(u) */ DISTINCT a FROM t LEFT JOIN u ON t.i = u.i WHERE (a > :x) LIMIT 2 OFFSET 1"
    assert QueryBuilder("t").insert([{"a": 1}, {"a": 2}]) == ("INSERT INTO t (a) VALUES (:a_0), (:a_1)", {"a_0": 1, "a_1": 2})
    assert QueryBuilder("t").where("i = :i", i=1).update({"a": 2}) == ("UPDATE t SET a = :set_a WHERE (i = :i)", {"set_a": 2, "i": 1})
    assert incremental_query("t", "ts", "it's") == "SELECT * FROM (SELECT * FROM t) AS src WHERE ts > 'it''s'"
    assert Connection("postgresql", "h", "d").jdbc()["url"] == "jdbc:postgresql://h:5432/d"


@pytest.mark.parametrize("kind", ["csv", "json", "jsonl", "parquet", "orc"])
def test_files_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a,b", "x"), (2, None, "y")], "i long, s string, p string")
    path = str(tmp_path / f"t.{'jsonl' if kind == 'json' else kind}")
    done = write_file(df, path, partition_by=["p"], compression="gzip" if kind in ("csv", "json", "jsonl") else None)
    assert done.success and done.records_written == 2
    back = read_file(spark, path).select("i", "s", "p").orderBy("i")
    assert [tuple(r) for r in back.collect()] == [(1, "a,b", "x"), (2, None, "y")]


def test_files_small_things(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    assert read_file(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "b.csv").write_text("x;y\n1;2\n")
    assert read_file(spark, str(tmp_path / "b.csv")).columns == ["x", "y"]
    assert sniff_delimiter("") == "," and [len(c) for c in chunks(spark.range(5), 2)] == [2, 2, 1]
    assert not write_file(spark.range(1), str(tmp_path / "a.json"), "parquet", "error").success
    with pytest.raises(ValueError):
        read_file(spark, "x.unknown")
    marks = WatermarkStore(spark, str(tmp_path / "w"))
    assert marks.get("a/b") is None
    marks.put("a/b", 7)
    assert marks.get("a/b") == 7


def test_store(spark, tmp_path):
    st = Store(spark, str(tmp_path))
    st.upsert("t", spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), "k")
    out = st.upsert("t", spark.createDataFrame([(1, "c"), (2, "d")], "k int, v string"), "k")
    assert sorted(map(tuple, out.collect())) == [(1, "c"), (2, "d")]
    assert st.replace("t", st.load("t").filter("k = 1")).count() == 1
    with pytest.raises(KeyError):
        st.load("absent")


def test_paging(spark):
    rows = [{"i": i} for i in range(5)]
    offset = lambda path, p: (200, {}, {"items": rows[p["offset"] : p["offset"] + p["limit"]], "n": 5})
    assert api.read_api(spark, offset, "/x", api.Offset(size=2, total="n"), "i int").count() == 5
    tries = []

    def cursor(path, p):
        tries.append(p)
        return (503, {}, {}) if len(tries) == 1 else (200, {}, {"items": [1], "next": None if "cursor" in p else "c"})

    assert [len(x) for x in api.pages(cursor, "/x", api.Cursor(), {"q": 1}, wait=lambda s: None)] == [1, 1] and all(p["q"] == 1 for p in tries)
    link = lambda path, p: (200, {"Link": '<http://h/x?page=2>; rel="next"'} if "page" not in p else {}, [1])
    assert len(list(api.pages(link, "/x", api.LinkHeader()))) == 2


def test_schema_layer(spark):
    @S.define_schema
    class Base:
        id = S.Integer(ge=0)

    @S.define_schema
    class User(Base):
        name = S.String(required=False, nullable=True, max_length=20)

    assert [f.name for f in User.schema] == ["id", "name"] and S.constraints_of(User.schema)["id"]["min_value"] == 0
    sql = S.create_table("u", User.schema, "postgresql", ["id"])
    assert '"id" BIGINT NOT NULL' in sql and '"name" VARCHAR(20)' in sql
    for d in S.DIALECTS:
        assert S.upsert_sql("u", ["id", "name"], ["id"], d)
    assert ":name AS" in S.upsert_sql("u", ["id", "name"], ["id"], "snowflake")
    new = S.schema(S.column("id", "string"), S.column("age", "integer", default=0))
    assert {(c.column, c.breaking) for c in S.diff(User.schema, new)} >= {("name", True), ("age", False), ("id", True)}
    h = S.History()
    assert (str(h.add(User.schema)), str(h.add(new))) == ("1.0.0", "2.0.0") and S.Version.parse("1.2.3") < S.Version(1, 10)
    out = S.Migration.plan(User.schema, new).apply(spark.createDataFrame([(1, "x")], "id long, name string"))
    assert out.dtypes == [("id", "string"), ("age", "bigint")] and not S.compatible(User.schema, new)
    got = S.infer(spark.createDataFrame([(1, "abc"), (5, None)], "i int, s string"))
    assert got["s"].nullable and got["i"].metadata["constraints"] == {"min_value": 1, "max_value": 5}
    assert S.expect(User.schema, ["id", "z"], types={"id": "integer"}, columns=2, constraint={("id", "min_value"): 0}) == ["z is missing"]
    with pytest.raises(ValueError):
        S.schema(S.column("a", "string"), S.column("a", "string"))


def test_config(spark, tmp_path):
    (tmp_path / "in.csv").write_text("k,v\na,1\nb,2\na,3\n")
    (tmp_path / "p.toml").write_text('[sources.raw]\npath = "${IN}"\n[assets.out]\nsource = "raw"\n[[assets.out.steps]]\ntype = "filter"\ncondition = "v > 1"\n[[assets.out.steps]]\ntype = "sort"\nby = ["v DESC"]\n[[assets.out.expectations]]\ntype = "not_null"\ncolumn = "k"\n[sinks.s]\nasset = "out"\npath = "' + str(tmp_path / "o.parquet") + '"\n')
    tables, results = config.run(spark, config.load(tmp_path / "p.toml", {"IN": str(tmp_path / "in.csv")}))
    assert [r.v for r in tables["out"].collect()] == [3, 2] and results["out"].passed and spark.read.parquet(str(tmp_path / "o.parquet")).count() == 2
    with pytest.raises(ValueError):
        config.step(tables["out"], {"type": "unknown"}, {})


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", datetime.datetime(2024, 1, 1, 0)), (1, "b", datetime.datetime(2024, 1, 1, 1)), (2, "c", datetime.datetime(2024, 1, 3))], "k int, v string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    st = Store(spark, str(tmp_path / "st"))
    source = streaming.read_stream(spark, str(tmp_path / "in"), T._parse_datatype_string("k int, v string, ts timestamp"))
    streaming.upsert_stream(source, st, "t", "k", "ts", str(tmp_path / "c1")).awaitTermination()
    assert sorted((r.k, r.v) for r in st.load("t").collect()) == [(1, "b"), (2, "c")]
    once = streaming.deduplicated(source, ["k"], "ts")
    streaming.write_stream(once, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert streaming.windowed(df, "ts", "1 day", ["k"], {"n": __import__("pyspark").sql.functions.count("*")}).count() == 2
