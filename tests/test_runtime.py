from datetime import datetime, timedelta

from millrace.plans.runtime import EventTrigger, Interval, Metrics, ResultCache, benchmark, cache_key, compare
from millrace.quality import checks as C
from millrace.quality import drift
from millrace.quality.history import Baselines, History
from millrace.sources.materialize import Store


def test_cache(spark, tmp_path):
    now, calls = [0.0], []
    cache = ResultCache(Store(spark, str(tmp_path)), 10, lambda: now[0])
    make = lambda: calls.append(1) or spark.range(3)
    key = cache_key("a", {"x": 1}, spark.range(5).filter("id > 1"))
    assert key == cache_key("a", {"x": 1}, spark.range(5).filter("id > 1")) != cache_key("a", {"x": 2}, spark.range(5).filter("id > 1"))
    assert cache.get(key, make).count() == 3 and cache.get(key, make).count() == 3 and (len(calls), cache.hits) == (1, 1)
    now[0] = 11
    cache.get(key, make)
    assert len(calls) == 2 and cache.invalidate("a") == 1


def test_triggers_and_metrics(spark):
    t0 = datetime(2024, 1, 1)
    assert Interval(timedelta(hours=1)).next(t0) == datetime(2024, 1, 1, 1)
    e = EventTrigger("new", lambda x: x["n"] > 1, timedelta(minutes=1))
    assert [e.fires({"type": k, "n": n}, t0 + timedelta(seconds=s)) for k, n, s in (("new", 1, 0), ("old", 2, 0), ("new", 2, 0), ("new", 2, 30), ("new", 2, 61))] == [False, False, True, False, True]
    m = Metrics()
    m.count("a")
    m.count("a", 2)
    with m.timed("t"):
        pass
    assert m.counters["a"] == 3 and m.summary()["t"]["n"] == 1
    b = benchmark(lambda: spark.range(10), 0, 2)
    assert b["runs"] == 2 and compare(b, b) == 1


def test_history(spark, tmp_path):
    st = Store(spark, str(tmp_path))
    h, df = History(st), spark.range(5).toDF("i")
    for k, high in enumerate((10, 10, 3, 2)):
        h.record(C.Suite("s", [C.values_between("i", 0, high), C.not_null("i")]).run(df), "a", f"r{k}", datetime(2024, 1, 1 + k))
    assert h.trend("a").first().trend == "declining" and h.recurring_failures("a", 1).count() == 2
    assert h.against_baseline("a").first().status == "critical" and h.summary().first().runs == 4
    b = Baselines(st)
    b.save("x", df, ["i"])
    for k in range(4):
        b.note("x", drift.drift_report(b.load("x"), df.selectExpr(f"i + {k} AS i"), ["i"]), datetime(2024, 1, 1 + k))
    assert {r.trend for r in b.trend("x").collect()} == {"stable", "increasing"} or b.trend("x").count() == 2
