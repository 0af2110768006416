import json
import os
import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from facetql import results
from facetql.errors import LimitError, QueryError
from facetql.operators import execute
from facetql.service import Engine, Limits

Q = "from d 1970-01-01 1970-01-02 group by k select count(), n/3"


@pytest.fixture
def engine(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(0, "a", 1), (3600, "b", 2), (7200, "a", 4)], "time long, k string, n long").coalesce(1).write.parquet(path)
    own = Engine(spark, Limits(wait=0.2, per_user=1), cache_dir=str(tmp_path / "cache"))
    own.register("d", spark.read.parquet(path))
    return own


def test_numbers():
    values = [1.0, 0.1, 1 / 3, 1e-9, -0.0, 1e15, float("nan"), float("inf"), None]
    assert [results.number(v) for v in values] == ["1", "0.1", "0.3333333", "0", "0", "1000000000000000", "NaN", "∞", ""]


def test_writers(engine):
    assert list(engine.stream(Q)) == ["a\t2\t1.6666667\n", "b\t1\t0.6666667\n"]
    assert list(engine.stream(Q, "csv"))[0] == '"a","2","1.6666667"\n'
    text = "".join(engine.stream(Q, "events"))
    assert "event: resultstream\ndata: a\t2\t1.6666667\ndata: b" in text and '"m1": 3.0' in text and "event: complete" in text


def test_every_position_of_explode_is_checked(spark, monkeypatch):
    rows = [(60 * i, f"u{i % 4}", i % 2) for i in range(12)]
    own = Engine(spark)
    own.register("d", spark.createDataFrame(rows, "time long, k string, n long"))
    for groups in ("k*, n[2]", "k*, time(12h)", "n, k*"):
        query = f"from d 1970-01-01 1970-01-02 group by {groups} select count()"
        monkeypatch.setattr(execute, "MOST_GROUPS", 16)
        assert sum(r["m1"] for r in own.query(query).collect()) == 12
        monkeypatch.setattr(execute, "MOST_GROUPS", 2)
        with pytest.raises(LimitError):
            own.query(query).collect()


def test_products_of_buckets_are_checked(spark, monkeypatch):
    own = Engine(spark)
    own.register("d", spark.createDataFrame([(60 * i, f"u{i % 4}", i % 2) for i in range(12)], "time long, k string, n long"))
    for groups in ("k, buckets(n,0,10,1)", "buckets(n,0,10,1,n,0,3,1)", "k, time(1h)"):
        query = f"from d 1970-01-01 1970-01-02 group by {groups} select count()"
        assert sum(r["m1"] for r in own.query(query).collect()) == 12
        monkeypatch.setattr(execute, "MOST_GROUPS", 30)
        with pytest.raises(LimitError):
            own.query(query).collect()
        monkeypatch.undo()


def test_limits_hold_without_a_cache(spark):
    df = spark.range(100).select((F.col("id") * 60).alias("time"), F.col("id").cast("string").alias("k"))
    query = "from d 1970-01-01 1970-01-02 group by k select count()"
    own = Engine(spark, Limits(rows=5))
    own.register("d", df)
    with pytest.raises(LimitError):
        own.execute(query)
    assert own.execute(query + " limit 5").df.count() == 5
    own = Engine(spark, Limits(timeout=0.0001))
    own.register("d", df)
    with pytest.raises(LimitError):
        for _ in range(20):
            own.execute(query)


def test_replaced_files_are_read_again(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    own = Engine(spark, cache_dir=str(tmp_path / "cache"))
    spark.createDataFrame([(0, "a")], "time long, k string").coalesce(1).write.parquet(path)
    own.register("d", spark.read.parquet(path))
    statement = own.parse("from d 1970-01-01 1970-01-02 group by k select count()")
    first = own.cache_key(statement)
    file = next((tmp_path / "d.parquet").glob("part*"))
    os.utime(file, (1, 1))
    assert own.cache_key(statement) != first


def test_described_as_values(engine):
    assert engine.query("describe d.nothing").count() == 0
    assert engine.described("describe d.nothing")["name"] == "notfound"
    assert engine.described("describe d.k")["topTerms"] == ["a", "b"]
    assert [f["name"] for f in engine.described("describe d")["fields"]] == ["time", "k", "n"]
    assert engine.described("show tables") == {"datasets": [{"name": "d", "description": engine.catalog.find("d").description}]}
    with pytest.raises(QueryError):
        engine.described(Q)


def test_missing_hours_beyond_any_bound(spark):
    first, last = datetime(1970, 1, 1), datetime(1990, 1, 1)
    hours = int((last - first).total_seconds() // 3600)
    gone = (0, 5, 6, 101_000, 150_000, hours - 1)
    df = spark.range(hours).filter(~F.col("id").isin(*gone)).select((F.col("id") * 3600).alias("time"), F.lit("a").alias("k"))
    own = Engine(spark)
    own.register("d", df)

    def span(a, b):
        return "-".join(time.strftime("%Y%m%d.%H", time.gmtime(x * 3600)) for x in (a, b))

    assert own.missing("d", first, last) == [span(0, 1), span(5, 7), span(101_000, 101_001), span(150_000, 150_001), span(hours - 1, hours)]
    assert own.missing("d", datetime(2000, 1, 1), datetime(2000, 1, 2)) == ["20000101.00-20000102.00"]


def test_event_errors(spark):
    broken = spark.range(1).select(F.raise_error(F.lit("no")).alias("g1"))
    assert "event: servererror" in "".join(results.events(broken))


def test_cache_holds_the_whole_result(engine):
    first = engine.execute(Q + " limit 1", totals=True)
    again = engine.execute(Q)
    assert not first.cached and again.cached and first.key == again.key
    assert first.df.count() == 1 and again.df.count() == 2 and first.totals == {"m1": 3.0, "m2": 7 / 3}


def test_background(engine):
    key, job = engine.submit(Q)
    job.result(60)
    assert [r["g1"] for r in engine.stored(key).collect()] == ["a", "b"]
    with pytest.raises(QueryError):
        Engine(engine.spark).submit(Q)


def test_metadata(engine):
    assert [r["dataset"] for r in engine.query("show tables").collect()] == ["d"]
    assert [r["name"] for r in engine.query("describe d").collect()] == ["time", "k", "n"]
    assert [tuple(r) for r in engine.query("describe d.k").collect()] == [("a", 2), ("b", 1)]
    assert engine.query("describe d.n").count() == 0
    assert engine.missing("d", datetime(1970, 1, 1), datetime(1970, 1, 1, 5)) == ["19700101.03-19700101.05"]


def test_one_query_per_user(engine):
    with engine._slot("me"), pytest.raises(LimitError):
        engine.execute(Q, user="me")
    with engine._track(Q, "me"):
        assert [r.query for r in engine.running()] == [Q]
    assert engine.running() == []


def test_equal_queries_wait(engine):
    lock = engine._alone("x")
    lock.__enter__()
    with pytest.raises(LimitError), engine._alone("x"):
        pass
    lock.__exit__(None, None, None)
    with engine._alone("x"):
        pass


def test_timeout(spark):
    own = Engine(spark, Limits(timeout=0.5))
    with pytest.raises(LimitError):
        own._within(lambda: spark.range(10**12).agg(F.sum(F.sqrt("id"))).collect())


def test_syntax_services():
    assert Engine.split("from a b c limit 3").limit == "3"
    assert [(t.kind, t.start) for t in Engine.tokenize("a = 'x'")] == [("name", 0), ("op", 2), ("string", 4)]


def test_threads(engine):
    own = Engine(engine.spark, Limits())
    own.catalog = engine.catalog
    found = []
    threads = [threading.Thread(target=lambda: found.append(own.execute(Q, user=str(time.time_ns())).df.count())) for _ in range(3)]
    [t.start() for t in threads]
    [t.join(60) for t in threads]
    assert found == [2, 2, 2]


def test_header_is_json(engine):
    line = next(x for x in engine.stream(Q, "events") if x.startswith("event: header"))
    assert json.loads(line.split("data: ")[1])["rows"] == 2


def test_command_line(spark, tmp_path, capsys):
    from facetql.__main__ import main

    path, metrics = str(tmp_path / "c.parquet"), tmp_path / "dimensions.desc"
    spark.createDataFrame([(0, "a", 2), (9, "b", 3)], "at long, k string, n long").coalesce(1).write.parquet(path)
    metrics.write_text("twice,doubled,null,add,n,n\nodd,none,null,whatever,x,y\n")
    base = ["-d", f"c={path}:at", "--dimensions", f"c={metrics}"]
    assert main([*base, "from c 1970-01-01 1970-01-02 group by k select twice"]) == 0
    assert main([*base, "show tables"]) == 0 and main([*base, "from c 1970-01-01 1970-01-02 select zzz"]) == 1
    out = capsys.readouterr()
    assert out.out == "a\t4\nb\t6\nc\t\n" and "Unknown field: zzz" in out.err and "odd: unknown type" in out.err
