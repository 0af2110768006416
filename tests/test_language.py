"""The semantics on a tiny table with missing and multiple values and empty groups."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from facetql.api import From
from facetql.errors import QueryError
from facetql.service import Engine

D = "from tiny 1970-01-01T00:00:00 1970-01-01T00:01:40 "


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        (1, 0, "us", ["a", "b"], 1, "1.5"), (2, 10, "us", ["b"], 2, "2.25"), (3, 20, "gb", [], 3, None),
        (4, 30, None, ["a"], None, "x"), (5, 40, "gb", ["c"], 5, "0.1"), (6, 100, "us", ["a"], 7, "9"),
    ]
    df = spark.createDataFrame(rows, "id long, unixtime long, country string, q array<string>, clicks long, score string")
    own = Engine(spark, clock=lambda: datetime(2024, 1, 1))
    own.register("tiny", df)
    return own


def run(engine, text):
    return sorted([tuple(r) for r in engine.query(D + text).collect()], key=repr)


@pytest.mark.parametrize(
    "text,want",
    [
        ("select count(), clicks", [(5, 11)]),
        ("select floatscale(score,100,0)", [(385,)]),
        ("select clicks/count()", [(2.2,)]),
        ("group by country", [("gb", 2), ("us", 2)]),
        ("group by country*", [("gb", 2), ("us", 2)]),
        ("group by q", [("a", 2), ("b", 2), ("c", 1)]),
        ("where country!=us", [(3,)]),
        ("where q=a", [(2,)]),
        ("where q!=a", [(3,)]),
        ("where clicks<2", [(2,)]),
        ("where -clicks<2", [(3,)]),
        ("where country not in (us,fr)", [(3,)]),
        ('where country=~"u.*"', [(2,)]),
        ('where -country=~"u.*"', [(3,)]),
        ("where between(clicks,0,2)", [(3,)]),
        ("where -between(clicks,0,2)", [(2,)]),
        ('where lucene("country:us OR q:c")', [(3,)]),
        ("group by country select clicks/count()", [("gb", 4), ("us", 1.5)]),
        ("group by country, q*", [("gb", "a", 0), ("gb", "b", 0), ("gb", "c", 1), ("us", "a", 1), ("us", "b", 2), ("us", "c", 0)]),
        ("group by country in (us,fr)", [("us", 2)]),
        ("group by country in (us,fr), q[1]", [("fr", "", 0), ("us", "b", 2)]),
        ("group by country[top 1]", [("gb", 2)]),
        ("where q in (a,c) group by q", [("a", 2), ("c", 1)]),
        ("group by buckets(clicks,0,4,2)", [("< 0", 0), (">= 4", 1), ("[0, 2)", 2), ("[2, 4)", 2)]),
        ("group by buckets(clicks,0,4,2,true)", [("[0, 2)", 2), ("[2, 4)", 2)]),
        ("group by buckets(clicks,0,5,2)", [("< 0", 0), (">= 5", 1), ("[0, 2)", 2), ("[2, 4)", 2), ("[4, 6)", 0)]),
        ("group by time(50s)", [("< 1970-01-01 00:00:00", 0), (">= 1970-01-01 00:01:40", 0), ("[1970-01-01 00:00:00, 1970-01-01 00:00:50)", 5), ("[1970-01-01 00:00:50, 1970-01-01 00:01:40)", 0)]),
        ("select distinct(q)", [(3,)]),
        ("group by country select count(), distinct(q)", [("gb", 2, 1), ("us", 2, 2)]),
        ("group by country in (us,fr) select count(), distinct(q)", [("fr", 0, 0), ("us", 2, 2)]),
        ("select percentile(clicks,50)", [(3,)]),
        ("select percentile(clicks,20)", [(1,)]),
        ("select percentile(clicks,90), percentile(clicks,0)", [(5, 5)]),
        ("group by diff(country, clicks=1, clicks=2, 5) select count()", [("gb", 0, 0, 0), ("us", 2, 1, 1)]),
        ("where clicks=99", [(0,)]),
        ("where clicks=99 group by q[2]", [("", 0)]),
        ("select clicks\\(clicks-clicks), clicks%(clicks-clicks)", [(0, 0)]),
        ('select hasstr("q:a"), hasint(clicks,3), hasstr(nofield,x)', [(2, 1, 0)]),
        ("group by buckets(unixtime,0,100,50), country in (gb,zz) select count(), distinct(id)", [
            ("< 0", "gb", 0, 0), ("< 0", "zz", 0, 0), (">= 100", "gb", 0, 0), (">= 100", "zz", 0, 0),
            ("[0, 50)", "gb", 2, 2), ("[0, 50)", "zz", 0, 0), ("[50, 100)", "gb", 0, 0), ("[50, 100)", "zz", 0, 0)]),
    ],
)
def test_rows(engine, text, want):
    assert run(engine, text) == sorted(want, key=repr)


@pytest.mark.parametrize(
    "text",
    [
        "group by time(30s)", "group by country select distinct(country)", "select distinct(q), percentile(clicks,50)", "where country=us or country=gb",
        "select a/b/c", "select (clicks/2)+1", "select nofield", "select country", "where nofield=1", "where clicks=x", "where country<3", "where clicks+1",
        "where country=~'a&b'", "where clicks=~'1'", "select percentile(clicks,101)", "select min(clicks)", "select -(clicks)", "group by buckets(clicks,0,0,1)",
        "group by buckets(clicks,0,9,0)", "group by country[top x]", "group by nofield[3]", "group by time(1mo)", "where sample(country,3,2)", "select clicks/0",
        "group by country[3 by clicks/count()], q", "where (clicks/2)=1", "select foo(clicks)", "group by q, buckets(clicks,0,4,2,clicks,0,4,2)",
    ],
)
def test_errors(engine, text):
    with pytest.raises(QueryError):
        engine.query(D + text)


def test_division_by_zero(engine):
    row = engine.query(D + "select clicks/(clicks-clicks), (clicks-clicks)/(clicks-clicks), (1-clicks*9)/(clicks-clicks)").collect()[0]
    assert math.isinf(row[0]) and row[0] > 0 and math.isnan(row[1]) and math.isinf(row[2]) and row[2] < 0


def test_totals_ignore_moved_filter(engine):
    assert tuple(engine.compiler(D + "where q in (a,c) group by q").totals().collect()[0]) == (5,)


def test_sample_splits_rows(engine):
    kept, left = (run(engine, f'where {sign}sample(id,1,2,"s")')[0][0] for sign in ("", "-"))
    assert kept + left == 5


def test_order_and_limit(engine):
    got = [r[0] for r in engine.compiler(D + "group by q[top 3]").ordered().collect()]
    assert got == ["a", "b", "c"]
    labels = [r[0] for r in engine.compiler(D + "group by buckets(clicks,0,4,2)").ordered().collect()]
    assert labels == ["[0, 2)", "[2, 4)", "< 0", ">= 4"]
    assert run(engine, "group by country limit 1") == [("gb", 2)]


def test_dimensions(spark):
    own = Engine(spark)
    d = own.register("d", spark.createDataFrame([(1, 2, 3.5)], "clicks long, views long, price double"))
    warnings = d.add_dimensions(
        [
            ["ctr_x", "sum of two", "clicks", "add", "clicks", "views"], ["ratio", "integer ratio", "null", "divide", "clicks", "views"],
            ["!tmp", "hidden", "null", "multiply", "clicks", "clicks"], ["more", "uses tmp", "null", "add", "tmp", "views"],
            ["cost", "Price", "usd", "lossless", "floatscale price*100+0"], ["clicks", "Clicks", "clicks", "lossless", "clicks"],
            ["a", "x", "null", "add", "b", "c"], ["b", "x", "null", "add", "a", "c"],
        ]
    )
    assert d.aliases["ctr_x"] == "(clicks+views)" and d.aliases["ratio"] == "(clicks\\views)" and "tmp" not in d.aliases
    assert d.aliases["more"] == "((clicks*clicks)+views)" and d.aliases["cost"] == "floatscale(price,100,0)"
    assert len(warnings) == 2 and "a" not in d.aliases and d.metrics["clicks"].expression is None
    assert tuple(own.query("from d 2000 2001 select more, cost, counts").collect()[0]) == (3, 350, 1)


def test_python_calls(engine):
    q = From(engine, "tiny", "1970-01-01T00:00:00", "1970-01-01T00:01:40").where("country=us", F.col("id") > 1).group_by("q").select("count()", "clicks")
    assert [tuple(r) for r in q.dataframe().collect()] == [("b", 1, 2)]
    assert tuple(q.totals().collect()[0]) == (1, 2)


def test_filters_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts, 'a' AS f, 1L AS n, 2 AS unused").write.parquet(path)
    own = Engine(spark)
    own.register("t", spark.read.parquet(path), time="ts")
    plan = own.query("from t 2024-01-01 2024-01-02 where f!=b n<5 group by f select n")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "Or(" in plan.split("PushedFilters")[1] and "unused" not in plan
