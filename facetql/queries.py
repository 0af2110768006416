"""The driver's queries: text in the language, and the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .service import Engine

TABLES = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
NOW = datetime(2024, 1, 15, 12)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    own = Engine(spark, clock=lambda: NOW)
    for name, time in TABLES.items():
        own.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), time=time)
    own.register("documents", spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenized=("text",))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    # A field of several values, one that may be missing, and a decimal kept as text.
    own.register(
        "tagged",
        orders.select(
            "o_orderkey", "o_custkey", "o_orderdate",
            F.split("o_orderpriority", "-").alias("tags"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
            F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("cust"),
            F.col("o_totalprice").cast("string").alias("price"),
        ),
        time="o_orderdate",
    )
    own.catalog.find("orders").add_dimensions(
        [["twice", "customer key doubled", "null", "add", "o_custkey", "o_custkey"], ["cents", "price in cents", "usd", "lossless", "floatscale o_totalprice*100+0"]]
    )
    return own


EV, OR, LI = "from events 2024-01-01 2024-01-31", "from orders 1995-01-01 2001-09-01", "from lineitem 1995-01-01 2001-12-01"
TAGGED = """(SELECT o_orderkey, o_custkey, o_orderdate, string_split(o_orderpriority, '-') AS tags,
 CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS cust,
 o_totalprice AS price FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '2001-09-01')"""
E_IN = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'"
O_IN = "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '2001-09-01'"
L_IN = "l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '2001-12-01'"
N = "count(*)::DOUBLE AS m1"


def _time_sql(low: str, count: int, size: int, fmt: str) -> str:
    """Dense time buckets of events with labels and gutters."""
    at = lambda x: f"strftime(make_timestamp(({x}) * 1000000), '{fmt}')"
    start = f"epoch(TIMESTAMP '{low}')::BIGINT"
    return f"""
WITH b AS (SELECT i, {start} + i * {size} AS lo FROM (SELECT unnest(range({count}))::BIGINT AS i)),
c AS (SELECT (floor(epoch(ts))::BIGINT - {start}) // {size} AS i, count(*) AS n FROM events WHERE {E_IN} GROUP BY 1)
SELECT '[' || {at("b.lo")} || ', ' || {at(f"b.lo + {size}")} || ')' AS g1, coalesce(c.n, 0)::DOUBLE AS m1 FROM b LEFT JOIN c USING (i)
UNION ALL SELECT '< ' || {at(start)}, 0::DOUBLE
UNION ALL SELECT '>= ' || {at("epoch(TIMESTAMP '2024-01-31')::BIGINT")}, 0::DOUBLE"""


def _top_sql(table: str, where: str, key: str, score: str, order: str, k: int, parent: str = "") -> str:
    keys = f"{parent} AS g1, {key} AS g2" if parent else f"{key} AS g1"
    part = "PARTITION BY g1" if parent else ""
    own = "g2" if parent else "g1"
    outs = "g1, g2, m1" if parent else "g1, m1"
    group = f"{parent}, {key}" if parent else key
    return f"SELECT {outs} FROM (SELECT *, row_number() OVER ({part} ORDER BY s {order}, {own}) AS r FROM (SELECT {keys}, {score} AS s, {N} FROM {table} WHERE {where} GROUP BY {group})) WHERE r <= {k}"


PRICE = "sum(trunc(o_totalprice * 100)::BIGINT)::DOUBLE"

#: name: (query, SQL or None)
QUERIES: dict[str, tuple[str, str | None]] = {
    "group_field": (f"{EV} group by event_type select count()", f"SELECT event_type AS g1, {N} FROM events WHERE {E_IN} GROUP BY 1"),
    "no_group_totals": (f"{OR} select count(), floatscale(o_totalprice,100,0)", f"SELECT {N}, {PRICE} AS m2 FROM orders WHERE {O_IN}"),
    "select_first": (f"select count(), user_id {EV} where event_type=click group by user_id", f"SELECT user_id AS g1, {N}, sum(user_id)::DOUBLE AS m2 FROM events WHERE {E_IN} AND event_type = 'click' GROUP BY 1"),
    "metric_arith": (
        f"{OR} group by o_orderstatus select o_custkey+1, o_custkey*2, o_custkey\\7, o_custkey%7, abs(o_custkey-700)",
        f"SELECT o_orderstatus AS g1, sum(o_custkey+1)::DOUBLE AS m1, sum(o_custkey*2)::DOUBLE AS m2, sum(o_custkey//7)::DOUBLE AS m3, sum(o_custkey%7)::DOUBLE AS m4, sum(abs(o_custkey-700))::DOUBLE AS m5 FROM orders WHERE {O_IN} GROUP BY 1",
    ),
    "metric_compare": (
        f'{OR} select o_custkey<500, o_custkey=3, hasstr(o_orderstatus,"F"), o_orderstatus!="F", o_custkey>=700, hasint(o_custkey,5), 1-2',
        f"SELECT sum((o_custkey<500)::INT)::DOUBLE AS m1, sum((o_custkey=3)::INT)::DOUBLE AS m2, sum((o_orderstatus='F')::INT)::DOUBLE AS m3, sum((o_orderstatus<>'F')::INT)::DOUBLE AS m4, sum((o_custkey>=700)::INT)::DOUBLE AS m5, sum((o_custkey=5)::INT)::DOUBLE AS m6, -count(*)::DOUBLE AS m7 FROM orders WHERE {O_IN}",
    ),
    "metric_minmax": (
        f"{OR} select min(o_custkey,700), max(o_custkey,700,100), cached(o_custkey)",
        f"SELECT sum(least(o_custkey,700))::DOUBLE AS m1, sum(greatest(o_custkey,700,100))::DOUBLE AS m2, sum(o_custkey)::DOUBLE AS m3 FROM orders WHERE {O_IN}",
    ),
    "metric_exp_shift": (
        f"{LI} select exp(l_linenumber,10), mulshr(2,l_linenumber,l_partkey), shldiv(3,l_partkey,l_linenumber)",
        f"SELECT sum(trunc(10*exp(l_linenumber/10.0::DOUBLE))::BIGINT)::DOUBLE AS m1, sum((l_linenumber*l_partkey) >> 2)::DOUBLE AS m2, sum((l_partkey << 3) // l_linenumber)::DOUBLE AS m3 FROM lineitem WHERE {L_IN}",
    ),
    "agg_div": (
        f"{EV} group by event_type select floatscale(value,100,0)/count(), count()/7, count()/(user_id-user_id)",
        f"SELECT event_type AS g1, sum(trunc(value*100)::BIGINT)::DOUBLE/count(*)::DOUBLE AS m1, count(*)::DOUBLE/7 AS m2, 'inf'::DOUBLE AS m3 FROM events WHERE {E_IN} GROUP BY 1",
    ),
    "where_terms": (
        f"{EV} where event_type in (click,view) -event_type=view user_id!=3 group by user_id",
        f"SELECT user_id AS g1, {N} FROM events WHERE {E_IN} AND event_type = 'click' AND user_id <> 3 GROUP BY 1",
    ),
    "where_null_safe": (
        "from tagged 1995-01-01 2001-09-01 where status!=F -cust=1 cust not in (2,4) group by tags",
        f"SELECT g1, {N} FROM (SELECT unnest(list_distinct(tags)) AS g1 FROM {TAGGED} WHERE status IS DISTINCT FROM 'F' AND (cust IS NULL OR cust NOT IN (1,2,4))) GROUP BY 1",
    ),
    "where_regex": (f'{EV} where event_type=~"c.*|v.*w" group by event_type', f"SELECT event_type AS g1, {N} FROM events WHERE {E_IN} AND regexp_full_match(event_type, 'c.*|v.*w') GROUP BY 1"),
    "where_regex_not": (f'{EV} where event_type!=~"c.*|v.*w" group by event_type', f"SELECT event_type AS g1, {N} FROM events WHERE {E_IN} AND NOT regexp_full_match(event_type, 'c.*|v.*w') GROUP BY 1"),
    "where_between": (f"{EV} where between(user_id,10,50) and user_id%2=1 and user_id>=11 and -user_id<13", f"SELECT {N} FROM events WHERE {E_IN} AND user_id BETWEEN 13 AND 50 AND user_id % 2 = 1"),
    "where_missing_int": ("from tagged 1995-01-01 2001-09-01 where cust<10 select count(), cust", f"SELECT {N}, coalesce(sum(cust),0)::DOUBLE AS m2 FROM {TAGGED} WHERE coalesce(cust,0) < 10"),
    "where_sample": (
        f'{EV} where sample(user_id,10,100,"salt") group by user_id',
        f"SELECT user_id AS g1, {N} FROM events WHERE {E_IN} AND ('0x' || substr(md5('salt' || user_id::VARCHAR), 1, 8))::BIGINT * 100 < 10 * 4294967296 GROUP BY 1",
    ),
    "where_sample_not": (
        f'{EV} where -sample(user_id,10,100,"salt") group by user_id',
        f"SELECT user_id AS g1, {N} FROM events WHERE {E_IN} AND ('0x' || substr(md5('salt' || user_id::VARCHAR), 1, 8))::BIGINT * 100 >= 10 * 4294967296 GROUP BY 1",
    ),
    "where_text_query": (
        f'{EV} where lucene("(event_type:click OR event_type:vi*) AND NOT user_id:[3 TO 5]") group by event_type select count(), lucene("user_id:7")',
        f"SELECT event_type AS g1, {N}, sum((user_id=7)::INT)::DOUBLE AS m2 FROM events WHERE {E_IN} AND (event_type = 'click' OR event_type LIKE 'vi%') AND NOT user_id BETWEEN 3 AND 5 GROUP BY 1",
    ),
    "group_two": (f"{OR} group by o_orderstatus, o_orderpriority", f"SELECT o_orderstatus AS g1, o_orderpriority AS g2, {N} FROM orders WHERE {O_IN} GROUP BY 1, 2"),
    "group_null_keys": ("from tagged 1995-01-01 2001-09-01 group by status, cust where_cust".replace(" where_cust", ""), f"SELECT status AS g1, cust AS g2, {N} FROM {TAGGED} WHERE status IS NOT NULL AND cust IS NOT NULL GROUP BY 1, 2"),
    "group_explode": (
        f"{OR} where o_custkey<20 group by o_custkey, o_orderpriority*",
        f"WITH d AS (SELECT * FROM orders WHERE {O_IN} AND o_custkey < 20) SELECT p.k AS g1, t.t AS g2, count(d.o_orderkey)::DOUBLE AS m1 FROM (SELECT DISTINCT o_custkey AS k FROM d) p CROSS JOIN (SELECT DISTINCT o_orderpriority AS t FROM d) t LEFT JOIN d ON d.o_custkey = p.k AND d.o_orderpriority = t.t GROUP BY 1, 2",
    ),
    "group_lone_explode": (f"{EV} group by event_type*", f"SELECT event_type AS g1, {N} FROM events WHERE {E_IN} GROUP BY 1"),
    "group_in_last": (f"{EV} group by event_type in (click,zzz,click)", f"SELECT event_type AS g1, {N} FROM events WHERE {E_IN} AND event_type = 'click' GROUP BY 1"),
    "group_in_first": (
        f"{EV} group by event_type in (click,zzz), user_id in (1,2)",
        f"SELECT event_type AS g1, user_id AS g2, {N} FROM events WHERE {E_IN} AND event_type IN ('click','zzz') AND user_id IN (1,2) GROUP BY 1, 2",
    ),
    "group_in_dense": (
        f"{EV} group by event_type in (click,zzz) select count(), distinct(user_id)",
        f"SELECT g1, coalesce(m1,0)::DOUBLE AS m1, coalesce(m2,0)::DOUBLE AS m2 FROM (VALUES ('click'),('zzz')) v(g1) LEFT JOIN (SELECT event_type AS g1, count(*) AS m1, count(DISTINCT user_id) AS m2 FROM events WHERE {E_IN} GROUP BY 1) USING (g1)",
    ),
    "terms_to_grouping": (f"{EV} where event_type in (click,view) group by event_type", f"SELECT event_type AS g1, {N} FROM events WHERE {E_IN} AND event_type IN ('click','view') GROUP BY 1"),
    "top_k": (f"{OR} group by o_custkey[top 5 by floatscale(o_totalprice,100,0)]", _top_sql("orders", O_IN, "o_custkey", PRICE, "DESC", 5)),
    "bottom_k": (f"{OR} group by o_custkey[bottom 3]", _top_sql("orders", O_IN, "o_custkey", "count(*)", "ASC", 3)),
    "top_k_nested": (f"{OR} group by o_orderstatus, o_custkey[3]", _top_sql("orders", O_IN, "o_custkey", "count(*)", "DESC", 3, "o_orderstatus")),
    "top_k_ratio": (f"{OR} group by o_custkey[4 by o_orderstatus=F / count()]", _top_sql("orders", O_IN, "o_custkey", "sum((o_orderstatus='F')::INT)::DOUBLE/count(*)", "DESC", 4)),
    "top_k_first": (
        f"{OR} group by o_custkey[top 4], o_orderstatus",
        f"SELECT o_custkey AS g1, o_orderstatus AS g2, {N} FROM orders WHERE {O_IN} AND o_custkey IN (SELECT o_custkey FROM orders WHERE {O_IN} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4) GROUP BY 1, 2",
    ),
    "top_k_empty_parent": (
        f"{EV} group by event_type in (click,zzz), props[0] select count()".replace("props[0]", "event_type[1]"),
        f"SELECT 'click' AS g1, 'click' AS g2, {N} FROM events WHERE {E_IN} AND event_type = 'click' UNION ALL SELECT 'zzz', '', 0::DOUBLE",
    ),
    "top_terms": (f'{OR} group by topterms(o_custkey,4,o_custkey,"bottom")', _top_sql("orders", O_IN, "o_custkey", "sum(o_custkey)", "ASC", 4)),
    "difference": (
        f'{OR} group by diff(o_custkey, o_orderstatus="F", o_orderstatus="O", 5) select floatscale(o_totalprice,1,0)',
        f"WITH s AS (SELECT o_custkey AS g1, CASE WHEN o_orderstatus='F' THEN trunc(o_totalprice)::BIGINT ELSE 0 END AS a, CASE WHEN o_orderstatus='O' THEN trunc(o_totalprice)::BIGINT ELSE 0 END AS b FROM orders WHERE {O_IN}) SELECT g1, sum(abs(a-b))::DOUBLE AS m1, sum(a)::DOUBLE AS m2, sum(b)::DOUBLE AS m3 FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    ),
    "buckets": (
        f"{OR} group by buckets(o_custkey,100,1000,250)",
        f"""WITH b AS (SELECT * FROM (VALUES (0,'[100, 350)'),(1,'[350, 600)'),(2,'[600, 850)'),(3,'[850, 1100)'),(4,'< 100'),(5,'>= 1000')) v(i,g1)),
c AS (SELECT CASE WHEN o_custkey < 100 THEN 4 WHEN o_custkey >= 1000 THEN 5 ELSE (o_custkey-100)//250 END AS i, count(*) AS n FROM orders WHERE {O_IN} GROUP BY 1)
SELECT g1, coalesce(n,0)::DOUBLE AS m1 FROM b LEFT JOIN c USING (i)""",
    ),
    "buckets_no_gutters": (
        f"{OR} group by buckets(o_custkey,-500,1000,500,true), o_orderstatus",
        f"SELECT CASE WHEN o_custkey < 500 THEN '[0, 500)' ELSE '[500, 1000)' END AS g1, o_orderstatus AS g2, {N} FROM orders WHERE {O_IN} AND o_custkey < 1000 GROUP BY 1, 2",
    ),
    "buckets_grid": (
        f"{OR} group by buckets(o_custkey,0,1000,500,o_orderkey,0,4000,2000)",
        f"""WITH x AS (SELECT * FROM (VALUES (0,'[0, 500)'),(1,'[500, 1000)'),(2,'< 0'),(3,'>= 1000')) v(i,a)), y AS (SELECT * FROM (VALUES (0,'[0, 2000)'),(1,'[2000, 4000)'),(2,'< 0'),(3,'>= 4000')) v(j,b)),
c AS (SELECT CASE WHEN o_custkey >= 1000 THEN 3 ELSE o_custkey//500 END AS i, CASE WHEN o_orderkey >= 4000 THEN 3 ELSE o_orderkey//2000 END AS j, count(*) AS n FROM orders WHERE {O_IN} GROUP BY 1, 2)
SELECT a || ', ' || b AS g1, coalesce(n,0)::DOUBLE AS m1 FROM x CROSS JOIN y LEFT JOIN c USING (i, j)""",
    ),
    "time_hours": (f"{EV} group by time(6)", _time_sql("2024-01-01", 120, 21600, "%Y-%m-%d %H:%M:%S")),
    "time_count": (f"{EV} group by time(5b)", _time_sql("2024-01-01", 5, 518400, "%Y-%m-%d %H:%M:%S")),
    "time_inferred": (f"{EV} group by time", _time_sql("2024-01-01", 720, 3600, "%Y-%m-%d %H:%M:%S")),
    "time_format": (f'{EV} group by time(1d,"YYYY-MM-dd")', _time_sql("2024-01-01", 30, 86400, "%Y-%m-%d")),
    "distinct": (
        f"{EV} group by event_type select count(), distinct(user_id), distinct(event_id)",
        f"SELECT event_type AS g1, {N}, count(DISTINCT user_id)::DOUBLE AS m2, count(DISTINCT event_id)::DOUBLE AS m3 FROM events WHERE {E_IN} GROUP BY 1",
    ),
    "distinct_many": ("from tagged 1995-01-01 2001-09-01 select distinct(tags), count()", f"SELECT (SELECT count(DISTINCT t)::DOUBLE FROM (SELECT unnest(tags) AS t FROM {TAGGED})) AS m1, count(*)::DOUBLE AS m2 FROM {TAGGED}"),
    "percentile": (
        f"{EV} group by event_type select percentile(user_id,50), percentile(user_id,90), percentile(user_id,0)",
        f"""WITH c AS (SELECT event_type AS g1, user_id AS t, count(*) AS c FROM events WHERE {E_IN} GROUP BY 1, 2),
r AS (SELECT *, sum(c) OVER (PARTITION BY g1 ORDER BY t) AS u, sum(c) OVER (PARTITION BY g1) AS n FROM c)
SELECT g1, min(CASE WHEN u >= 50/100.0::DOUBLE*n THEN t END)::DOUBLE AS m1, min(CASE WHEN u >= 90/100.0::DOUBLE*n THEN t END)::DOUBLE AS m2, max(t)::DOUBLE AS m3 FROM r GROUP BY 1""",
    ),
    "percentile_missing": (
        "from tagged 1995-01-01 2001-09-01 select percentile(cust,20), percentile(cust,90)",
        f"""WITH c AS (SELECT cust AS t, count(*) AS c FROM {TAGGED} WHERE cust IS NOT NULL GROUP BY 1), r AS (SELECT *, sum(c) OVER (ORDER BY t) AS u, (SELECT count(*) FROM {TAGGED}) AS n FROM c)
SELECT coalesce(min(CASE WHEN u >= 20/100.0::DOUBLE*n THEN t END), max(t))::DOUBLE AS m1, coalesce(min(CASE WHEN u >= 90/100.0::DOUBLE*n THEN t END), max(t))::DOUBLE AS m2 FROM r""",
    ),
    "alias_dayofweek": (
        f"{EV} group by buckets(dayofweek,0,7,1,true)",
        f"WITH c AS (SELECT ((floor(epoch(ts))::BIGINT-280800)%604800)//86400 AS i, count(*) AS n FROM events WHERE {E_IN} GROUP BY 1) SELECT '[' || i || ', ' || (i+1) || ')' AS g1, coalesce(n,0)::DOUBLE AS m1 FROM (SELECT unnest(range(7)) AS i) LEFT JOIN c USING (i)",
    ),
    "alias_metrics": (f"{OR} group by o_orderstatus select counts, twice, cents", f"SELECT o_orderstatus AS g1, {N}, sum(2*o_custkey)::DOUBLE AS m2, {PRICE} AS m3 FROM orders WHERE {O_IN} GROUP BY 1"),
    "floatscale_text": ("from tagged 1995-01-01 2001-09-01 select floatscale(price,10,5)", f"SELECT sum(trunc(price*10+5)::BIGINT)::DOUBLE AS m1 FROM {TAGGED}"),
    "many_values": (
        "from tagged 1995-01-01 2001-09-01 where tags=1 group by tags select count(), distinct(o_custkey)",
        f"SELECT g1, {N}, count(DISTINCT o_custkey)::DOUBLE AS m2 FROM (SELECT unnest(list_distinct(tags)) AS g1, o_custkey FROM {TAGGED} WHERE list_contains(tags,'1')) GROUP BY 1",
    ),
    "token_field": (
        'from documents 2000 2030 where text="the and" group by text[top 10]',
        r"""WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w FROM documents)
SELECT g1, count(*)::DOUBLE AS m1 FROM (SELECT unnest(w) AS g1 FROM d WHERE list_contains(w,'the') AND list_contains(w,'and')) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    ),
    "limit": (f"{OR} group by o_custkey limit 7", f"SELECT o_custkey AS g1, {N} FROM orders WHERE {O_IN} GROUP BY 1 ORDER BY 1 LIMIT 7"),
    "relative_dates": ("from events 14d today group by event_type", f"SELECT event_type AS g1, {N} FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1"),
    "show_tables": ("show tables", "SELECT * FROM (VALUES ('documents',''),('events',''),('lineitem',''),('orders',''),('tagged','')) v(dataset, description)"),
    "describe_dataset": ("describe events", "SELECT * FROM (VALUES ('event_id','int',''),('ts','time',''),('user_id','int',''),('event_type','string',''),('value','float',''),('props','string','')) v(name, kind, description)"),
    "describe_field": ("describe events.event_type", "SELECT event_type AS term, count(*) AS \"rows\" FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100"),
}


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals count the rows that a list of terms, moved to the grouping, would leave out."""
    return engine(spark, sf_dir).compiler(f"{EV} where event_type in (click,view) user_id<50 group by event_type select count(), user_id").totals()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: (lambda spark, sf_dir, q=q: engine(spark, sf_dir).query(q)) for name, (q, _) in QUERIES.items()}
    return found | {"totals": totals}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql} | {
        "totals": f"SELECT {N}, sum(user_id)::DOUBLE AS m2 FROM events WHERE {E_IN} AND user_id < 50"
    }
