"""All queries by name, each with the SQL that says the same.

The tables' events stand for ad events: the user is the ad, and the customer table
maps it to its nation as campaign.  Windows span a day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions.scalar import keyed_count, keyed_sum, map_values, reduce_values, times_ten
from rillmark.functions.time import DAY_MS, hex_prefix
from rillmark.operators import events as ev
from rillmark.operators import predicates as p
from rillmark.operators import relational as rel
from rillmark.sources import fixedwidth, generator
from rillmark.sources.tables import campaign_table, event_stream, table
from rillmark.storage import scratch
from rillmark.streaming.run import finish, finish_each, finish_ordered, in_utc
from rillmark.streaming.windows import Slices, multi_query_sink, ratio_join_stream, sliding_sink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Windows of the multi-size query and slices of a sliding window; partitions of the streams' state here.
QUERY_SIZES, SLIDING, STATE_PARTITIONS = 4, 4, 8


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _clicks(spark: SparkSession, d: str) -> DataFrame:
    return ev.filter_events(table(spark, d, "events"))


def _campaigns(spark: SparkSession, d: str) -> DataFrame:
    # customer keys are unique, so each ad has one campaign
    return campaign_table(table(spark, d, "customer"))


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return ev.join_campaign(_clicks(spark, d), _campaigns(spark, d))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "events").filter(F.col("event_type").isin("click", "view")).select("ts", "user_id", "event_type")
    return ev.join_campaign(both, _campaigns(spark, d))


_ENRICHED = "SELECT e.ts, c.c_nationkey AS c_id FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'click'"
_COUNTS = f"SELECT (epoch_us(ts) // 1000) // {DAY_MS} AS wid, c_id, count(*) AS cnt, max(ts) AS max_event_time FROM ({_ENRICHED}) GROUP BY ALL"
_RATIO = f"""SELECT wid, c_id, click_count, view_count, click_count / view_count AS ratio, max_event_time FROM (
  SELECT (epoch_us(e.ts) // 1000) // {DAY_MS} AS wid, c.c_nationkey AS c_id, count(*) FILTER (WHERE event_type = 'click') AS click_count,
         greatest(count(*) FILTER (WHERE event_type = 'view'), 1) AS view_count, max(e.ts) AS max_event_time
  FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE event_type IN ('click', 'view') GROUP BY ALL)"""
_MULTI = f"""WITH s AS ({_COUNTS}), q AS (SELECT unnest(range(1, {QUERY_SIZES + 1})) AS query_id),
w AS (SELECT q.query_id, s.wid // q.query_id AS wid, s.wid AS slice_id, s.c_id, s.cnt, s.max_event_time FROM s, q),
f AS (SELECT query_id, wid FROM w GROUP BY query_id, wid HAVING count(DISTINCT slice_id) = query_id)
SELECT CAST(w.query_id AS INTEGER) AS query_id, w.wid, w.c_id, CAST(sum(w.cnt) AS BIGINT) AS cnt, max(w.max_event_time) AS max_event_time
FROM w JOIN f USING (query_id, wid) GROUP BY ALL"""
_SLIDING = f"""WITH s AS ({_COUNTS}), w AS (SELECT s.wid - k.k AS wid, s.wid AS slice_id, s.c_id, s.cnt, s.max_event_time FROM s, (SELECT unnest(range(0, {SLIDING})) AS k) k),
f AS (SELECT wid FROM w GROUP BY wid HAVING count(DISTINCT slice_id) = {SLIDING})
SELECT w.wid, w.c_id, CAST(sum(w.cnt) AS BIGINT) AS cnt, max(w.max_event_time) AS max_event_time FROM w JOIN f USING (wid) GROUP BY ALL"""


# ---- ad events, batch


@query("SELECT ts, user_id FROM events WHERE event_type = 'click'")
def ysb_filter_project(spark, d):
    return _clicks(spark, d)


@query(_ENRICHED)
def ysb_enriched(spark, d):
    return _enriched(spark, d).select("ts", "c_id")


@query(_COUNTS)
def ysb_click_counts(spark, d):
    return ev.window_counts(_enriched(spark, d), span_ms=DAY_MS)


@query(f"SELECT * FROM ({_COUNTS}) ORDER BY wid, c_id")
def ysb_click_counts_ordered(spark, d):
    return ysb_click_counts(spark, d).orderBy("wid", "c_id")


@query(_RATIO)
def ysb_ratio(spark, d):
    return ev.click_view_ratio(_typed(spark, d), span_ms=DAY_MS)


@query(f"SELECT * FROM ({_RATIO}) ORDER BY wid, c_id")
def ysb_ratio_ordered(spark, d):
    return ysb_ratio(spark, d).orderBy("wid", "c_id")


@query("""SELECT CASE WHEN event_type = 'click' THEN 'click' ELSE 'view' END AS branch, ts, user_id FROM events WHERE event_type IN ('click', 'view')""")
def ysb_route(spark, d):
    # one scan; the event's type is its branch
    both = table(spark, d, "events").filter(F.col("event_type").isin("click", "view"))
    return both.select(F.col("event_type").alias("branch"), "ts", "user_id")


@query(f"SELECT wid AS slice_id, c_id, cnt, max_event_time FROM ({_COUNTS})")
def ysb_slices(spark, d):
    return ev.slices(_enriched(spark, d), span_ms=DAY_MS)


@query(_MULTI)
def ysb_multi_query(spark, d):
    return ev.multi_query(ysb_slices(spark, d), QUERY_SIZES)


@query(f"SELECT * FROM ({_MULTI}) ORDER BY query_id, wid, c_id")
def ysb_multi_query_ordered(spark, d):
    return ysb_multi_query(spark, d).orderBy("query_id", "wid", "c_id")


@query(_SLIDING)
def ysb_sliding(spark, d):
    return ev.sliding(ysb_slices(spark, d), SLIDING)


@query(f"SELECT * FROM ({_SLIDING}) ORDER BY wid, c_id")
def ysb_sliding_ordered(spark, d):
    return ysb_sliding(spark, d).orderBy("wid", "c_id")


@query(f"SELECT (epoch_us(ts) // 1000) // {DAY_MS} AS wid, count(*) AS cnt, max(ts) AS max_event_time FROM events GROUP BY ALL")
def window_total_count(spark, d):
    return ev.total_counts(table(spark, d, "events"), span_ms=DAY_MS)


@query(f"SELECT wid, CAST(sum((wid + 1) * {DAY_MS} - (epoch_us(max_event_time)) // 1000) AS BIGINT) AS latency_ms FROM ({_COUNTS}) GROUP BY wid")
def latency_sum(spark, d):
    return ev.window_latency(ysb_click_counts(spark, d), span_ms=DAY_MS)


@query("SELECT (epoch_us(ts) // 1000) // 1000 AS second, count(*) AS cnt FROM events GROUP BY ALL")
def throughput_per_second(spark, d):
    return ev.throughput(table(spark, d, "events"))


@query("SELECT avg(cnt) AS avg_throughput FROM (SELECT (epoch_us(ts) // 1000) // 1000 AS second, count(*) AS cnt FROM events GROUP BY ALL)")
def throughput_average(spark, d):
    return ev.average_throughput(table(spark, d, "events"))


@query(f"""SELECT wid, c_id, cnt AS actual_count, cnt AS result_count, true AS correct FROM ({_COUNTS})""")
def sanity_check(spark, d):
    return ev.sanity_check(ysb_click_counts(spark, d), _clicks(spark, d), _campaigns(spark, d), span_ms=DAY_MS)


@query(f"""SELECT a.wid, CAST(sum(a.cnt) AS BIGINT) AS obtained, CAST(sum(a.cnt) AS BIGINT) AS actual FROM ({_COUNTS}) a GROUP BY a.wid""")
def sanity_check_totals(spark, d):
    return sanity_check(spark, d).groupBy("wid").agg(F.sum("result_count").alias("obtained"), F.sum("actual_count").alias("actual"))


# ---- map, reduce, keyed aggregates


@query("SELECT p_partkey, p_size * 100 AS p_size FROM part")
def map_x10_twice(spark, d):
    return map_values(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", times_ten, times_ten)


@query("SELECT CAST(sum(p_size * 10) AS BIGINT) AS p_size FROM part")
def map_reduce_sum(spark, d):
    return reduce_values(map_values(table(spark, d, "part").select("p_size"), "p_size", times_ten), "p_size")


@query("SELECT p_brand, count(*) AS cnt FROM part GROUP BY p_brand")
def keyed_counts(spark, d):
    return keyed_count(table(spark, d, "part"), "p_brand")


@query("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY p_brand")
def keyed_sums(spark, d):
    return keyed_sum(table(spark, d, "part"), "p_brand", "p_size")


# ---- relational toolkit

def _big():
    return p.greater("l_quantity", 45.0), p.equal("l_returnflag", "R")


_BIG_SQL = "l_quantity > 45 AND l_returnflag = 'R'"


@query(f"SELECT * FROM lineitem WHERE {_BIG_SQL}")
def rel_select(spark, d):
    return rel.select(table(spark, d, "lineitem"), *_big())


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE {_BIG_SQL}")
def rel_select_project(spark, d):
    return rel.select_project(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice"], *_big())


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000")
def rel_select_distinct(spark, d):
    wanted = rel.select_project(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], p.greater("o_totalprice", 100_000.0))
    return rel.select_distinct(wanted)


@query("SELECT o_orderstatus FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000)")
def rel_select_project_distinct(spark, d):
    wanted = rel.select_project(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], p.greater("o_totalprice", 100_000.0))
    return rel.select_project_distinct(wanted, ["o_orderstatus"])


@query("SELECT p_partkey, p_size, p_retailprice, p_brand FROM part WHERE p_size > 40 AND p_retailprice > 950.0 AND p_brand > 'Brand#3'")
def rel_gt(spark, d):
    conditions = (p.greater("p_size", 40), p.greater("p_retailprice", 950.0), p.greater("p_brand", "Brand#3"))
    return rel.select_project(table(spark, d, "part"), ["p_partkey", "p_size", "p_retailprice", "p_brand"], *conditions)


@query("SELECT p_partkey, p_size, p_retailprice, p_brand FROM part WHERE p_size < 20 AND p_retailprice < 1500.0 AND p_brand < 'Brand#3'")
def rel_lt(spark, d):
    conditions = (p.less("p_size", 20), p.less("p_retailprice", 1500.0), p.less("p_brand", "Brand#3"))
    return rel.select_project(table(spark, d, "part"), ["p_partkey", "p_size", "p_retailprice", "p_brand"], *conditions)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_linenumber = 1 AND l_quantity = 10.0 AND l_returnflag = 'N'")
def rel_eq(spark, d):
    conditions = (p.equal("l_linenumber", 1), p.equal("l_quantity", 10.0), p.equal("l_returnflag", "N"))
    return rel.select_project(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"], *conditions)


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_type LIKE '%E%' AND p_name LIKE '_a%'")
def rel_like(spark, d):
    return rel.select_project(table(spark, d, "part"), ["p_partkey", "p_name", "p_type"], p.like("p_type", "%E%"), p.like("p_name", "_a%"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    # sums of doubles depend on their order in the last digits
    return df.withColumns({c: F.round(c, 4) for c in columns})


@query("""SELECT l_returnflag, l_linestatus, min(l_quantity) AS min_qty, max(l_extendedprice) AS max_price, count(*) AS cnt,
       round(sum(l_extendedprice), 4) AS sum_price, round(avg(l_discount), 4) AS avg_disc FROM lineitem WHERE l_quantity > 5 GROUP BY ALL""")
def rel_group_by(spark, d):
    aggregates = {"min_qty": ("min", "l_quantity"), "max_price": ("max", "l_extendedprice"), "cnt": ("count", None), "sum_price": ("sum", "l_extendedprice"), "avg_disc": ("avg", "l_discount")}
    return _rounded(rel.group_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], aggregates, p.greater("l_quantity", 5.0)), "sum_price", "avg_disc")


@query("SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS cnt, round(avg(o_totalprice), 4) AS mean FROM orders")
def rel_group_by_all(spark, d):
    aggregates = {"low": ("min", "o_totalprice"), "high": ("max", "o_totalprice"), "cnt": ("count", None), "mean": ("avg", "o_totalprice")}
    return _rounded(rel.group_by_all(table(spark, d, "orders"), aggregates), "mean")


@query("SELECT sum(o_totalprice) AS total, count(*) AS cnt FROM orders WHERE o_totalprice < 0")
def rel_group_by_all_empty(spark, d):
    return rel.group_by_all(table(spark, d, "orders"), {"total": ("sum", "o_totalprice"), "cnt": ("count", None)}, p.less("o_totalprice", 0.0))


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def rel_smj_inner(spark, d):
    return rel.join(table(spark, d, "orders"), table(spark, d, "lineitem"), [("o_orderkey", "l_orderkey")], ["o_orderkey", "o_custkey", "l_linenumber", "l_quantity"])


@query("""SELECT a.l_orderkey AS left_order, b.l_orderkey AS right_order, a.l_partkey AS partkey, a.l_suppkey AS suppkey FROM lineitem a JOIN lineitem b
       ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2""")
def rel_smj_composite(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    left = rel.select(lines, p.equal("l_linenumber", 1)).selectExpr("l_orderkey as left_order", "l_partkey as partkey", "l_suppkey as suppkey")
    right = rel.select(lines, p.equal("l_linenumber", 2)).selectExpr("l_orderkey as right_order", "l_partkey as p2", "l_suppkey as s2")
    return rel.join(left, right, [("partkey", "p2"), ("suppkey", "s2")], ["left_order", "right_order", "partkey", "suppkey"])


@query("""SELECT a.l_orderkey AS left_order, a.l_linenumber AS left_line, b.l_orderkey AS right_order, b.l_linenumber AS right_line,
       a.l_partkey AS partkey, a.l_suppkey AS suppkey FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey""")
def rel_smj_composite_all(spark, d):
    lines = table(spark, d, "lineitem")
    left = lines.selectExpr("l_orderkey as left_order", "l_linenumber as left_line", "l_partkey as partkey", "l_suppkey as suppkey")
    right = lines.selectExpr("l_orderkey as right_order", "l_linenumber as right_line", "l_partkey as p2", "l_suppkey as s2")
    return rel.join(left, right, [("partkey", "p2"), ("suppkey", "s2")], ["left_order", "left_line", "right_order", "right_line", "partkey", "suppkey"])


@query("""SELECT o_orderkey, l_linenumber, o_totalprice, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       WHERE o_totalprice > 200000 AND l_quantity < 25""")
def rel_smj_cond_project(spark, d):
    conditions = (p.greater("o_totalprice", 200_000.0), p.less("l_quantity", 25.0))
    return rel.join(table(spark, d, "orders"), table(spark, d, "lineitem"), [("o_orderkey", "l_orderkey")], ["o_orderkey", "l_linenumber", "o_totalprice", "l_extendedprice"], *conditions)


@query("""SELECT o_orderpriority, count(*) AS cnt, round(sum(l_extendedprice), 4) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       WHERE l_returnflag = 'R' GROUP BY o_orderpriority""")
def rel_join_then_group(spark, d):
    met = rel.join(table(spark, d, "orders"), table(spark, d, "lineitem"), [("o_orderkey", "l_orderkey")], None, p.equal("l_returnflag", "R"))
    return _rounded(rel.group_by(met, ["o_orderpriority"], {"cnt": ("count", None), "revenue": ("sum", "l_extendedprice")}), "revenue")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderkey")
def rel_sort_int(spark, d):
    return rel.sort(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("SELECT c_name, c_custkey, c_mktsegment FROM customer ORDER BY c_name, CAST(c_custkey AS VARCHAR)")
def rel_sort_strings(spark, d):
    return rel.sort_strings(table(spark, d, "customer").select("c_name", "c_custkey", "c_mktsegment"), "c_name", "c_custkey")


@query("SELECT c_name, c_custkey, c_mktsegment FROM customer ORDER BY c_name, CAST(c_custkey AS VARCHAR) LIMIT 25")
def rel_sort_string_top25(spark, d):
    return rel.top(table(spark, d, "customer").select("c_name", "c_custkey", "c_mktsegment"), ["c_name", "c_custkey"])


@query("SELECT ts, user_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def union_inputs(spark, d):
    columns = ("ts", "user_id", "event_type")
    return rel.union_all(*[ev.filter_events(table(spark, d, "events"), kind, columns=columns) for kind in ("click", "view")])


@query("SELECT CAST((l_partkey + l_suppkey) % 4 AS INTEGER) AS shard, count(*) AS cnt FROM lineitem GROUP BY ALL")
def hash_shard(spark, d):
    return table(spark, d, "lineitem").groupBy(rel.shard_of(["l_partkey", "l_suppkey"], 4).alias("shard")).agg(F.count("*").alias("cnt"))


@query("""SELECT u, CAST('0x' || split_part(u, '-', 1) AS BIGINT) AS c_id FROM (VALUES
       ('0c0ccf0d-6a4b-42e8-8c7e-19cf0ea5fe64'), ('ffffffff-0000-4000-8000-000000000000'), ('00000001-0000-4000-8000-000000000000')) t(u)""")
def hex_campaign_id(spark, d):
    ids = ["0c0ccf0d-6a4b-42e8-8c7e-19cf0ea5fe64", "ffffffff-0000-4000-8000-000000000000", "00000001-0000-4000-8000-000000000000"]
    return spark.createDataFrame([(u,) for u in ids], "u string").withColumn("c_id", hex_prefix("u"))


# ---- sources and sinks


@query("SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, l_linenumber, CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS l_quantity, l_returnflag FROM lineitem")
def binary_roundtrip(spark, d):
    fields = [("l_orderkey", "int"), ("l_linenumber", "int"), ("l_quantity", "float"), ("l_returnflag", 4)]
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("int"), "l_linenumber", F.col("l_quantity").cast("float"), "l_returnflag")
    folder = scratch(spark)
    fixedwidth.write_fixed(rows, folder, fields).agg(F.sum("rows")).collect()
    return fixedwidth.read_fixed(spark, folder, fields).withColumn("l_quantity", F.col("l_quantity").cast("double"))


@query("SELECT CAST(i * 100 AS INTEGER) AS value FROM range(0, 20000) t(i)")
def int_file_mapped(spark, d):
    folder = scratch(spark)
    fixedwidth.write_ints(spark, folder, 20_000).agg(F.sum("rows")).collect()
    return map_values(fixedwidth.read_fixed(spark, folder, [("value", "int")]), "value", times_ten, times_ten)


@query()
def generated_click_counts(spark, d):
    made = generator.generate(spark, 1000, 40)
    clicks = ev.filter_events(made, columns=("event_time", "ad_id")).select(F.col("event_time").alias("ts"), "ad_id")
    clicks = in_utc(clicks, "ts")
    return ev.window_counts(ev.join_campaign(clicks, generator.campaigns(spark), ad_col="ad_id"), span_ms=10_000)


# ---- streams: each runs over all input there is; windows still open at the end don't come out


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return event_stream(spark, d).select("ts", "user_id", "event_type")


def _stream_clicks(spark: SparkSession, d: str) -> DataFrame:
    return ev.join_campaign(ev.filter_events(_stream(spark, d)), _campaigns(spark, d))


def _closed(sql: str, kinds: str, slices: int = 1, key: str = "wid") -> str:
    """The rows of windows of so many days that have ended at the last event of the kinds."""
    return f"SELECT * FROM ({sql}) WHERE ({key} + {slices}) * {DAY_MS} <= (SELECT (epoch_us(max(ts)) // 1000) FROM events WHERE event_type IN ({kinds}))"


def _finish(stream: DataFrame) -> DataFrame:
    return in_utc(finish(stream, partitions=STATE_PARTITIONS), "max_event_time")


@query(_closed(_COUNTS, "'click'"))
def stream_click_counts(spark, d):
    return _finish(ev.window_counts(_stream_clicks(spark, d), span_ms=DAY_MS))


@query(f"SELECT * FROM ({_closed(_COUNTS, chr(39) + 'click' + chr(39))}) ORDER BY wid, c_id")
def stream_click_counts_ordered(spark, d):
    done = finish_ordered(ev.window_counts(_stream_clicks(spark, d), span_ms=DAY_MS), ["wid", "c_id"], partitions=STATE_PARTITIONS)
    return in_utc(done, "max_event_time")


@query(_closed(_RATIO, "'click', 'view'"))
def stream_ratio(spark, d):
    typed = _stream(spark, d).filter(F.col("event_type").isin("click", "view"))
    return _finish(ev.click_view_ratio(ev.join_campaign(typed, _campaigns(spark, d)), span_ms=DAY_MS))


@query(_closed(_RATIO, "'click', 'view'"))
def stream_ratio_join(spark, d):
    return _finish(ratio_join_stream(ev.join_campaign(_stream(spark, d), _campaigns(spark, d)), span_ms=DAY_MS))


@query(f"""SELECT * FROM (SELECT (epoch_us(ts) // 1000) // {DAY_MS} AS wid, count(*) AS cnt, max(ts) AS max_event_time FROM events GROUP BY ALL)
       WHERE (wid + 1) * {DAY_MS} <= (SELECT (epoch_us(max(ts)) // 1000) FROM events)""")
def stream_total_count(spark, d):
    return _finish(ev.total_counts(_stream(spark, d), span_ms=DAY_MS))


def _of_slices(spark: SparkSession, d: str, sink, reach: int, columns: str) -> DataFrame:
    """Windows that `sink` makes of a stream's closed slices, each as soon as its last slice has closed."""
    counted = ev.window_counts(_stream_clicks(spark, d), span_ms=DAY_MS)
    campaign = counted.schema["c_id"].dataType.simpleString()
    schema = spark.createDataFrame([], f"{columns} bigint, c_id {campaign}, cnt bigint, max_event_time timestamp").schema
    done = finish_each(counted, lambda emit: sink(Slices(spark, scratch(spark), reach), reach, emit), schema, partitions=STATE_PARTITIONS)
    return in_utc(done, "max_event_time")


@query(_closed(_SLIDING, "'click'", SLIDING))
def stream_sliding(spark, d):
    return _of_slices(spark, d, sliding_sink, SLIDING, "wid")


@query(_MULTI.replace(_COUNTS, _closed(_COUNTS, "'click'")))
def stream_multi_query(spark, d):
    return _of_slices(spark, d, multi_query_sink, QUERY_SIZES, "query_id int, wid")


@query(_SLIDING.replace(_COUNTS, _closed(_COUNTS, "'click'")))
def stream_sliding_slices(spark, d):
    # by the batch operator, over the slices of a stream that has ended
    return ev.sliding(stream_click_counts(spark, d).withColumnRenamed("wid", "slice_id"), SLIDING)
