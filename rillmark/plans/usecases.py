"""The use cases by their codes, over generated events: live for some seconds, or as finite batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillmark.functions.scalar import map_values, reduce_values, times_ten
from rillmark.functions.time import SPAN_MS
from rillmark.operators import events as ev
from rillmark.operators import relational as rel
from rillmark.sources.generator import ADS, campaigns, generate, generate_stream
from rillmark.storage import scratch
from rillmark.streaming.run import in_utc
from rillmark.streaming.windows import Slices, multi_query_sink, sliding_sink


@dataclass
class Settings:
    """Events a second, queries (or slices of a sliding window), seconds to run, and milliseconds of a window."""

    rate: int = 10_000
    queries: int = 4
    seconds: int = 60
    span_ms: int = SPAN_MS
    ads: int = ADS


def _typed(events: DataFrame, table: DataFrame) -> DataFrame:
    """Enriched clicks and views."""
    own = events.filter(F.col("event_type").isin("click", "view")).select(F.col("event_time").alias("ts"), "ad_id", "event_type")
    return ev.join_campaign(own, table, ad_col="ad_id")


def _counts(events: DataFrame, table: DataFrame, s: Settings) -> DataFrame:
    return ev.window_counts(_typed(events, table).filter("event_type = 'click'"), span_ms=s.span_ms)


def _ratio(events: DataFrame, table: DataFrame, s: Settings) -> DataFrame:
    return ev.click_view_ratio(_typed(events, table), span_ms=s.span_ms)


def _total(events: DataFrame, table: DataFrame, s: Settings) -> DataFrame:
    return ev.total_counts(events.select(F.col("event_time").alias("ts")), span_ms=s.span_ms)


#: Code: (what streams, columns that order the rows or None, what is built of the closed windows, count of events in a row).
STREAMS: dict[str, tuple[Callable, list[str] | None, str | None, str]] = {
    "YSB": (_counts, None, None, "cnt"),
    "YSBS": (_counts, ["wid", "c_id"], None, "cnt"),
    "YSBM": (_ratio, None, None, "click_count + view_count"),
    "YSBMS": (_ratio, ["wid", "c_id"], None, "click_count + view_count"),
    "YSBMQ": (_counts, None, "queries", "cnt"),
    "YSBMQS": (_counts, ["query_id", "wid", "c_id"], "queries", "cnt"),
    "Sliding": (_counts, None, "sliding", "cnt"),
    "SlidingS": (_counts, ["wid", "c_id"], "sliding", "cnt"),
    "WA": (_total, None, None, "cnt"),
}
#: Batch use cases.
BATCHES = ("MAP", "MR", "TPCH")


def _built(windows: DataFrame, kind: str | None, s: Settings) -> DataFrame:
    """What a use case makes of its closed windows (as slices): windows of several sizes, sliding ones, or the windows themselves."""
    if kind is None:
        return windows
    sliced = windows.withColumnRenamed("wid", "slice_id")
    return ev.multi_query(sliced, s.queries) if kind == "queries" else ev.sliding(sliced, s.queries)


def _in_order(df: DataFrame, order: list[str] | None) -> DataFrame:
    return df.orderBy(*order) if order else df


def batch(spark: SparkSession, code: str, s: Settings, tables: str | None = None) -> DataFrame:
    """A use case over `seconds` seconds of generated events (MAP, MR: their numbers; TPCH: over the folder of tables)."""
    if code in STREAMS:
        stream, order, kind, _ = STREAMS[code]
        events = in_utc(generate(spark, s.rate, s.seconds, ads=s.ads), "event_time")
        return _in_order(_built(stream(events, campaigns(spark, s.ads), s), kind, s), order)
    numbers = spark.range(s.rate * s.seconds).selectExpr("cast(id as int) as value")
    if code == "MAP":
        return map_values(numbers, "value", times_ten, times_ten)
    if code == "MR":
        return reduce_values(map_values(numbers, "value", times_ten), "value")
    if code == "TPCH" and tables:
        read = lambda name: spark.read.parquet(f"{tables}/{name}.parquet")
        met = rel.join(read("orders"), read("lineitem"), [("o_orderkey", "l_orderkey")])
        grouped = rel.group_by(met, ["o_orderpriority", "l_returnflag"], {"cnt": ("count", None), "revenue": ("sum", "l_extendedprice")})
        return rel.top(grouped, ["o_orderpriority", "l_returnflag"])
    raise ValueError(f"no use case {code!r} among {[*STREAMS, *BATCHES]}" + " (TPCH needs a folder of tables)" * (code == "TPCH"))


def start(spark: SparkSession, code: str, s: Settings, show: Callable[[DataFrame, float, int], None]) -> StreamingQuery:
    """Start a use case over endless generated events.

    For each trigger with closed windows, show gets the new rows (ordered, if the
    use case orders them), the mean seconds so far from a row's last event to its
    output, and the events so far.  Windows that are built of slices are found from
    the closed slices, which are kept in shared storage, and come out once, with
    the last of their slices.
    """
    if code not in STREAMS:
        raise ValueError(f"no stream {code!r} among {list(STREAMS)}")
    stream, order, kind, events_of = STREAMS[code]
    live = generate_stream(spark, s.rate, ads=s.ads).withWatermark("event_time", "0 seconds")
    folder = scratch(spark)
    seen = {"rows": 0, "seconds": 0.0, "events": 0}

    def emit(windows: DataFrame, number: int) -> None:
        rows = _in_order(windows, order).persist()
        try:
            late = (F.unix_millis(F.current_timestamp()) - F.unix_millis("max_event_time")) / 1000
            n, seconds, events = rows.agg(F.count("*"), F.coalesce(F.sum(late), F.lit(0.0)), F.coalesce(F.sum(F.expr(events_of)), F.lit(0))).first()
            if n:
                for key, value in (("rows", n), ("seconds", seconds), ("events", events)):
                    seen[key] += value
                show(rows, seen["seconds"] / seen["rows"], int(seen["events"]))
        finally:
            rows.unpersist()

    sink = emit
    if kind:
        build = multi_query_sink if kind == "queries" else sliding_sink
        sink = build(Slices(spark, f"{folder}/slices", s.queries), s.queries, emit)
    windows = stream(live, campaigns(spark, s.ads), s)
    return windows.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", f"{folder}/state").start()
