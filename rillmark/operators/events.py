"""The ad-event pipeline: filter, enrich, window counts, slices, ratios.

All functions work on batch and streaming DataFrames alike, unless they say not.
Events have a time, a type and an ad; campaigns map ads to campaigns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.scalar import ratio
from rillmark.functions.time import SPAN_MS, epoch_ms, window_id, window_key, window_number

def filter_events(events: DataFrame, kind: str = "click", *, type_col: str = "event_type", columns: tuple[str, ...] = ("ts", "user_id")) -> DataFrame:
    """Events of a kind, with the columns that later steps need."""
    return events.filter(F.col(type_col) == kind).select(*columns)


def one_campaign(campaigns: DataFrame, ad_col: str, campaign_col: str) -> DataFrame:
    """(ad, c_id) with one campaign, the least, for each ad."""
    return campaigns.groupBy(F.col(ad_col).alias("ad")).agg(F.min(campaign_col).alias("c_id"))


def join_campaign(events: DataFrame, campaigns: DataFrame, *, ad_col: str = "user_id", unique: bool = True, broadcast_ads: int | None = None) -> DataFrame:
    """Events with their campaign c_id; those of unmapped ads are dropped.

    `campaigns` is (ad, c_id); pass unique=False to reduce it to one campaign per ad
    first.  The planner broadcasts it by its size; with `broadcast_ads` it is counted
    and broadcast if it has no more rows.
    """
    table = campaigns if unique else one_campaign(campaigns, "ad", "c_id")
    if broadcast_ads is not None and table.count() <= broadcast_ads:
        table = F.broadcast(table)
    return events.join(table, F.col(ad_col) == F.col("ad"), "inner").drop("ad")


def window_counts(events: DataFrame, *, span_ms: int = SPAN_MS, ts_col: str = "ts", wid: str = "wid") -> DataFrame:
    """(wid, c_id, cnt, max_event_time): partial counts per task, one shuffle by window and campaign."""
    live = events.isStreaming
    counted = events.groupBy(window_key(ts_col, span_ms, live), "c_id").agg(F.count("*").alias("cnt"), F.max(ts_col).alias("max_event_time"))
    return counted.select(window_number(span_ms, live).alias(wid), "c_id", "cnt", "max_event_time")


def total_counts(events: DataFrame, *, span_ms: int = SPAN_MS, ts_col: str = "ts") -> DataFrame:
    """(wid, cnt, max_event_time) over all events."""
    live = events.isStreaming
    counted = events.groupBy(window_key(ts_col, span_ms, live)).agg(F.count("*").alias("cnt"), F.max(ts_col).alias("max_event_time"))
    return counted.select(window_number(span_ms, live).alias("wid"), "cnt", "max_event_time")


def click_view_ratio(events: DataFrame, *, span_ms: int = SPAN_MS, ts_col: str = "ts", type_col: str = "event_type") -> DataFrame:
    """(wid, c_id, click_count, view_count, ratio, max_event_time) of enriched clicks and views.

    One grouped pass stands for a full outer join of two windowed counts.  Without
    clicks the count is 0; without views it is 1, in the row as in the divisor.
    """
    live = events.isStreaming
    of = lambda kind: F.count(F.when(F.col(type_col) == kind, 1))
    counted = (
        events.filter(F.col(type_col).isin("click", "view"))
        .groupBy(window_key(ts_col, span_ms, live), "c_id")
        .agg(of("click").alias("click_count"), F.greatest(of("view"), F.lit(1)).alias("view_count"), F.max(ts_col).alias("max_event_time"))
    )
    quotient = ratio(F.col("click_count"), F.col("view_count")).alias("ratio")
    return counted.select(window_number(span_ms, live).alias("wid"), "c_id", "click_count", "view_count", quotient, "max_event_time")


def slices(events: DataFrame, **kwargs) -> DataFrame:
    """Counts per slice and campaign, shared by all windows that are built of slices."""
    return window_counts(events, wid="slice_id", **kwargs)


#: Windows of up to this many slices tell which slices they have by the bits of a number.
MASK_SLICES = 62


def _full_windows(sliced: DataFrame, placed: Column, keys: list[str], most: int) -> DataFrame:
    """Windows that add up slices, those of which every slice is present.

    `placed` lists the windows of a slice: their keys, `bit` (the slice's place in
    the window) and `size` (its slices).  A slice is present if any campaign has a
    row in it, so each window and campaign notes its slices as bits, and the bits are
    united over the campaigns of a window: the slices are read once.
    """
    spread = sliced.withColumn("_w", F.explode(placed)).select("_w.*", "slice_id", "c_id", "cnt", "max_event_time")
    sums = [F.sum("cnt").alias("cnt"), F.max("max_event_time").alias("max_event_time")]
    out = [*keys, "c_id", "cnt", "max_event_time"]
    if most <= MASK_SLICES:
        mask = F.bit_or(F.expr("shiftleft(1L, bit)")).alias("_mask")
        windowed = spread.groupBy(*keys, "size", "c_id").agg(*sums, mask)
        every = F.bit_or("_mask").over(Window.partitionBy(*keys))
        return windowed.withColumn("_every", every).filter("_every = shiftleft(1L, size) - 1").select(*out)
    full = spread.groupBy(*keys, "size").agg(F.count_distinct("slice_id").alias("_n")).filter("_n = size").select(*keys)
    return spread.groupBy(*keys, "c_id").agg(*sums).join(full, keys, "left_semi").select(*out)


def multi_query(sliced: DataFrame, queries: int = 4) -> DataFrame:
    """(query_id, wid, c_id, cnt, max_event_time): query n has tumbling windows of n slices, full ones only; batch.

    Every slice meets one window per query, so the shared slices are read once and
    grow by the number of queries.
    """
    place = lambda n: F.struct(
        n.alias("query_id"), F.floor(F.col("slice_id") / n).cast("long").alias("wid"), F.pmod("slice_id", n.cast("long")).cast("int").alias("bit"), n.alias("size")
    )
    return _full_windows(sliced, F.transform(F.sequence(F.lit(1), F.lit(queries)), place), ["query_id", "wid"], queries)


def sliding(sliced: DataFrame, length: int = 4) -> DataFrame:
    """(wid, c_id, cnt, max_event_time): windows of `length` slices, one starting at each slice, full ones only; batch."""
    place = lambda k: F.struct((F.col("slice_id") - k).cast("long").alias("wid"), k.alias("bit"), F.lit(length).alias("size"))
    return _full_windows(sliced, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), place), ["wid"], length)


def window_latency(windowed: DataFrame, *, span_ms: int = SPAN_MS) -> DataFrame:
    """(wid, latency_ms): per window, the sum over campaigns of the window's end minus the last event's time."""
    late = (F.col("wid") + 1) * F.lit(span_ms) - epoch_ms("max_event_time")
    return windowed.groupBy("wid").agg(F.sum(late).cast("long").alias("latency_ms"))


def throughput(events: DataFrame, *, ts_col: str = "ts") -> DataFrame:
    """(second, cnt): events by second of event time."""
    return events.groupBy(window_id(ts_col, 1000).alias("second")).agg(F.count("*").alias("cnt"))


def average_throughput(events: DataFrame, *, ts_col: str = "ts") -> DataFrame:
    """One row: the mean of the events per second, over seconds that have any."""
    return throughput(events, ts_col=ts_col).agg(F.avg("cnt").alias("avg_throughput"))


def sanity_check(result: DataFrame, clicks: DataFrame, campaigns: DataFrame, *, span_ms: int = SPAN_MS, ad_col: str = "user_id") -> DataFrame:
    """(wid, c_id, actual_count, result_count, correct): a result against a recount; windows that only one side has count as wrong."""
    actual = window_counts(join_campaign(clicks, campaigns, ad_col=ad_col), span_ms=span_ms).select("wid", "c_id", F.col("cnt").alias("actual_count"))
    given = result.select("wid", "c_id", F.col("cnt").alias("result_count"))
    met = actual.join(given, ["wid", "c_id"], "full_outer")
    return met.select("wid", "c_id", "actual_count", "result_count", F.col("actual_count").eqNullSafe(F.col("result_count")).alias("correct"))
