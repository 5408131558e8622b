"""Streams against the batch, with late and out-of-order events, restarts and ordered output."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rillmark.functions.time import epoch_ms
from rillmark.operators import events as ev
from rillmark.plans.catalogue import ORACLES, QUERIES
from rillmark.sources.generator import campaigns, generate_stream
from rillmark.sources.tables import event_stream
from rillmark.streaming.run import collect_latency, finish, finish_each, finish_ordered, in_utc, input_rates
from rillmark.streaming.windows import Slices, multi_query_sink, sliding_sink

START = datetime(2024, 1, 1)
SPAN = 10_000


def write(spark, folder, number, rows):
    made = spark.createDataFrame([(START + timedelta(milliseconds=ms), ad, kind) for ms, ad, kind in rows], "ts timestamp_ntz, user_id long, event_type string")
    made.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


@pytest.fixture()
def table(spark):
    return spark.createDataFrame([(1, 10), (2, 20)], "ad long, c_id int")


def _files(spark, folder):
    from rillmark.functions.time import instant

    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events.parquet")
    return live.withColumn("ts", instant("ts")).withWatermark("ts", "0 seconds")


def test_closed_windows_equal_the_batch_and_late_events_are_dropped(spark, tmp_path, table):
    folder = str(tmp_path)
    write(spark, folder, 0, [(0, 1, "click"), (9_000, 2, "click"), (3_000, 1, "click"), (11_000, 1, "click")])
    first = finish(ev.window_counts(ev.join_campaign(_files(spark, folder).filter("event_type = 'click'"), table), span_ms=SPAN), f"{folder}/out")
    assert sorted((r["c_id"], r["cnt"]) for r in first.collect()) == [(10, 2), (20, 1)]
    # a late event of the closed window, and events that close the next one; the run goes on from its checkpoint
    write(spark, folder, 1, [(1_000, 1, "click"), (12_000, 2, "click"), (99_000, 1, "click")])
    second = finish(ev.window_counts(ev.join_campaign(_files(spark, folder).filter("event_type = 'click'"), table), span_ms=SPAN), f"{folder}/out")
    base = int((START - datetime(1970, 1, 1)).total_seconds() * 1000) // SPAN
    assert sorted((r["wid"] - base, r["c_id"], r["cnt"]) for r in second.collect()) == [(0, 10, 2), (0, 20, 1), (1, 10, 1), (1, 20, 1)]


def test_ordered_output(spark, tmp_path, table):
    folder = str(tmp_path)
    for i in range(3):
        write(spark, folder, i, [(i * 30_000 + k * 10_000, 1 + k % 2, "click") for k in range(3)])
    done = finish_ordered(ev.window_counts(ev.join_campaign(_files(spark, folder), table), span_ms=SPAN), ["wid", "c_id"], f"{folder}/out")
    rows = [(r["wid"], r["c_id"]) for r in done.collect()]
    assert rows == sorted(rows) and len(rows) == 8


def sliding(events, length, folder):
    counted = ev.window_counts(events, span_ms=SPAN)
    return finish_each(counted, lambda emit: sliding_sink(Slices(counted.sparkSession, folder, length), length, emit), counted.schema)


def test_sliding_stream_equals_the_batch_on_full_windows(spark, tmp_path, table):
    folder = str(tmp_path)
    write(spark, folder, 0, [(k * 4_000, 1 + k % 2, "click") for k in range(30)])
    live = sliding(ev.join_campaign(_files(spark, folder), table), 3, f"{folder}/slices")
    batch = ev.sliding(ev.slices(ev.join_campaign(spark.read.parquet(f"{folder}/events.parquet").select("ts", "user_id"), table), span_ms=SPAN), 3)
    streamed = {(r["wid"], r["c_id"]): r["cnt"] for r in live.collect()}
    whole = {(r["wid"], r["c_id"]): r["cnt"] for r in batch.collect()}
    ended = max(w for w, _ in streamed)
    assert streamed and streamed == {k: v for k, v in whole.items() if k[0] <= ended}


def test_sliding_stream_leaves_out_windows_with_a_hole(spark, tmp_path, table):
    folder = str(tmp_path)
    # slices 0 to 3 and 5 to 9, and an event that closes them
    write(spark, folder, 0, [(k * 10_000, 1 + k % 2, "click") for k in (0, 1, 2, 3, 5, 6, 7, 8, 9)] + [(300_000, 1, "click")])
    live = sliding(ev.join_campaign(_files(spark, folder), table), 3, f"{folder}/slices").collect()
    base = int((START - datetime(1970, 1, 1)).total_seconds() * 1000) // SPAN
    assert sorted({r["wid"] - base for r in live}) == [0, 1, 5, 6, 7]


def test_windows_of_slices_over_many_triggers(spark, tmp_path, table):
    folder = str(tmp_path)
    for i in range(6):
        write(spark, folder, i, [(i * 30_000 + k * 10_000, 1 + k % 2, "click") for k in range(3)])
    events = ev.join_campaign(_files(spark, folder), table)
    counted, place = ev.window_counts(events, span_ms=SPAN), f"{folder}/slices"
    slices = Slices(spark, place, 3)
    build = lambda s: ev.multi_query(s, 3)
    done = finish_each(counted, lambda emit: multi_query_sink(slices, 3, emit), build(spark.createDataFrame([], counted.schema).withColumnRenamed("wid", "slice_id")).schema)
    got = sorted((r["query_id"], r["wid"], r["c_id"], r["cnt"]) for r in done.collect())
    batch = ev.window_counts(ev.join_campaign(spark.read.parquet(f"{folder}/events.parquet"), table), span_ms=SPAN)
    last = max(r["wid"] for r in batch.collect())
    expected = build(batch.filter(F.col("wid") < last).withColumnRenamed("wid", "slice_id")).collect()
    assert got == sorted((r["query_id"], r["wid"], r["c_id"], r["cnt"]) for r in expected) and {g[0] for g in got} == {1, 2, 3}
    # what no later window needs is gone, and a repeated trigger gives the same again
    first = min(r["wid"] for r in batch.collect())
    assert min(slices._blocks()) > first // 3
    again = Slices(spark, f"{folder}/again", 3)
    rows = batch.filter(F.col("wid") < last)
    one, two = again.add(rows, 0)[0].count(), again.add(rows, 0)[0].count()
    assert one == two == rows.count() and again.add(rows.filter("false"), 1) is None


STREAMS = [q for q in QUERIES if q.startswith("stream_")]


def one_folder(spark, tiny, folder, empty=False):
    """The tables of a folder as directories of three files each."""
    for name in ("events", "customer"):
        rows = spark.read.parquet(f"{tiny}/{name}.parquet")
        rows.filter("false" if empty else "true").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", STREAMS)
def test_queries_over_tables_that_are_directories(spark, tiny, tmp_path, sql, same_rows, name):
    same_rows(QUERIES[name](spark, one_folder(spark, tiny, str(tmp_path))), sql(tiny, ORACLES[name]))


@pytest.mark.parametrize("name", STREAMS)
def test_queries_over_empty_tables(spark, tiny, tmp_path, name):
    found = QUERIES[name](spark, one_folder(spark, tiny, str(tmp_path), empty=True))
    assert found.count() == 0 and found.columns


def test_event_stream_reads_one_table_of_a_folder(spark, tiny):
    live = event_stream(spark, tiny)
    assert live.isStreaming and dict(live.dtypes)["ts"] == "timestamp"


def test_event_stream_reads_a_table_of_many_files(spark, tmp_path):
    folder = str(tmp_path)
    for i in range(3):
        write(spark, folder, i, [(i * 30_000 + k * 10_000, k, "click") for k in range(4)])
    write(spark, f"{folder}/other", 0, [(0, 99, "view")])
    live = finish(event_stream(spark, folder).select("ts", "user_id"))
    assert sorted(tuple(r) for r in in_utc(live, "ts").collect()) == sorted(tuple(r) for r in spark.read.parquet(f"{folder}/events.parquet").select("ts", "user_id").collect())
    assert live.count() == 12


def test_event_stream_reads_a_table_of_one_file(spark, tiny):
    assert finish(event_stream(spark, tiny).select("ts")).count() == spark.read.parquet(f"{tiny}/events.parquet").count()


def test_latency_sink_and_rates_of_generated_events(spark):
    live = generate_stream(spark, 50).withColumnRenamed("event_time", "ts").withWatermark("ts", "0 seconds")
    counted = ev.window_counts(ev.join_campaign(live.select("ts", "ad_id"), campaigns(spark), ad_col="ad_id"), span_ms=1000)
    reports = []
    query = collect_latency(counted, lambda *r: reports.append(r))
    try:
        for _ in range(60):
            if reports:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert reports and reports[-1][1] >= 0 and reports[-1][2] > 0
    assert all(rate >= 0 for _, rate in input_rates(query))


def test_ms_of_fraction(spark):
    row = spark.sql("select timestamp_ntz'2024-01-01 00:00:00.999999' as t").select(epoch_ms("t").alias("e"), F.lit(1)).first()
    assert row["e"] % 1000 == 999
