"""Windows, ratios and slices on small made-up inputs."""

from datetime import datetime, timedelta

import pytest

from rillmark.functions.time import epoch_ms, hex_prefix, instant, plain_time, window_id
from rillmark.operators import events as ev

SPAN = 10_000
START = datetime(2024, 1, 1)


def at(ms: int) -> datetime:
    return START + timedelta(milliseconds=ms)


BASE = int((START - datetime(1970, 1, 1)).total_seconds() * 1000) // SPAN


@pytest.fixture(scope="module")
def campaigns(spark):
    return spark.createDataFrame([(1, 10), (2, 20), (3, 10)], "ad long, c_id int")


def events(spark, rows):
    return spark.createDataFrame([(at(ms), ad, kind) for ms, ad, kind in rows], "ts timestamp_ntz, user_id long, event_type string")


def counted(df):
    return {(r["wid"] - BASE, r["c_id"]): r["cnt"] for r in df.collect()}


def test_window_counts_with_boundary_unmapped_and_other_types(spark, campaigns):
    made = events(spark, [(0, 1, "click"), (9_999, 3, "click"), (10_000, 1, "click"), (5, 2, "purchase"), (6, 9, "click"), (12_000, 2, "click")])
    result = ev.window_counts(ev.join_campaign(ev.filter_events(made), campaigns), span_ms=SPAN)
    assert counted(result) == {(0, 10): 2, (1, 10): 1, (1, 20): 1}
    last = {(r["wid"] - BASE, r["c_id"]): r["max_event_time"] for r in result.collect()}
    assert last[(0, 10)] == at(9_999)


def test_one_campaign_per_ad(spark):
    made = events(spark, [(0, 1, "click")])
    double = spark.createDataFrame([(1, 30), (1, 10)], "ad long, c_id int")
    result = ev.join_campaign(ev.filter_events(made), double, unique=False).collect()
    assert [r["c_id"] for r in result] == [10]


def test_broadcast_is_behind_a_count(spark, campaigns):
    made = ev.filter_events(events(spark, [(0, 1, "click")]))
    assert ev.join_campaign(made, campaigns, broadcast_ads=2).count() == ev.join_campaign(made, campaigns, broadcast_ads=3).count() == 1


def test_ratio_without_clicks_or_views(spark, campaigns):
    made = events(spark, [(0, 1, "click"), (1, 1, "click"), (2, 2, "view"), (3, 2, "view"), (10_000, 1, "click"), (10_001, 3, "view")])
    result = ev.click_view_ratio(ev.join_campaign(made, campaigns), span_ms=SPAN).collect()
    assert {(r["wid"] - BASE, r["c_id"]): (r["click_count"], r["view_count"], r["ratio"]) for r in result} == {
        (0, 10): (2, 1, 2.0),
        (0, 20): (0, 2, 0.0),
        (1, 10): (1, 1, 1.0),
    }


def slices(spark, rows):
    return spark.createDataFrame([(s, c, n, at(s)) for s, c, n in rows], "slice_id long, c_id int, cnt long, max_event_time timestamp_ntz")


@pytest.mark.parametrize("mask", [62, 0])
def test_sliding_needs_every_slice_of_any_campaign(spark, monkeypatch, mask):
    monkeypatch.setattr(ev, "MASK_SLICES", mask)
    # slice 3 is absent for campaign 1 only, slice 6 for all
    made = slices(spark, [(1, 1, 1), (2, 1, 2), (3, 2, 4), (4, 1, 8), (5, 1, 16), (7, 1, 32)])
    found = {(r["wid"], r["c_id"]): r["cnt"] for r in ev.sliding(made, 3).collect()}
    assert found == {(1, 1): 3, (1, 2): 4, (2, 1): 10, (2, 2): 4, (3, 1): 24, (3, 2): 4}


@pytest.mark.parametrize("mask", [62, 0])
def test_multi_query_has_full_tumbling_windows(spark, monkeypatch, mask):
    monkeypatch.setattr(ev, "MASK_SLICES", mask)
    made = slices(spark, [(2, 1, 1), (3, 2, 2), (4, 1, 4), (6, 1, 8), (7, 1, 16), (8, 1, 32)])
    found = {(r["query_id"], r["wid"], r["c_id"]): r["cnt"] for r in ev.multi_query(made, 3).collect()}
    assert {k: v for k, v in found.items() if k[0] == 1} == {(1, s, c): n for s, c, n in [(2, 1, 1), (3, 2, 2), (4, 1, 4), (6, 1, 8), (7, 1, 16), (8, 1, 32)]}
    assert {k: v for k, v in found.items() if k[0] == 2} == {(2, 1, 1): 1, (2, 1, 2): 2, (2, 3, 1): 24}
    assert {k: v for k, v in found.items() if k[0] == 3} == {(3, 2, 1): 56}


def test_sanity_check_flags_wrong_and_missing_rows(spark, campaigns):
    clicks = ev.filter_events(events(spark, [(0, 1, "click"), (1, 2, "click")]))
    result = ev.window_counts(ev.join_campaign(clicks, campaigns), span_ms=SPAN)
    assert {r["correct"] for r in ev.sanity_check(result, clicks, campaigns, span_ms=SPAN).collect()} == {True}
    wrong = result.filter("c_id = 10").selectExpr("wid", "c_id", "cnt + 1 as cnt", "max_event_time")
    checked = ev.sanity_check(wrong, clicks, campaigns, span_ms=SPAN).collect()
    assert sorted((r["c_id"], r["correct"]) for r in checked) == [(10, False), (20, False)]


def test_empty_inputs(spark, campaigns):
    none = events(spark, [])
    assert ev.window_counts(ev.join_campaign(ev.filter_events(none), campaigns)).count() == 0
    assert ev.sliding(slices(spark, []), 3).count() == 0
    assert ev.average_throughput(none).first()[0] is None


def test_time_does_not_depend_on_the_session_zone(spark):
    spring = int((datetime(2024, 3, 10, 2, 30) - START).total_seconds() * 1000)  # skipped in New York
    made = events(spark, [(0, 1, "click"), (spring, 1, "click"), (-1, 1, "click")])
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        found = []
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            rows = made.select(epoch_ms("ts").alias("e"), window_id("ts", SPAN).alias("w"), plain_time(instant("ts")).alias("t")).collect()
            found.append([(r["e"], r["w"] - BASE, r["t"]) for r in rows])
        expected = [(BASE * SPAN + ms, ms // SPAN, at(ms)) for ms in (0, spring, -1)]
        assert found[0] == found[1] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_hex_prefix(spark):
    row = spark.createDataFrame([("ffffffff-1-2", "0000000a-0-0")], "a string, b string").select(hex_prefix("a"), hex_prefix("b")).first()
    assert tuple(row) == (4294967295, 10)


def test_slices_are_read_once(spark, tiny):
    from rillmark.plans.catalogue import QUERIES

    for name in ("ysb_multi_query", "ysb_sliding"):
        plan = QUERIES[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("= click)") == 1 and plan.count("Relation [event_id") == 1
