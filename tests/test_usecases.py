"""Use cases, as batches and live."""

import pytest

from rillmark.__main__ import main
from rillmark.plans.usecases import BATCHES, STREAMS, Settings, batch, start

SMALL = Settings(rate=200, queries=3, seconds=60, ads=20)


@pytest.mark.parametrize("code", STREAMS)
def test_batches_of_events(spark, code):
    rows = batch(spark, code, SMALL).collect()
    order = STREAMS[code][1]
    assert rows and (not order or [tuple(r[c] for c in order) for r in rows] == sorted(tuple(r[c] for c in order) for r in rows))
    if code == "WA":
        assert {r["cnt"] for r in rows} == {2000}
    if code == "Sliding":
        assert {r["wid"] for r in rows} == set(range(4))
    if code == "YSBMQ":
        assert {(r["query_id"], r["wid"]) for r in rows} == {(1, k) for k in range(6)} | {(2, k) for k in range(3)} | {(3, k) for k in range(2)}


def test_batches_of_numbers_and_tables(spark, tiny):
    few = Settings(rate=10, seconds=2)
    assert sorted(r["value"] for r in batch(spark, "MAP", few).collect()) == [100 * k for k in range(20)]
    assert batch(spark, "MR", few).first()["value"] == 10 * sum(range(20))
    assert batch(spark, "TPCH", few, tiny).count() > 0
    for code in ("NONE", "TPCH"):
        with pytest.raises(ValueError):
            batch(spark, code, few)
    assert set(BATCHES).isdisjoint(STREAMS)


@pytest.mark.parametrize("code", ["YSBMS", "SlidingS"])
def test_live(spark, code):
    seen = []

    def show(rows, latency, events):
        seen.append((sorted({r["wid"] for r in rows.collect()}), latency, events))

    query = start(spark, code, Settings(rate=50, queries=2, span_ms=1000, ads=10), show)
    try:
        for _ in range(90):
            if len(seen) >= 2 or query.exception():
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert len(seen) >= 2, query.exception()
    windows = [w for s in seen for w in s[0]]
    assert windows == sorted(set(windows))  # in order, each once
    assert seen[-1][1] > 0 and seen[-1][2] > seen[0][2]


def test_command_line(spark, capsys):
    main(["MR", "5", "--seconds", "2"])
    assert "450" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["NONE"])
