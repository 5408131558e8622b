import zlib

import pytest
from plain import shards as plain

from rillmark.llm import sharding
from rillmark.llm.queries import QUERIES


def test_query_has_the_sizes_crcs_and_places(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = QUERIES["op3_shard"](spark, small).collect()
    assert sorted((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in found) == sorted(plain(rows))
    crc = {i: zlib.crc32(t.encode()) for i, t in rows}
    assert all(r["text_crc32"] == crc[r["doc_id"]] and r["law"] == "bytes" and r["grown_shard"] is None for r in found)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_hot_text_is_subdivided(make_docs, n, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", 4)
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}" * (i % 17)) for i in range(900)]
    found = sharding.assign_shards(make_docs(rows), n).collect()
    assert sorted((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in found) == sorted(plain(rows, n))
    sizes = [sum(r["size"] for r in found if r["shard"] == s) for s in range(n)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in found)


def test_many_empty_texts(make_docs):
    rows = [*[(i, "") for i in range(2000)], *[(5000 + i, "long " * 200 + str(i)) for i in range(50)]]
    found = sharding.assign_shards(make_docs(rows), 8).collect()
    assert sorted((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in found) == sorted(plain(rows))


def test_odd_texts_repeats_and_empty_table(make_docs, odd_texts):
    docs = make_docs(odd_texts)
    found = sharding.assign_shards(docs, 8).collect()
    rows = [r[:2] for r in odd_texts]
    assert sorted((r["size"], r["shard"], r["slot"]) for r in found) == sorted(r[1:] for r in plain(rows))
    for s in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(docs.filter("false")).count() == 0


def test_runs_without_python_on_the_executors(spark, tiny):
    plan = QUERIES["op3_shard"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
