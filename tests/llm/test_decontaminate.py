import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import contamination, decontaminated, sha256

from rillmark.llm import decontaminate as d
from rillmark.llm.queries import ORACLES, QUERIES


def test_query_equals_its_sql(spark, small, sql, same_rows):
    same_rows(QUERIES["op2_decontaminate"](spark, small), sql(small, ORACLES["op2_decontaminate"]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=6), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_index_finds_and_locates_all_occurrences(texts, phrase):
    index = d.FMIndex([np.array(t) for t in texts], 3, sample=4)
    which, low, high = index.search(np.array([phrase]))
    at = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(which) else []
    starts = index.starts.tolist()
    assert at == [starts[i] + k for i, t in enumerate(texts) for k in range(len(t) - len(phrase) + 1) if t[k : k + len(phrase)] == phrase]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60))
def test_suffix_order(symbols):
    s = np.array([x + 1 for x in symbols] + [0])
    assert d.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())


ITEMS = [(10, "one two three four five six seven eight nine ten eleven"), (9, "Short ITEM"), (9, "one two three four five six seven eight nine ten"), (None, "zz zz"), (4, None), (5, "!!")]


def texts():
    base = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"x {base} y"), (2, base.upper().replace(" ", "--")), (3, "a short item, short-item; item"), (4, "zz ZZ zz zz"), (5, None), (6, ""), (7, "one two three"), (8, f"{base} {base}")]
    return [*rows, *[(20 + i, f"x {base} y") for i in range(5)], (40, ("pad " * 300 + base + " ") * 3)]


@pytest.mark.parametrize("shard_words", [1_000_000, 100, 15])
@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_equals_plain_in_shards_and_blocks(spark, make_docs, shard_words, block_bytes):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = d.find_contamination(make_docs(texts()), benchmark, shard_words=shard_words, block_bytes=block_bytes).collect()
    got = {r["doc_id"]: (r["n_words"], {k for s in r["spans"] for k in range(s["start"], s["end"])}, r["items"]) for r in found}
    assert got == contamination(texts(), ITEMS)
    assert all(a["end"] < b["start"] for r in found for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_cleaned_texts(spark, make_docs):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {r["doc_id"]: r["text"] for r in d.cleaned(d.find_contamination(make_docs(texts()), benchmark)).collect()}
    plain = contamination(texts(), ITEMS)
    assert found == {i: decontaminated(t or "", plain[i][1]) for i, t in texts()}
    for block_bytes in (1 << 20, 100):
        removed = d.find_contamination(make_docs(texts()), benchmark, remove=True, block_bytes=block_bytes)
        assert {r["doc_id"]: r["text"] for r in removed.collect()} == found
    assert found[1] == "x  y" and found[3] == "a ; item"


def test_odd_texts_and_empty_tables(spark, make_docs, odd_texts):
    benchmark = spark.createDataFrame([(1, "and another one. A third sentence here, with some more words")], "item_id long, text string")
    docs = make_docs(odd_texts)
    found = d.find_contamination(docs, benchmark).collect()
    keyed = contamination(list(enumerate(r[1] for r in odd_texts)), [(1, "and another one. A third sentence here, with some more words")])
    shape = lambda n, hit, names: (n, len(hit), tuple(names))
    assert sorted(shape(r["n_words"], {k for s in r["spans"] for k in range(s["start"], s["end"])}, r["items"]) for r in found) == sorted(shape(*v) for v in keyed.values())
    assert d.find_contamination(docs.filter("false"), benchmark).count() == 0
    none = d.find_contamination(docs, benchmark.filter("false")).collect()
    assert len(none) == len(odd_texts) and not any(r["spans"] for r in none)
    assert sha256("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
