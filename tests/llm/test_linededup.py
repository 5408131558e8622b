import numpy as np
import pytest
from plain import line_dedup as plain

from rillmark.llm import linededup
from rillmark.llm.queries import ORACLES, QUERIES


def test_query_equals_its_sql(spark, small, sql, same_rows):
    same_rows(QUERIES["op1_line_dedup"](spark, small), sql(small, ORACLES["op1_line_dedup"]))


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, "\n".join(f"  Line {(i * 7 + k) % 60}\t" if k % 2 else f"own {i} {k}" for k in range(8))) for i in range(60)]
    return [*rows, *[(100 + i, "Common line\n\nline 3") for i in range(12)]]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
@pytest.mark.parametrize("bits", [1 << 10, 1 << 17])
def test_equals_plain_with_keys_told_and_joined(make_docs, corpus, broadcast, bits):
    found = linededup.line_dedup(make_docs(corpus), min_docs=5, keep_first=False, broadcast_keys=broadcast, max_bits=bits).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in found} == plain(corpus, 5)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_first_occurrence_stays(make_docs, broadcast):
    docs = make_docs([(3, "a\nb"), (-1, "b\nA \nb"), (2, "c\na"), (None, "c")])
    found = {r["doc_id"]: r["text"] for r in linededup.line_dedup(docs, broadcast_keys=broadcast).collect()}
    assert found == {None: "c", -1: "b\nA ", 2: "", 3: ""}


def test_odd_texts_and_empty_table(make_docs, odd_texts):
    docs = make_docs(odd_texts)
    found = linededup.line_dedup(docs, min_docs=3, keep_first=False).collect()
    keyed = plain(list(enumerate(r[1] for r in odd_texts)), 3)
    assert sorted((r["n_lines"], r["n_dropped"], r["text"]) for r in found) == sorted(keyed.values())
    assert linededup.line_dedup(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        linededup.line_dedup(docs, min_docs=1)


def test_filters_merge_without_losing_a_repeat(spark):
    # keys shared by any two of many partitions, in more partitions than one merge takes
    texts = [(f"key{i // 2}\nown{i}",) for i in range(400)]
    table = spark.createDataFrame(texts, "text string").selectExpr("cast(text as binary) as text").repartition(linededup.FAN_IN + 10)
    m = 1 << 16
    bitmap = linededup.seen_twice(table, m)
    digest = linededup.xxhash.xxh3_128_digest
    assert linededup.held(bitmap, b"".join(digest(f"key{i}".encode()) for i in range(200))).all()
    assert linededup.held(bitmap, b"".join(digest(f"own{i}".encode()) for i in range(400))).mean() < 0.05


def test_filters_of_many_keys_let_few_others_through(spark, make_docs):
    # ten times the keys that one filter of max_bits takes, a hundred of them in two documents
    bits = 1 << 16
    keys = 10 * bits // linededup.BITS_PER_LINE
    rows = [(i, "\n".join([f"own {i} {k}" for k in range(keys // 800)] + ([f"both {i % 100}"] if i < 200 else []))) for i in range(800)]
    table = spark.createDataFrame([(b"%d" % i, t.encode()) for i, t in rows], "row binary, text binary").repartition(9)
    found = [bytes(r["row"]) for r in linededup.ranged_suspects(table, keys, 10).collect()]
    assert 200 <= len(found) < 200 + keys // 100
    assert {b"%d" % i for i in range(200)} <= set(found)
    got = linededup.line_dedup(make_docs(rows), keep_first=False, max_bits=bits).collect()
    assert {r["doc_id"]: (r["n_dropped"], r["text"]) for r in got} == {i: v[1:] for i, v in plain(rows, 2).items()}


def test_packed_chunks_count_bits():
    rng = np.random.default_rng(1)
    sparse, dense = np.zeros(linededup.CHUNK // 8, np.uint8), rng.integers(0, 256, linededup.CHUNK // 8, np.uint8)
    sparse[5] = 3
    packed = [linededup._packed(x)[0] for x in (sparse, dense)]
    bits = [np.unpackbits(x, bitorder="little").astype(int) for x in (sparse, dense)]
    assert (linededup._counts(packed) == bits[0] + bits[1]).all()
