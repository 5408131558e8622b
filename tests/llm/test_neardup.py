import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import components as plain
from plain import shingles

from rillmark.llm import components, neardup
from rillmark.llm.queries import ORACLES, QUERIES


def test_query_equals_its_sql(spark, small, sql, same_rows):
    same_rows(QUERIES["op7_near_duplicates"](spark, small), sql(small, ORACLES["op7_near_duplicates"]))


def corpus(seed=5):
    """A large group of near copies of which many pairs lie about the threshold, small groups, chains, exact copies, and texts alone."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []

    def near(base, changes):
        own = list(base)
        for _ in range(changes):
            own[rng.randrange(len(own))] = word()
        return own

    base = [word() for _ in range(200)]
    texts += [near(base, rng.randrange(0, 8)) for _ in range(150)]
    for _ in range(20):
        small_base = [word() for _ in range(rng.randrange(30, 120))]
        texts += [near(small_base, rng.randrange(0, 3)) for _ in range(rng.randrange(1, 5))]
    chain = [word() for _ in range(150)]
    for _ in range(12):
        chain = near(chain, 2)
        texts.append(chain)
    texts += [[word() for _ in range(60)] for _ in range(60)] + [base] * 30
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("weight", [1_000_000, 40_000, 3_000])
def test_components_equal_brute_force(make_docs, percent, weight):
    rows = corpus()
    found = neardup.near_duplicates(make_docs(rows), percent=percent, max_weight=weight).collect()
    expected = plain(rows, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_heavy_regions_of_many_components(make_docs, monkeypatch):
    """Texts that share much, but too little to be linked, beside pairs that are: the second forest parts them."""
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(100_000)}"
    common = [word() for _ in range(110)]
    texts = []
    for _ in range(150):
        own = common + [word() for _ in range(60)]
        texts += [own, own[:-1] + [word()]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    needed, seen = neardup.orders_needed, []
    monkeypatch.setattr(neardup, "orders_needed", lambda *a: seen.append(a) or needed(*a))
    found = neardup.near_duplicates(make_docs(rows), percent=80, max_weight=9000).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == plain(rows, 80)
    assert seen and len({r["component_id"] for r in found}) == 150


def test_pairs_at_the_threshold_meet_as_often_as_stated():
    """Of pairs of signatures that agree in each value with probability 0.8, the share that has a common prefix in some order."""
    rng = np.random.default_rng(2)
    size, trees = 64, int(np.ceil(np.log(neardup.MISS) / np.log(1 - 0.8**neardup.DEPTH)))
    assert trees * neardup.DEPTH <= size
    agree = rng.random((200_000, size)) < 0.8
    first = agree[:, : trees * neardup.DEPTH].reshape(-1, trees, neardup.DEPTH).all(axis=2)
    assert (~first.any(axis=1)).mean() < 5e-5
    few = agree[:20_000]
    draw = np.random.default_rng(11)
    met = np.zeros(len(few), bool)
    for _ in range(neardup.orders_needed(0.8, neardup.DEEP, size, neardup.MISS_DEEP)):
        met |= few[:, draw.permutation(size)[: neardup.DEEP]].all(axis=1)
    assert (~met).mean() < 5e-4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 12)), max_size=40), st.integers(1, 20))
def test_runs_fit_and_end_where_least_is_shared(nodes, most):
    weights, common = [n[0] for n in nodes], [n[1] for n in nodes]
    cuts = neardup.cut_runs(weights, common, most)
    assert cuts == sorted(set(cuts)) and (not nodes or cuts[0] == 0)
    for a, b in zip(cuts, [*cuts, len(nodes)][1:], strict=True):
        assert b - a == 1 or sum(weights[a:b]) <= most
        if b < len(nodes):
            full = a + 1
            while full < len(nodes) and sum(weights[a : full + 1]) <= most:
                full += 1
            assert common[b] // 4 == min(common[i] // 4 for i in range(max(a + 1, (a + full + 1) // 2), full + 1))


def test_odd_texts_and_empty_table(make_docs, odd_texts):
    docs = make_docs(odd_texts)
    found = neardup.near_duplicates(docs, percent=80).collect()
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in found)
    n = lambda k: len(shingles(odd_texts[k][1]))
    expected = [
        (True, 1, 0, 1, True), (True, 2, 0, 2, True), (True, 3, 0, 3, True), (True, 4, n(3), 4, True), (True, 5, n(4), 4, False), (True, 5, n(4), 4, False),
        (False, 0, n(6), 4, False), (False, 0, 1, None, True), (True, 6, n(8), 6, True), (True, 7, n(9), 7, True), (True, 8, 1, 8, True), (True, 9, 1, 9, True),
    ]
    assert got == sorted(expected, key=lambda x: x[:3] + (x[3] or 0,)) or sorted(got, key=str) == sorted(expected, key=str)
    assert neardup.near_duplicates(docs.filter("false")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=7), st.integers(50, 100))
def test_linked_is_exact(sets, percent):
    matrix = neardup.linked([np.array(sorted(s), np.uint64) for s in sets], percent)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert matrix[i, j] == (100 * len(a & b) >= percent * len(a | b))


def test_shingles_and_short_texts():
    hashes = neardup._Hashes()
    size = lambda t: len(neardup.shingles(t.encode(), hashes))
    assert [size(t) for t in ("", " \n", "a", "a b c d", "a b c d e", "a b c d e f", "a a a a a a a")] == [0, 0, 1, 1, 1, 2, 1]
    assert (neardup.shingles(b"A B  c\nD\te", hashes) == neardup.shingles(b"a b c d e", hashes)).all()
    assert not np.array_equal(neardup.shingles(b"a b c d", hashes), neardup.shingles(b"a b c", hashes))


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("h", f"s{i}") for i in range(30)] + [("x", "x"), ("y", "z"), ("z", "y")]
    rng.shuffle(edges)
    made = spark.createDataFrame([(a.encode(), b.encode()) for a, b in edges], "a binary, b binary")
    found = {bytes(r["node"]).decode(): bytes(r["label"]).decode() for r in components.connected(made).collect()}
    assert {k: v for k, v in found.items() if k[0] == "p"} == {f"p{i:03}": "p000" for i in range(41)}
    assert {v for k, v in found.items() if k[0] in "hs"} == {"h"} and found["z"] == found["y"] == "y"
    assert components.connected(made.filter("false")).count() == 0
