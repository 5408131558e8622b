import numpy as np
import pytest
from plain import counts

from rillmark.llm import quality
from rillmark.llm.queries import QUERIES

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@pytest.fixture(scope="module")
def judged(spark, small):
    return {r["doc_id"]: r for r in QUERIES["op4_quality_mcd"](spark, small).collect()}


def test_counts_equal_plain(spark, small, judged):
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        got = judged[r["doc_id"]]
        n, *_, repeats = exact = counts(r["text"])
        assert tuple(got[c] for c in NAMES) == exact
        assert got["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (got["base_failed"] and got["kept"])


def test_verdicts_agree_with_the_labels(spark, small, judged):
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    open_ones = [(judged[r["doc_id"]], r["quality"]) for r in labels if not judged[r["doc_id"]]["base_failed"]]
    assert all(j["kept"] for j, good in open_ones if good)
    assert np.mean([not j["kept"] for j, good in open_ones if not good]) > 0.9


def plain_distances(x):
    """The concentration steps on one group's vectors, in numpy."""
    x, d = x.astype(np.int64), len(quality.STATISTICS)
    floors = np.array(list(quality.STATISTICS.values())) * quality.UNIT

    def median(v, n):
        order = np.argsort(v, kind="stable")
        c = np.cumsum(n[order])
        return v[order][np.argmax(2 * c >= c[-1])]

    half_up = lambda v: np.where(v >= 0, np.floor(v + 0.5), np.ceil(v - 0.5)).astype(np.int64)
    mid, spread = np.empty(d), np.empty(d)
    for k in range(d):
        q, n = np.unique(half_up(x[:, k] / 20), return_counts=True)
        m = median(q, n)
        mid[k] = m * 20.0
        spread[k] = max(median(np.abs(q - m), n) * 20 * 1.4826, floors[k])
    def fitted(near):
        near = near.astype(float)
        mean = near.mean(axis=0)
        cov = (near.T @ near / len(near) - np.outer(mean, mean)) * quality.CONSISTENCY
        np.fill_diagonal(cov, np.maximum(cov.diagonal(), floors**2))
        factor = np.linalg.cholesky(cov)
        z = np.linalg.solve(factor, (x - mean).T)
        return (z**2).sum(axis=0), 2 * np.log(factor.diagonal()).sum()

    def step(dist):
        bins = np.floor(np.log2(dist + 1e-3) * quality.BINS)
        levels, n = np.unique(bins, return_counts=True)
        most = levels[np.argmax(np.cumsum(n) >= n.sum() * quality.SUPPORT)]
        return fitted(x[bins <= most])

    found = [step((((x - mid) / spread) ** 2).sum(axis=1)), step(fitted(x)[0])]
    for _ in range(quality.STEPS):
        before, found = found, [step(d) for d, _ in found]
        if max(b[1] - f[1] for b, f in zip(before, found, strict=True)) < quality.FALL:
            break
    return min(found, key=lambda f: f[1])[0]


@pytest.mark.parametrize("most", [quality.BROADCAST_GROUPS, 0])
def test_distances_equal_numpy(spark, make_docs, most):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        own = [f"w{rng.integers(0, 5000):x}" * (1 + rng.integers(0, 3)) for _ in range(60 + rng.integers(0, 300))]
        if i % 10 == 0:
            own = [w + "###" for w in own]
        rows.append((i, " ".join(own).replace(" w1", "\nw1")))
    docs = make_docs(rows)
    found = {r["doc_id"]: r for r in quality.judge(docs, broadcast_groups=most).collect()}
    counted = quality.counts(docs)
    dims = quality._vector()
    vectors = {r["doc_id"]: [r[f"v_{d}"] for d in dims] for r in counted.select("doc_id", *[quality.F.round(c * quality.UNIT).cast("long").alias(f"v_{d}") for d, c in dims.items()]).collect()}
    distance = plain_distances(np.array([vectors[i] for i in range(400)]))
    assert np.allclose([found[i]["distance"] for i in range(400)], distance, rtol=1e-6)
    assert all(found[i]["kept"] == (i % 10 != 0) for i in range(400))


def test_determinants_against_all_subsets(spark):
    """Groups of twelve points: the least determinant of any nine of them."""
    from itertools import combinations

    rng = np.random.default_rng(12)
    dims, groups = ["word", "capital"], {}
    for g in range(40):
        x = rng.normal(0, 1500, (12, 2)) @ np.array([[1, 0.5], [0, 1]])
        x[: rng.integers(0, 4)] += rng.normal(0, 12_000, 2)
        groups[f"g{g}"] = np.rint(x).astype(np.int64)
    fit = spark.createDataFrame([(g, *map(int, v)) for g, x in groups.items() for v in x], "g string, word long, capital long")
    found = {r["g"]: r["logdet"] for r in quality.robust_estimates(fit, dims).collect()}

    def logdet(near):
        near = near.astype(float)
        cov = np.cov(near.T, bias=True) * quality.CONSISTENCY
        np.fill_diagonal(cov, np.maximum(cov.diagonal(), [(quality.STATISTICS[d] * quality.UNIT) ** 2 for d in dims]))
        return np.linalg.slogdet(cov)[1]

    least = {g: min(logdet(x[list(s)]) for s in combinations(range(12), 9)) for g, x in groups.items()}
    gap = np.array([found[g] - least[g] for g in groups])
    # steps find a local least: of most groups the least of all, and never one of the outliers' fits
    assert set(found) == set(groups) and gap.min() > -1e-6
    assert (gap < 0.01).mean() >= 0.6 and gap.max() < 1.5


def test_small_groups_fall_back(make_docs):
    text = "one two three four five six seven eight nine ten " * 1
    long = lambda i: " ".join(f"{w}{i}{k}" for k in range(8) for w in text.split())
    docs = make_docs([(i, long(i), ["en", "de"][i % 2], f"s{i % 7}") for i in range(60)])
    assert all(r["distance"] is None and r["kept"] for r in quality.judge(docs, min_group=100).collect())
    assert all(r["distance"] is not None and r["kept"] for r in quality.judge(docs, min_group=60).collect())
    assert all(r["distance"] is not None for r in quality.judge(docs, min_group=20).collect())


def test_odd_texts_and_empty_table(make_docs, odd_texts):
    docs = make_docs(odd_texts)
    found = quality.judge(docs).collect()
    assert sorted(tuple(r[c] for c in NAMES) for r in found) == sorted(counts(r[1]) for r in odd_texts)
    assert quality.judge(docs.filter("false")).count() == 0


def test_repeated_windows_of_one_word(make_docs):
    rows = [(1, "a a a a"), (2, "a b c a b c"), (3, "a b c d a b c"), (4, "a b"), (5, "x y z x y z x y")]
    found = {r["doc_id"]: r["n_repeat_words"] for r in quality.counts(make_docs(rows)).collect()}
    assert found == {i: counts(t)[4] for i, t in rows}


def test_runs_without_python_on_the_executors(spark, tiny):
    plan = QUERIES["op4_quality_mcd"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
