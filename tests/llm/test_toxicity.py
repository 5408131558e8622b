import os
import zlib

import numpy as np
import pytest

from rillmark.llm import boosting, toxicity
from rillmark.llm.queries import QUERIES


def test_held_out_accuracy(spark, small):
    folder = f"{os.path.dirname(small)}/sf0.1"
    found = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, folder).collect()}
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in found.items())
    labels = [(found[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    held = [(r["score"], y) for r, y in labels if r["held_out"]]
    good, bad = [s for s, y in held if y == 0], [s for s, y in held if y == 1]
    auc = np.mean([(a > b) + (a == b) / 2 for a in bad for b in good])
    assert auc > 0.98 and np.mean([s >= 0.5 for s in bad]) > 0.85 and np.mean([s >= 0.5 for s in good]) < 0.01
    # calibrated: among scores the rate of labels is near their mean
    assert abs(np.mean([s for s, _ in held]) - np.mean([y for _, y in held])) < 0.03


def test_reruns_agree(spark, small):
    a, b = [sorted((r["doc_id"], r["score"]) for r in QUERIES["op10_toxicity"](spark, small).collect()) for _ in range(2)]
    assert a == b


def labelled(spark, make_docs, n=400):
    rows = [(i, " ".join(f"w{(i * k) % 91}" for k in range(20, 60)) + (" you rotten stinker!" if i % 5 == 1 else ".")) for i in range(n)]
    return make_docs(rows), spark.createDataFrame([(i, int(i % 5 == 1), "x") for i in range(n)], "doc_id long, toxic int, label string")


def test_odd_texts_labels_and_empty_tables(spark, make_docs, odd_texts):
    docs, labels = labelled(spark, make_docs)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, ""), (7, None, ""), (2, 0, ""), (2, 0, "")], labels.schema))
    model = toxicity.train(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert np.mean([s for i, s in scored.items() if i % 5 == 1]) > 0.9 and np.mean([s for i, s in scored.items() if i % 5 != 1]) < 0.05
    odd = toxicity.score(make_docs(odd_texts), model).collect()
    assert len(odd) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(docs.filter("false"), model).count() == 0


@pytest.mark.parametrize("toxic, rate", [("0", 0.0), ("1", 1.0), ("cast(null as int)", 0.0)])
def test_one_class_or_none(spark, make_docs, toxic, rate):
    docs, labels = labelled(spark, make_docs, 30)
    model = toxicity.train(docs, labels.selectExpr("doc_id", f"{toxic} as toxic"))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {rate}


def test_training_rows_are_bounded(spark, make_docs, monkeypatch):
    docs, labels = labelled(spark, make_docs)
    seen = []
    real = toxicity.Model
    monkeypatch.setattr(toxicity, "Model", lambda lexicon, x, y, fold: seen.append((x.shape, len(y), set(fold))) or real(lexicon, x, y, fold))
    # an id on many rows counts once
    docs = docs.union(docs.filter("doc_id < 40")).union(docs.filter("doc_id < 40"))
    model = toxicity.train(docs, labels, max_labelled=100)
    assert model.trees is not None
    assert seen == [((100, toxicity.FOLDS + 1, len(toxicity.FEATURES)), 100, set(range(toxicity.FOLDS)))]


def test_no_fold_sees_its_own_labels(spark, make_docs):
    """Labels by chance: each toxic text has a word of its own group, which tells nothing about others."""
    rng = np.random.default_rng(4)
    y = rng.random(600) < 0.3
    rows = [(i, f"own{i // 12} " + " ".join(f"w{rng.integers(0, 300)}" for _ in range(30))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    model = toxicity.train(make_docs(rows), labels)
    scores = [r["score"] for r in toxicity.score(make_docs(rows), model).collect()]
    # calibrated scores of labels that cannot be learned stay near their rate
    assert np.std(scores) < 0.1 and abs(np.mean(scores) - y.mean()) < 0.1


def test_features_see_obfuscated_words_and_second_persons():
    weights = toxicity._Weights({b"idiot": 3.0, b"stink*": 2.0})
    value = dict(zip(toxicity.FEATURES, toxicity.features(b"YOU are an 1d1ot stinking x1diot idiot!!", weights)[0], strict=True))
    assert value["weight"] > 0 and value["heaviest"] == 3.0 and value["near"] > 0 and value["second"] > 0 and value["mixed"] > 0 and value["shouted"] > 0
    assert toxicity.features(None, weights) == toxicity.features(b"", weights)


def test_isotonic_is_monotone_and_pools():
    x, p = boosting.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0]))
    assert (np.diff(p) >= 0).all() and (np.diff(x) >= 0).all() and x[0] == 1 and x[-1] == 4


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.BoostedTrees().fit(x[:1500], y[:1500])
    assert ((model.raw(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.93


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(40):
        score, y = rng.integers(0, 12, 30).astype(float), rng.integers(0, 2, 30).astype(float)
        x, p = boosting.isotonic(score, y)
        levels = np.unique(score)
        sums, sizes = np.array([y[score == v].sum() for v in levels]), np.array([(score == v).sum() for v in levels])
        mean = lambda i, j: sums[i : j + 1].sum() / sizes[i : j + 1].sum()  # noqa: E731, B023
        n = len(levels)
        fit = np.array([max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)])
        # equal values are one block, which is drawn half a row towards the mean
        drawn = [(sums[fit == f].sum() + y.mean() / 2) / (sizes[fit == f].sum() + 0.5) for f in fit]
        assert np.allclose(np.interp(levels, x, p), np.maximum.accumulate(drawn))


def test_first_tree_is_the_best_split():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, (200, 3)).astype(float)
    y = (rng.random(200) < 0.2 + 0.1 * x[:, 1]).astype(float)
    model = boosting.BoostedTrees(trees=1, depth=1, rate=1.0, ridge=1.0, least=0.0).fit(x, y)
    p = y.mean()
    g, h = y - p, np.full(200, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    best = max((gain(x[:, f] < v), f, v) for f in range(3) for v in range(1, 6))
    low = x[:, best[1]] < best[2]
    expected = np.log(p / (1 - p)) + np.where(low, g[low].sum() / (h[low].sum() + 1), g[~low].sum() / (h[~low].sum() + 1))
    assert np.allclose(model.raw(x), expected)
