"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: density, count and weight of words of a learned lexicon,
nearness of second-person words to them, and rates of capitals, punctuation,
obfuscated words (digits or signs inside words, letters three times, words of the
lexicon behind such signs).  Neither language, source nor id enters.

The lexicon holds the words and word beginnings that set labelled toxic texts
apart (a signed G statistic), counted in a distributed pass over the training
rows.  Training takes MAX_LABELLED labelled ids at most, those of the least hashes,
and one row of each; only their dense features come to the driver, where the trees
are fitted in less than a second.  Calibration is fitted on scores of folds of which
neither the trees nor their lexicon have seen a label: each fold has a lexicon and
trees of the other folds.  Scoring reads every whole text once, without a shuffle.

Defined cases: a null text counts as empty, and is scored; unlabelled or null
labels and ids are not trained on; an id labelled twice is toxic if either label
says so; of several rows of one id the least text is trained on; with labels of one class only, or
none, the score is that class's rate (0 if none); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, isotonic
from .common import materialize, pick

#: Most labelled ids to train on, most terms of the lexicon, least G and least share of toxic texts of a term.
MAX_LABELLED, MAX_TERMS, LEAST_G, LEAST_SHARE = 20_000, 3000, 24.0, 0.6
#: Lengths in bytes of the word beginnings that may be terms; words near a second-person word are this close.
STEMS, NEAR = (4, 5, 6), 5
#: Folds for calibration, and the held-out rows: crc32(id as text) mod HELD_OUT = 0.
FOLDS, HELD_OUT = 3, 5
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    w.encode()
    for w in (
        "you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner ihr euch euer eure"
        " tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros vuestro vuestra"
    ).split()
)
FEATURES = ("density", "count", "weight", "heaviest", "near", "hidden", "second", "capitals", "shouted", "exclaimed", "asked", "punctuation", "mixed", "repeated", "length")
#: Letters, apostrophes and other characters than ASCII stay, A-Z in lower case; the rest is blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or b == 39 else 32 for b in range(256))
#: What stands for letters in obfuscated words.
_PLAIN = bytes.maketrans(b"013457@$!|", b"oieastasil")
_MIXED = re.compile(rb"[A-Za-z]+(?:[0-9@$*!|]+[A-Za-z]+)+")
_THRICE = re.compile(rb"([A-Za-z])\1\1")
_SHOUT = re.compile(rb"\b[A-Z]{3,}\b")
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_NO_CAPITALS = bytes(range(65, 91))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def terms(word: bytes) -> list[bytes]:
    """What may stand for a word in the lexicon: itself, and its beginnings marked by a star."""
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and fold: how many toxic and other texts hold each term."""
    seen = [(Counter(), Counter()) for _ in range(FOLDS)]

    def out() -> pa.RecordBatch:
        rows = [(k, fold, toxic[k], other[k]) for fold, (other, toxic) in enumerate(seen) for k in other.keys() | toxic.keys()]
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64())
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["term", "fold", "toxic", "other"])
        for pair in seen:
            for s in pair:
                s.clear()
        return made

    for batch in batches:
        for text, label, fold in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            seen[fold][label].update({t for w in set(words(text)) for t in terms(w)})
        if sum(len(s) for pair in seen for s in pair) > 1_000_000:
            yield out()
    yield out()


class _Weights(dict):
    """Of a word: the weight of its heaviest term in the lexicon, or 0."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
        return value


def features(text: bytes | None, *lexica: _Weights) -> list[tuple[float, ...]]:
    """The features of a text by each lexicon."""
    data = text or b""
    own = words(data)
    second = [i for i, w in enumerate(own) if w in SECOND_PERSON]
    mixed = _MIXED.findall(data)
    unmixed = [w for m in mixed for w in words(m.translate(_PLAIN))]
    style = _style(data, len(own), len(second), len(mixed))
    return [_of_lexicon(own, second, unmixed, style, weights) for weights in lexica]


def _of_lexicon(own: list[bytes], second: list[int], unmixed: list[bytes], style: tuple[float, ...], weights: _Weights) -> tuple[float, ...]:
    n = max(1, len(own))
    weight = np.fromiter(map(weights.__getitem__, own), np.float64, len(own))
    hits = np.flatnonzero(weight)
    near = 0
    if len(hits) and second:
        at = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(np.take(second, at, mode="clip") - hits), np.abs(np.take(second, np.maximum(at - 1, 0)) - hits))
        near = int((gap <= NEAR).sum())
    hidden = sum(weights[w] > 0 for w in unmixed)
    heaviest = float(weight.max()) if len(weight) else 0.0
    return (len(hits) / n, log(1 + len(hits)), float(weight.sum()) / n, heaviest, near / n, hidden / n, *style)


def _style(data: bytes, own: int, second: int, mixed: int) -> tuple[float, ...]:
    """The features that no lexicon enters."""
    n, size = max(1, own), max(1, len(data))
    return (
        second / n,
        (size - len(data.translate(None, _NO_CAPITALS))) / size if data else 0.0,
        len(_SHOUT.findall(data)) / n,
        data.count(b"!") / size,
        data.count(b"?") / size,
        (len(data) - len(data.translate(None, _PUNCTUATION))) / size,
        mixed / n,
        len(_THRICE.findall(data)) / n,
        log(1 + own),
    )


def _featured(lexica):
    """Features by the lexicon of all rows and by that of the other folds, the label and the fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [_Weights(x) for x in lexica.value]
        for batch in batches:
            rows = [[v for f in features(t, *every) for v in f] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "label", "fold"])

    return run


class Model:
    """Trees and calibration; scores features and texts.

    x holds each row's features by the lexicon of all rows, then by that of all folds but the first, and so on.
    """

    def __init__(self, lexicon: dict[bytes, float], x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.lexicon, self.trees = lexicon, None
        self.rate = float(y.mean()) if len(y) else 0.0
        if not 0 < self.rate < 1:
            return
        raw = np.empty(len(y))
        for k in range(FOLDS):
            unseen, other = fold == k, x[:, k + 1]
            raw[unseen] = BoostedTrees().fit(other[~unseen], y[~unseen]).raw(other[unseen]) if (~unseen).any() else 0.0
        x = x[:, 0]
        self.at, self.value = isotonic(raw, y)
        self.trees = BoostedTrees().fit(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        raw = self.trees.raw(x)
        return np.clip(np.interp(raw, self.at, self.value), 0.0, 1.0)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(model.value.lexicon)
        for batch in batches:
            x = np.array([features(t, weights)[0] for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x), pa.float64())], names=["doc_id", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the labelled rows that are not held out."""
    known = pick(labels, id_col, label_col).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    # written, so that the choice is made once; max_labelled bounds what is told to all tasks, and with one row of an id the rows as well
    known = materialize(known.orderBy(F.xxhash64(F.col("id"), F.lit(10)), "id").limit(max_labelled))
    plain = pick(docs, id_col, text_col).select(F.col(id_col).alias("own"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    met = plain.join(F.broadcast(known), F.col("own") == F.col("id")).groupBy("id", "label").agg(F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.lit(FOLDS)).cast("int")
    rows = materialize(met.select("text", (F.col("label") > 0).cast("int").alias("label"), fold.alias("fold")))
    sizes = {r["fold"]: (r["n"], r["toxic"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).collect()}
    sums = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS) for c in ("toxic", "other")]
    counts = materialize(rows.mapInArrow(_counted, "term binary, fold int, toxic bigint, other bigint").groupBy("term").agg(*sums))
    every = range(FOLDS)
    lexica = [_lexicon(counts, sizes, folds) for folds in (every, *[[j for j in every if j != k] for k in every])]
    sc = docs.sparkSession.sparkContext
    dense = rows.select("text", "label", "fold").mapInArrow(_featured(sc.broadcast(lexica)), "x array<double>, label int, fold int")
    table = sorted((r["fold"], r["label"], tuple(r["x"])) for r in dense.collect())
    order = np.random.default_rng(10).permutation(len(table))
    x = np.array([r[2] for r in table], np.float64).reshape(-1, FOLDS + 1, len(FEATURES))[order]
    return Model(lexica[0], x, np.array([r[1] for r in table], np.float64)[order], np.array([r[0] for r in table], np.int64)[order])


def _lexicon(counts: DataFrame, sizes: dict[int, tuple[int, int]], folds: Iterable[int]) -> dict[bytes, float]:
    """Weights of the terms that set the toxic texts of the folds apart."""
    total, toxic = (sum(sizes.get(k, (0, 0))[i] for k in folds) for i in (0, 1))
    if not toxic:
        return {}
    p = toxic / total
    a, c = (sum((F.col(f"{name}{k}") for k in folds), F.lit(0)) for name in ("toxic", "other"))
    part_of = lambda n, q: F.when(n > 0, n * F.log(n / ((a + c) * F.lit(q)))).otherwise(F.lit(0.0))
    g = 2 * (part_of(a, p) + part_of(c, max(1e-9, 1 - p)))
    best = counts.filter((a >= LEAST_SHARE * (a + c)) & (a > p * (a + c))).select("term", a.alias("a"), c.alias("c"), g.alias("g")).filter(F.col("g") >= LEAST_G)
    weight = lambda a, c: log((a + 0.1) / (toxic + 0.2)) - log((c + 0.1) / (total - toxic + 0.2))
    return {bytes(r["term"]): weight(r["a"], r["c"]) for r in best.orderBy(F.desc("g"), "term").limit(MAX_TERMS).collect()}


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    plain = pick(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return plain.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {dict(plain.dtypes)['doc_id']}, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
