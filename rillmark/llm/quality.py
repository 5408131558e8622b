"""Quality rules: base rules, then robust multivariate outliers, in DataFrame operations only.

Each text gives exact counts (words, symbols, repeated lines and word windows)
and a vector of transformed statistics.  For every group (language and source)
the minimum covariance determinant is estimated by concentration steps: keep the
share of documents with the smallest Mahalanobis distances, refit mean and
covariance on them, and so on until no group's determinant falls by a twentieth any
more (STEPS at most).  There are two deterministic starts, distances from coordinatewise medians and
from the mean and covariance of all; of each group the estimate of the lesser
determinant counts.  A document is rejected when its distance from its group's
estimate is too large.

All groups and starts take each step together, as one pre-aggregated sum of moments
and one histogram of distances per group, so no group is ever gathered in a task.
The statistics are fixed-point integers and their sums are exact: the estimate does
not depend on how rows are dealt.  Texts are read once.

Defined cases: a null or blank text has no words and fails the base rules; null
language and source form groups of their own; groups too small to fit fall back
to their language's small groups, those to all remaining, and if even that pool
is too small only the base rules decide; repeated rows count each; an empty table
gives no rows.  Very long texts: n log n in the words of a text.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, materialize, pick, words

#: Statistics of a vector and the least spread taken for each, in units of the transformed value.
STATISTICS = {"length": 0.7, "word": 0.1, "symbol": 0.4, "lines": 0.7, "repeat": 0.7, "capital": 0.25}
#: Least members of a group, share that an estimate is fitted on, most steps, and the squared distance that rejects (the 99.5 % point of chi2_6).
MIN_GROUP, SUPPORT, STEPS, CUTOFF = 200, 0.75, 10, 18.548
#: Starts of an estimate, and the least fall of a logarithm of a determinant that is worth another step.
STARTS, FALL = 2, 0.05
#: Tables of more groups than this meet the documents in a salted shuffle; tasks that write one.
BROADCAST_GROUPS, GROUP_TASKS, SALTS = 50_000, 16, 32
#: Fixed-point units of the statistics, and bins of the distance histogram per doubling.
UNIT, BINS = 1000, 64
#: Consistency of the covariance of the nearest 75 % in six dimensions: 0.75 / P(chi2_8 <= q), q the 75 % point of chi2_6.
CONSISTENCY = 1.47


def counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per document the exact counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals."""
    own = pick(docs, *carry, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    t = (
        own.withColumn("w", words(F.col("text")))
        .withColumn("n", F.size("w"))
        .withColumn("lines", F.expr(r"filter(split(text, '\n'), x -> length(btrim(x, ' \t\n\u000b\f\r')) > 0)"))
        .withColumn("bits", F.length(F.bin("n")))
        # 64-bit hash of each window, its low bits replaced by the window's place: one primitive sort brings equals together
        .withColumn(
            "v",
            F.expr(
                "sort_array(if(n < 3, cast(array() as array<bigint>), transform(sequence(0, greatest(n - 3, 0)),"
                " i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), bits) | cast(i as bigint))))"
            ),
        )
        .withColumn(
            "close",
            F.expr(
                "filter(v, (x, j) -> (j > 0 and shiftright(v[greatest(j - 1, 0)], bits) = shiftright(x, bits))"
                " or (j < size(v) - 1 and shiftright(v[least(j + 1, size(v) - 1)], bits) = shiftright(x, bits)))"
            ),
        )
        # the few left are compared as strings
        .withColumn(
            "g",
            F.expr(
                "array_sort(transform(close, x -> named_struct('s', concat_ws(' ', w[cast(x & (shiftleft(1L, bits) - 1) as int)],"
                " w[cast(x & (shiftleft(1L, bits) - 1) as int) + 1], w[cast(x & (shiftleft(1L, bits) - 1) as int) + 2]),"
                " 'i', cast(x & (shiftleft(1L, bits) - 1) as int))))"
            ),
        )
        .withColumn(
            "at",
            F.expr(
                "sort_array(transform(filter(g, (x, j) -> (j > 0 and g[greatest(j - 1, 0)].s = x.s)"
                " or (j < size(g) - 1 and g[least(j + 1, size(g) - 1)].s = x.s)), x -> x.i))"
            ),
        )
    )
    long = lambda c: c.cast("long")
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    return t.select(
        "doc_id",
        *carry,
        long(F.col("n")).alias("n_words"),
        long(F.length(F.array_join("w", ""))).alias("word_chars"),
        long(without(r"[#*$%&|<>]+")).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.expr(
            "cast(aggregate(transform(at, (x, j) -> if(j < size(at) - 1, least(3, at[least(j + 1, size(at) - 1)] - x), 3)), 0, (a, x) -> a + x) as bigint)"
        ).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(without(r"[\p{Lu}]+")).alias("n_capitals"),
    )


def _vector() -> dict[str, Column]:
    """The transformed statistics: logarithms, so that ratios of counts become nearly normal."""
    per = lambda n, of, scale: F.log1p(F.lit(float(scale)) * F.col(n) / F.greatest(F.col(of), F.lit(1)))
    return {
        "length": F.log1p(F.col("n_words")),
        "word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "symbol": per("n_symbols", "word_chars", 100),
        "lines": per("n_dup_lines", "n_lines", 10),
        "repeat": per("n_repeat_words", "n_words", 10),
        "capital": per("n_capitals", "word_chars", 10),
    }


class Groups(NamedTuple):
    """Whether the groups are few enough to be told to all tasks, and how many tasks write a table of them."""

    few: bool
    tasks: int

    @classmethod
    def of(cls, n: int, most: int = BROADCAST_GROUPS) -> Groups:
        return cls(n <= most, max(1, min(GROUP_TASKS, n // 1000)))


def _written(groups: DataFrame, tasks: int) -> DataFrame:
    return materialize(groups.coalesce(tasks))


def _meet(rows: DataFrame, groups: DataFrame, on: list[str], known: Groups, how: str = "inner") -> DataFrame:
    """rows joined to a table with a row per group, which is told to all tasks if there are few (some 300 bytes each); else all groups' rows are salted, so that a hot group is dealt."""
    if known.few:
        return rows.join(F.broadcast(groups), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on]), F.lit(SALTS)).cast("int"))
    return salted.join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"], how).drop("_salt")


def _grouped(table: DataFrame, min_group: int, most: int) -> tuple[DataFrame, Groups]:
    """Adds g, the group whose estimate a document is held against (null where none is large enough), and tells how many groups there are."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    full = table.withColumn("_lang", named("lang")).withColumn("_source", named("source"))
    size = full.groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    big = F.col("n") >= min_group
    of_lang = F.sum(F.when(big, 0).otherwise(F.col("n"))).over(Window.partitionBy("_lang"))
    label = size.withColumn("level", F.when(big, 0).when(of_lang >= min_group, 1).otherwise(2))
    rest = label.groupBy("level").agg(F.sum("n").alias("pool")).filter(F.col("level") == 2)
    label = label.join(F.broadcast(rest), "level", "left").select(
        "_lang",
        "_source",
        F.when(F.col("level") == 0, F.concat_ws("\t", "_lang", "_source"))
        .when(F.col("level") == 1, F.col("_lang"))
        .when(F.col("pool") >= min_group, F.lit("*"))
        .alias("g"),
    )
    label = _written(label, GROUP_TASKS)
    known = Groups.of(label.count(), most)
    return _meet(full, label, ["_lang", "_source"], known).drop("_lang", "_source"), known


def _start(x: DataFrame, dims: list[str], tasks: int) -> DataFrame:
    """Per group: median m_<d> and spread s_<d> of each dimension, from histograms in units of 0.02."""
    long = x.select("g", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.round(F.col(d) / 20).cast("long").alias("q")) for d in dims])).alias("e"))
    seen = materialize(long.groupBy("g", "e.d", "e.q").agg(F.count("*").alias("n")).coalesce(2 * tasks))

    def median(hist: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("g", "d").orderBy("q")
        half = hist.withColumn("c", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("g", "d")))
        return half.filter(F.col("c") * 2 >= F.col("all")).groupBy("g", "d").agg(F.min("q").alias(name))

    mid = median(seen, "m")
    away = seen.join(mid, ["g", "d"]).select("g", "d", F.abs(F.col("q") - F.col("m")).alias("q"), "n")
    both = mid.join(median(away.groupBy("g", "d", "q").agg(F.sum("n").alias("n")), "s"), ["g", "d"])
    aggs = []
    for d in dims:
        aggs.append(F.max(F.when(F.col("d") == d, F.col("m") * 20.0)).alias(f"m_{d}"))
        aggs.append(F.max(F.when(F.col("d") == d, F.greatest(F.col("s") * 20 * 1.4826, F.lit(STATISTICS[d] * UNIT)))).alias(f"s_{d}"))
    return both.groupBy("g").agg(*aggs)


def _moments(x: DataFrame, dims: list[str]) -> DataFrame:
    """Exact sums and cross products per group."""
    product = lambda a, b: F.sum((F.col(a) * F.col(b)).cast("decimal(20,0)"))
    return x.groupBy("g").agg(
        F.count("*").alias("n"),
        *[F.sum(d).alias(f"t_{d}") for d in dims],
        *[product(a, b).alias(f"p_{a}_{b}") for i, a in enumerate(dims) for b in dims[: i + 1]],
    )


def _estimate(moments: DataFrame, dims: list[str], tasks: int) -> DataFrame:
    """Per group: mean m_<d>, the Cholesky factor l_<a>_<b> of the covariance, each variance the square of its floor at least, and logdet, the logarithm of its determinant."""
    mean = lambda d: F.col(f"t_{d}") / F.col("n")
    spread = lambda a, b: (F.col(f"p_{a}_{b}").cast("double") / F.col("n") - mean(a) * mean(b)) * CONSISTENCY
    out = moments.select(
        "g",
        *[(F.col(f"t_{d}") / F.col("n")).alias(f"m_{d}") for d in dims],
        *[
            F.greatest(spread(a, b), F.lit((STATISTICS[a] * UNIT) ** 2 if a == b else float("-inf"))).alias(f"c_{a}_{b}")
            for i, a in enumerate(dims)
            for b in dims[: i + 1]
        ],
    )
    for i, a in enumerate(dims):
        for j, b in enumerate(dims[: i + 1]):
            rest = F.col(f"c_{a}_{b}")
            for k in dims[:j]:
                rest = rest - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}")
            out = out.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if a == b else rest / F.col(f"l_{b}_{b}"))
    logdet = 2 * sum((F.log(f"l_{d}_{d}") for d in dims), F.lit(0.0))
    return _written(out.select("g", logdet.alias("logdet"), *[f"m_{d}" for d in dims], *[f"l_{a}_{b}" for i, a in enumerate(dims) for b in dims[: i + 1]]), tasks)


def _distance(x: DataFrame, estimate: DataFrame, dims: list[str], known: Groups) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance (null where the group has no estimate)."""
    out = _meet(x, estimate, ["g"], known, "left")
    for i, a in enumerate(dims):
        rest = F.col(a) - F.col(f"m_{a}")
        for b in dims[:i]:
            rest = rest - F.col(f"l_{a}_{b}") * F.col(f"z_{b}")
        out = out.withColumn(f"z_{a}", rest / F.col(f"l_{a}_{a}"))
    return out.withColumn("d2", sum((F.col(f"z_{d}") * F.col(f"z_{d}") for d in dims), F.lit(0.0))).select(*x.columns, "d2")


def _nearest(x: DataFrame, share: float, known: Groups) -> DataFrame:
    """The rows of x within their group's quantile of d2, by a histogram of logarithmic bins (its last bin whole)."""
    binned = x.withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-3) * BINS).cast("int"))
    hist = binned.groupBy("g", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g").orderBy("bin")
    hist = hist.withColumn("c", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("g")))
    most = hist.filter(F.col("c") >= F.col("all") * share).groupBy("g").agg(F.min("bin").alias("most"))
    return _meet(binned, _written(most, known.tasks), ["g"], known).filter(F.col("bin") <= F.col("most"))


def robust_estimates(fit: DataFrame, dims: list[str], *, support: float = SUPPORT, steps: int = STEPS, known: Groups = Groups(True, 1)) -> DataFrame:
    """Per group g of fit (g and the statistics): the minimum covariance determinant's mean m_<d>, factor l_<a>_<b> and logdet."""
    own = lambda start: F.concat("g", F.lit(f"\t{start}"))
    medians, whole = (fit.withColumn("g", own(start)) for start in range(STARTS))
    at = _written(_start(fit, dims, known.tasks), known.tasks).withColumn("g", own(0))
    near = sum((((F.col(d) - F.col(f"m_{d}")) / F.col(f"s_{d}")) ** 2 for d in dims), F.lit(0.0))
    first = _meet(medians, at, ["g"], known).select("g", *dims, near.alias("d2"))
    first = first.unionByName(_distance(whole, _estimate(_moments(whole, dims), dims, known.tasks), dims, known))
    both = medians.unionByName(whole)
    estimate = _estimate(_moments(_nearest(first, support, known), dims), dims, known.tasks)
    for _ in range(steps):
        before, estimate = estimate, _estimate(_moments(_nearest(_distance(both, estimate, dims, known), support, known), dims), dims, known.tasks)
        change = before.select("g", F.col("logdet").alias("before")).join(estimate.select("g", "logdet"), "g")
        if (change.agg(F.max(F.col("before") - F.col("logdet"))).first()[0] or 0.0) < FALL:
            break
    group = F.expr("left(g, length(g) - 2)").alias("g")
    least = estimate.groupBy(group).agg(F.min_by(F.struct(*[c for c in estimate.columns if c != "g"]), F.struct("logdet", "g")).alias("best"))
    return _written(least.select("g", "best.*"), known.tasks)


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_group: int = MIN_GROUP,
    support: float = SUPPORT,
    steps: int = STEPS,
    cutoff: float = CUTOFF,
    broadcast_groups: int = BROADCAST_GROUPS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per document: id, the counts, base_failed, distance (squared; null without an estimate), kept, and the `carry` columns as c_0, c_1 and so on."""
    extra = carried(carry)
    own = pick(docs, doc_id=id_col, text=text_col, lang=lang_col, source=source_col, **extra)
    table = counts(own, carry=("lang", "source", *extra))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    vector = [F.round(c * UNIT).cast("long").alias(d) for d, c in _vector().items()]
    table = materialize(table.select("*", failed.alias("base_failed"), *vector))
    dims = list(STATISTICS)
    x, known = _grouped(table, min_group, broadcast_groups)
    # documents that fail the base rules do not shape the estimates
    fit = materialize(x.filter(~F.col("base_failed") & F.col("g").isNotNull()).select("g", *dims))
    seen = _distance(x, robust_estimates(fit, dims, support=support, steps=steps, known=known), dims, known)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return seen.select(*columns, F.col("d2").alias("distance"), kept.alias("kept"), *extra)


def op4_quality_mcd(spark, sf_dir: str) -> DataFrame:
    """Counts, base_failed, distance and kept for all documents."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
