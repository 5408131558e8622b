"""Mixing sources to target weights.

Tokens are summed per source (partial sums before the shuffle), capped targets
are found by water-filling over the small table of sources, and every document
is emitted floor(rate) times plus one copy drawn with the fraction as its
probability.  The draw hashes the seed and the document's id, so reruns and
retried tasks agree and no state passes between documents.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a
source of its own, last in order; a null id draws by the text's hash; repeated
rows are documents of their own that share a draw; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, materialize, pick, unit_hash, words

#: Sources up to this number are broadcast (some 100 bytes each); more are joined by a salted shuffle.
BROADCAST_SOURCES = 20_000
SALTS = 32
#: Tasks that write the table of sources.
SOURCE_TASKS = 16


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in order of code points, null last, take the weights in turn.  The
    budget is `share` of all sizes; no target exceeds `cap` times its source's
    size, and what exceeds is reshared by weight: target = min(cap * size,
    level * weight), where the level is solved from prefix sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("pos", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(turn, ((F.col("pos") - 1) % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    ranked = ranked.withColumn("ratio", F.col("limit") / F.col("weight"))
    fill = Window.orderBy("ratio", "pos")
    every = Window.partitionBy()
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    )
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "pos", "level"))).over(every)
    level = F.coalesce(first["level"], F.lit(float("inf")))
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("limit", level * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    cap: float = 3.0,
    share: float = 1.0,
    seed: int = 8,
    broadcast_sources: int = BROADCAST_SOURCES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies (how often the mix takes it), and the `carry` columns as c_0, c_1 and so on."""
    extra = carried(carry)
    own = pick(docs, doc_id=id_col, source=source_col, text=text_col, **extra).select(
        "doc_id",
        "source",
        F.size(words(F.col("text"))).cast("long").alias("size"),
        F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("_key"),
        *extra,
    )
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(materialize(sizes.coalesce(SOURCE_TASKS)), weights, cap, share))
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    if targets.count() <= broadcast_sources:
        met = own.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("_source")))
    else:
        salted = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.withColumn("_salt2", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
        met = own.join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_salt2")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + (unit_hash(seed, F.col("_key")) < rate - whole).cast("long")
    return met.select("doc_id", "size", "source_size", "target", copies.alias("copies"), *extra)


def emit(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: the carried `columns` (all that mix was given) of every document, as many rows as its copies."""
    repeated = mixed.filter(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col(new).alias(old) for new, old in carried(columns).items()])


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for all documents."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
WITH own AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM own GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) AS pos FROM s),
w AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             source_size * CAST(3 AS DOUBLE) AS cap FROM r),
f AS (SELECT *, cap / weight AS ratio FROM w),
p AS (SELECT *,
        (CAST(sum(source_size) OVER () AS DOUBLE)
          - coalesce(sum(cap) OVER (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / CAST(sum(weight) OVER (ORDER BY ratio, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM f),
l AS (SELECT level FROM p WHERE level <= ratio ORDER BY ratio, pos LIMIT 1),
t AS (SELECT source, source_size,
        CASE WHEN source_size = 0 THEN CAST(0 AS DOUBLE)
             ELSE least(cap, coalesce((SELECT level FROM l), CAST('inf' AS DOUBLE)) * weight) END AS target FROM p),
d AS (SELECT o.doc_id, o.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        CAST('0x' || substr(md5('8:' || o.k), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
      FROM own o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d
"""
