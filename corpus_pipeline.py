"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows it gets, and returns a
DataFrame; all but the last return the columns of docs, extra ones too.  run() writes
each stage's result as Parquet in the shared folder and reads it again for the next one.

Defined cases: null and empty texts fail the quality rules; rows of one id stay or go
together, and rows without an id always stay, in near-duplicates; a text that is all
benchmark stays as an empty one; sources and languages may be null; equal rows are
mixed and sharded one by one; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import decontaminate, mixing, neardup, quality, sharding
from rillmark.llm.common import carried, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    judged = quality.judge(docs, carry=docs.columns)
    return judged.filter("kept").select(*[F.col(new).alias(old) for new, old in carried(docs.columns).items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 or more on five-word shingles): that of the least id."""
    found = neardup.near_duplicates(docs, percent=80)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    own = docs.toDF(*carried(docs.columns))
    return own.join(gone, F.col(f"c_{docs.columns.index('doc_id')}") == F.col("gone"), "left_anti").toDF(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, passages of the benchmark removed from their texts; n_chars follows the text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, benchmark, carry=docs.columns, remove=True)
    hit = F.size("spans") > 0
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    held = carried(docs.columns).items()
    return found.select(*[(F.when(hit, new[old]).otherwise(F.col(c)) if old in new else F.col(c)).alias(old) for c, old in held])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: every document as often as it is taken."""
    return mixing.emit(mixing.mix(docs, carry=docs.columns), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Robust estimates, the forest and the index are not expressed in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of the corpus made from all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
