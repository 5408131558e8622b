"""Tables in Parquet, as batches and as streams, and other connectors for rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions.time import instant
from rillmark.operators.relational import shard_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def event_stream(spark: SparkSession, folder: str, name: str = "events", *, ts_col: str = "ts", files_per_batch: int = 64, late: str = "0 seconds") -> DataFrame:
    """The table's files as a stream with a watermark on its event time, which becomes a TIMESTAMP of UTC."""
    schema = table(spark, folder, name).schema
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    path = f"{folder}/{name}.parquet"
    # a stream reads folders only: a table of one file is picked from the folder it lies in
    live = read.parquet(path) if _is_folder(spark, path) else read.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return live.withColumn(ts_col, instant(ts_col)).withWatermark(ts_col, late)


def campaign_table(customers: DataFrame) -> DataFrame:
    """(ad, c_id) of a customer table: the customer stands for the ad, the nation for the campaign."""
    return customers.select(F.col("c_custkey").alias("ad"), F.col("c_nationkey").alias("c_id"))


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """(ad, c_id) of a text file of pairs: one character, the ad (36), three characters, the campaign (36)."""
    lines = spark.read.text(path).filter(F.length("value") >= 76)
    return lines.select(F.substring("value", 2, 36).alias("ad"), F.substring("value", 41, 36).alias("c_id"))


def write_mappings(pairs: DataFrame, path: str) -> None:
    """Write (ad, c_id) in the layout that read_mappings reads."""
    pairs.select(F.concat(F.lit(" "), F.rpad("ad", 36, " "), F.lit("   "), F.rpad("c_id", 36, " ")).alias("value")).write.mode("overwrite").text(path)


def read_sharded(df: DataFrame, columns: list[str], shards: int) -> DataFrame:
    """The rows dealt to partitions by a hash of `columns`, with the number of the shard their sum gives them."""
    return df.withColumn("shard", shard_of(columns, shards)).repartition(shards, *columns)


def export_sorted(df: DataFrame, order: list[str], path: str, parts: int = 16) -> None:
    """Write a table as `parts` Parquet files, each sorted; works on a JDBC read as on any other."""
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, *, key: str, low: int, high: int, parts: int = 16, **options: str) -> DataFrame:
    """A database table read in `parts` ranges of a numeric key at once."""
    read = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    return read.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()
