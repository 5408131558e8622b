"""Synthetic ad events, as a batch and as a paced stream; the same numbers give the same events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions.scalar import random_int

#: Event types, and the ads that events are spread over.
TYPES, ADS = ("click", "view", "purchase"), 1000


def _uuid(number: Column) -> Column:
    """A UUID that depends on the number only."""
    h = F.md5(number.cast("string").cast("binary"))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))


def _event(id_col: str, second: Column, per_second: int, ads: int) -> list[Column]:
    n = F.col(id_col)
    ad = random_int(0, ads - 1, n, F.lit("ad"))
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), random_int(1, len(TYPES), n, F.lit("type")))
    # within a second, events count back from its last millisecond
    ms = second * 1000 + 999 - F.pmod(F.pmod(n, F.lit(per_second)), F.lit(1000))
    return [F.timestamp_millis(ms).alias("event_time"), kind.alias("event_type"), _uuid(ad).alias("ad_id"), F.lit("user").alias("user_id"), F.lit("page").alias("page_id"), F.lit("127.0.0.1").alias("ip_address")]


def generate(spark: SparkSession, per_second: int, seconds: int, *, start: int = 0, ads: int = ADS) -> DataFrame:
    """per_second * seconds events from the second `start` after 1970 on."""
    rows = spark.range(per_second * seconds)
    return rows.select(*_event("id", F.lit(start) + F.floor(F.col("id") / per_second).cast("long"), per_second, ads))


def generate_stream(spark: SparkSession, per_second: int, *, ads: int = ADS) -> DataFrame:
    """An endless stream of per_second events a second, at the time they are made."""
    live = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return live.select(*_event("value", F.unix_seconds("timestamp"), per_second, ads))


def campaigns(spark: SparkSession, ads: int = ADS, campaigns: int = 100) -> DataFrame:
    """(ad, c_id): a campaign for each generated ad."""
    return spark.range(ads).select(_uuid(F.col("id")).alias("ad"), _uuid(F.pmod("id", F.lit(campaigns)) + F.lit(1_000_000)).alias("c_id"))
