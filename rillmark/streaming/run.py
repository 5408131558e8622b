"""Running streams: finite runs into shared storage, ordered output, and measures of progress."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from rillmark.functions.time import plain_time
from rillmark.storage import scratch


@contextmanager
def state_partitions(spark: SparkSession, n: int | None):
    """Within, new streams keep their state in n partitions; a stream's number is fixed at its first start."""
    name, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    if n:
        spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def finish(stream: DataFrame, path: str | None = None, *, partitions: int | None = None) -> DataFrame:
    """Run over all input there is, append closed windows to Parquet, and read them back.

    The checkpoint beside the output lets a later run go on where this one ended,
    each row once.
    """
    spark = stream.sparkSession
    path = path or scratch(spark)
    with state_partitions(spark, partitions):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def finish_ordered(stream: DataFrame, order: list[str], path: str | None = None, *, partitions: int | None = None) -> DataFrame:
    """As finish, but each trigger's rows are sorted and kept under its number.

    In append mode a window comes out when the watermark has passed its end, so
    triggers follow each other in order of windows; a repeated trigger overwrites
    its own rows.
    """
    spark = stream.sparkSession
    path = path or scratch(spark)

    def sink(batch: DataFrame, number: int) -> None:
        batch.orderBy(*order).write.mode("overwrite").parquet(f"{path}/trigger={number}")

    with state_partitions(spark, partitions):
        query = stream.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return _triggers(stream.schema, spark, path).orderBy(*order)


def finish_each(stream: DataFrame, sink_of: Callable[[Callable[[DataFrame, int], None]], Callable[[DataFrame, int], None]], schema: StructType, path: str | None = None, *, partitions: int | None = None) -> DataFrame:
    """As finish, with a foreachBatch function that gets its emit from here: emit(rows, trigger) keeps rows of `schema`, once for each trigger."""
    spark = stream.sparkSession
    path = path or scratch(spark)
    sink = sink_of(lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/trigger={number}"))
    with state_partitions(spark, partitions):
        query = stream.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return _triggers(schema, spark, path)


def _triggers(schema: StructType, spark: SparkSession, path: str) -> DataFrame:
    """What triggers have kept; no rows if there was no trigger."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema.fields, StructField("trigger", LongType())])).parquet(path).drop("trigger")


def collect_latency(stream: DataFrame, report: Callable[[int, float, int], None], *, time_col: str = "max_event_time", count_col: str = "cnt", state: str | None = None) -> StreamingQuery:
    """Start a sink that reports (trigger, mean seconds from the last event of a row to its output, events so far)."""
    seen = {"rows": 0, "seconds": 0.0, "events": 0}

    def sink(batch: DataFrame, number: int) -> None:
        late = (F.unix_millis(F.current_timestamp()) - F.unix_millis(F.col(time_col))) / 1000
        rows, seconds, events = batch.agg(F.count("*"), F.coalesce(F.sum(late), F.lit(0.0)), F.coalesce(F.sum(count_col), F.lit(0))).first()
        for key, value in (("rows", rows), ("seconds", seconds), ("events", events)):
            seen[key] += value
        if seen["rows"]:
            report(number, seen["seconds"] / seen["rows"], int(seen["events"]))

    path = state or f"{scratch(stream.sparkSession)}-state"
    return stream.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", path).start()


def input_rates(query: StreamingQuery) -> list[tuple[int, float]]:
    """(trigger, input rows a second) of a query's recent triggers."""
    return [(p["batchId"], p["inputRowsPerSecond"]) for p in query.recentProgress]


def in_utc(df: DataFrame, *columns: str) -> DataFrame:
    """The TIMESTAMP columns as TIMESTAMP_NTZ of UTC, as batch results have them."""
    return df.withColumns({c: plain_time(c) for c in columns})


def dump_tsv(df: DataFrame, path: str) -> None:
    """Write rows as tab-separated text, for checks by other programs."""
    df.write.mode("overwrite").option("sep", "\t").csv(path)
