"""Streams of windows that are built of windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions.time import SPAN_MS
from rillmark.operators import events as ev



class Slices:
    """The closed slices of a stream, as far back as windows of `reach` slices need, in shared storage.

    They are kept by blocks of `reach` slices and by trigger, so that a trigger reads
    two blocks beside its own, replaces its own rows if it is repeated, and older
    blocks can go.
    """

    def __init__(self, spark: SparkSession, folder: str, reach: int):
        self.spark, self.folder, self.reach = spark, folder, reach

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _blocks(self) -> list[int]:
        store, path = self._files()
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        return sorted(int(n.removeprefix("block=")) for n in names if n.startswith("block="))

    def add(self, slices: DataFrame, number: int) -> tuple[DataFrame, int] | None:
        """Keep a trigger's slices (wid, ...); returns all that share a window with them, and the first new one (None without new ones)."""
        own = slices.persist()
        try:
            first = own.agg(F.min("wid")).first()[0]
            if first is None:
                return None
            kept = own.withColumn("block", F.floor(F.col("wid") / self.reach).cast("long")).withColumn("trigger", F.lit(number).cast("long"))
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block", "trigger").parquet(self.folder)
        finally:
            own.unpersist()
        least = (first - self.reach) // self.reach
        blocks = self._blocks()
        store, path = self._files()
        # a repeated trigger may need the block before its own
        for old in (b for b in blocks if b < least - 1):
            store.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"block={old}"), True)
        read = self.spark.read.schema(kept.schema).option("basePath", self.folder)
        recent = read.parquet(*[f"{self.folder}/block={b}" for b in blocks if b >= least])
        return recent.filter((F.col("trigger") <= number) & (F.col("wid") > first - self.reach)).select(*slices.columns), first


def of_slices(slices: Slices, build: Callable[[DataFrame], DataFrame], last: Callable[[], Column], emit: Callable[[DataFrame, int], None]):
    """A foreachBatch function: keeps a trigger's closed slices, and emits the windows that `build` makes of slices (wid as slice_id, ...) and that end with a new one.

    `last` is the last slice of a window; each window comes out once, with its last slice.
    """

    def sink(batch: DataFrame, number: int) -> None:
        added = slices.add(batch, number)
        if added is not None:
            recent, first = added
            emit(build(recent.withColumnRenamed("wid", "slice_id")).filter(last() >= first), number)

    return sink


def sliding_sink(slices: Slices, length: int, emit: Callable[[DataFrame, int], None]):
    """of_slices for sliding windows of `length` slices, full ones only."""
    return of_slices(slices, lambda sliced: ev.sliding(sliced, length), lambda: F.col("wid") + (length - 1), emit)


def multi_query_sink(slices: Slices, queries: int, emit: Callable[[DataFrame, int], None]):
    """of_slices for tumbling windows of 1 to `queries` slices, full ones only."""
    return of_slices(slices, lambda sliced: ev.multi_query(sliced, queries), lambda: (F.col("wid") + 1) * F.col("query_id") - 1, emit)


def ratio_join_stream(events: DataFrame, *, span_ms: int = SPAN_MS, ts_col: str = "ts", type_col: str = "event_type") -> DataFrame:
    """The click/view ratio as a full outer join of two windowed streams, for clicks and views that come separately."""

    def counted(kind: str) -> DataFrame:
        own = events.filter(F.col(type_col) == kind)
        return own.groupBy(F.window(ts_col, f"{span_ms} milliseconds").alias("w"), "c_id").agg(F.count("*").alias(f"{kind}_count"), F.max(ts_col).alias(f"{kind}_time"))

    met = counted("click").join(counted("view"), ["w", "c_id"], "full_outer")
    clicks, views = F.coalesce("click_count", F.lit(0)).cast("long"), F.coalesce("view_count", F.lit(1)).cast("long")
    wid = F.expr(f"unix_millis(w.start) div {span_ms}")
    return met.select(wid.alias("wid"), "c_id", clicks.alias("click_count"), views.alias("view_count"), (clicks / views).alias("ratio"), F.greatest("click_time", "view_time").alias("max_event_time"))
