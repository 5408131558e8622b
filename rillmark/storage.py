"""Storage that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where the session names none and runs on one machine only (a local master, as in
    tests), a local temporary folder stands for it; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {context.master} share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="rillmark-")
    return _local[context.applicationId]


def scratch(spark: SparkSession) -> str:
    """A new folder name in the storage that all executors share.

    The folder's owner clears it (see clear); what is written here may be read by
    results that have not run yet.
    """
    return f"{shared_root(spark)}/rillmark/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that was written to scratch folders, once no result needs it any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/rillmark")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def drop(table: DataFrame) -> None:
    """Delete a table that `materialize` gave, once nothing that still has to run reads it."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_tables.pop(table))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Folders of the written tables that are still in use by their frames.
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Rows of a file, where a table's rows are known.
FILE_ROWS = 100_000


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df to shared storage and read it back.

    Cuts the lineage; the rows survive the loss of any executor.  Where about so many
    `rows` are known, they are written by no more tasks than they need.
    """
    spark = df.sparkSession
    path = scratch(spark)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[table] = path
    return table


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, also where only the driver has it: once per application, as a zip that Spark hands out."""
    context = spark.sparkContext
    folder = os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _shipped or not os.path.isdir(folder):
        return
    _shipped.add(context.applicationId)
    made = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="rillmark-")), "rillmark.zip")
    with zipfile.ZipFile(made, "w") as archive:
        for place, _, names in os.walk(folder):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(place, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(folder)))
    context.addPyFile(made)
