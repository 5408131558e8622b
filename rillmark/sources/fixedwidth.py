"""Files of fixed-width binary rows: little-endian int32, float32, and characters padded with blanks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.storage import ship_package

#: Rows decoded at a time, and bytes of a file that one task reads.
ROWS, SPLIT_BYTES = 100_000, 64 << 20
#: A field is (name, kind): "int", "float", or the number of its characters.
Fields = Sequence[tuple[str, str | int]]


def _dtype(fields: Fields) -> np.dtype:
    return np.dtype([(n, {"int": "<i4", "float": "<f4"}.get(k, f"S{k}")) for n, k in fields])


def _spark(fields: Fields) -> str:
    return ", ".join(f"`{n}` {k if k in ('int', 'float') else 'string'}" for n, k in fields)


def read_fixed(spark: SparkSession, path: str, fields: Fields, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of all files at path; blanks and zero bytes at the end of characters are no part of them, nor is a cut row at a file's end.

    Files are read in ranges of whole rows, so that a file may be of any size and is
    read by many tasks; only files' names and lengths are listed beforehand.
    """
    dtype = _dtype(fields)
    size = dtype.itemsize
    step = max(1, split_bytes // size) * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                # Hadoop writes file:/x where others write file:///x
                store, place = fs.FileSystem.from_uri(f"file://{file[5:]}" if file.startswith("file:/") and not file.startswith("file://") else file)
                with store.open_input_file(place) as source:
                    source.seek(start)
                    while start < end:
                        part = np.frombuffer(source.read(min(ROWS * size, end - start)), dtype)
                        start += len(part) * size
                        arrays = [pa.array(part[n].copy()) if k in ("int", "float") else pa.array([v.decode("utf-8", "replace").rstrip(" ") for v in part[n].tolist()], pa.string()) for n, k in fields]
                        yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

    ship_package(spark)
    # without the content, only the listing is read
    files = spark.read.format("binaryFile").load(path).select("path", (F.col("length") - F.col("length") % size).alias("bytes")).filter("bytes > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("start"), "bytes")
    ranges = ranges.select("path", "start", F.least("bytes", F.col("start") + step).alias("end"))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / F.lit(step)))).first()[0] or 1
    return ranges.repartition(min(int(n), 100_000), "path", "start").mapInArrow(run, _spark(fields))


def write_fixed(df: DataFrame, folder: str, fields: Fields) -> DataFrame:
    """Write each partition as a file of fixed-width rows; returns (file, rows) once it is run.

    Files appear under their name only when whole, so a retried task replaces its own.
    Characters beyond a field's width are cut; nulls are 0 or blank.
    """
    dtype = _dtype(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        temporary, name = f"{root}/.part-{task.taskAttemptId()}.tmp", f"part-{task.partitionId():05d}.bin"
        count = 0
        with store.open_output_stream(temporary, compression=None) as out:
            for batch in batches:
                rows = np.zeros(batch.num_rows, dtype)
                for (n, k), column in zip(fields, batch.columns, strict=True):
                    if k in ("int", "float"):
                        rows[n] = np.array([0 if v is None else v for v in column.to_pylist()], rows[n].dtype)
                    else:
                        rows[n] = [(v or "").encode()[:k].ljust(k) for v in column.to_pylist()]
                out.write(rows.tobytes())
                count += batch.num_rows
        store.move(temporary, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], names=["file", "rows"])

    ship_package(df.sparkSession)
    return df.select(*[n for n, _ in fields]).mapInArrow(run, "file string, rows bigint")


def write_ints(spark: SparkSession, folder: str, n: int, parts: int = 4) -> DataFrame:
    """The integers from 0 to n - 1 as files of int32."""
    return write_fixed(spark.range(0, n, 1, parts).selectExpr("cast(id as int) as value"), folder, [("value", "int")])
