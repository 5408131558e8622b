"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: payloads are told apart by SHA-1; of equal ones the row with the least id
is a response record and the others revisit it.  The first id of each repeated
payload comes from a pre-aggregated minimum, and payloads of many copies are dealt
over several tasks.  Each record is a gzip member of its own; tasks write whole
archives under a temporary name and rename them, so a retried task leaves no
half-written archive behind and replaces its own.

Reading: archives are cut into byte ranges.  A task looks for the gzip magic in its
range, takes a place for a record only if what starts there decodes to a WARC
header and a body of the length it states, and owns the records that start inside;
the last of them is read past the range's end.  Payloads are held against their
digests.

Both sides reach storage by pyarrow's file systems (local, HDFS, S3, GCS) from the
URI given; by default that is the shared folder in spark.checkpoint.dir.

Defined cases: a null payload is empty; a null id or URL has no header and reads as
null, and a null id is never the first of several; rows of one id and payload are
alike, and all of them responses if theirs is the least id; an empty table writes
no archive and reads as no rows; records of any size are read whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, materialize, pick, scratch

#: Largest archive before a new one is begun, bytes of a range, and bytes decoded at a time.
ARCHIVE_BYTES, SPLIT_BYTES, PIECE_BYTES = 1 << 30, 16 << 20, 64 << 10
#: Fixed values of the format.
MAGIC, MARK = b"\x1f\x8b\x08", b"WARC/"
VERSION = b"WARC/1.1\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2000-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("8d6f0e34-93f0-4c39-9f3b-2f1f0a7f3a11")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(name: str | None) -> bytes:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name if name is not None else '')}>".encode()


def _printable(text: str) -> bytes:
    return "".join(c if c > " " and c != "\x7f" else quote(c) for c in text).encode("utf-8", "surrogatepass")


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """A response or revisit record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _urn(page), b"WARC-Date: " + DATE]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _printable(url))
    if page is not None:
        head.append(b"X-Page-ID: " + quote(page, safe="").encode())
    head.append(b"WARC-Payload-Digest: sha1:" + digest(payload).encode())
    if revisit:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + _urn(refers_to), b"X-Refers-To-Page: " + quote(refers_to or "", safe="").encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    return _member(VERSION + b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n")


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _info() -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    head = [b"WARC-Type: warcinfo", b"WARC-Record-ID: " + _urn("warcinfo"), b"WARC-Date: " + DATE, b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(body)]
    return _member(VERSION + b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n")


def _written(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, size, records = None, "", 0, 0
        temporary = f"{root}/.part-{task.partitionId():06d}-{task.taskAttemptId()}.tmp"

        def close() -> None:
            nonlocal out
            out.close()
            store.move(temporary, f"{root}/{name}")
            done.append((f"{folder}/{name}", size, records))
            out = None

        for batch in batches:
            for page, url, payload, refers_to, revisit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{len(done):04d}.warc.gz"
                    out, records = store.open_output_stream(temporary, compression=None), 0
                    size = out.write(info := _info()) or len(info)
                data = record(page, url, payload, refers_to, revisit)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "bytes", "records"])

    return run


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row; returns the archives: file, bytes, records.  Payloads under revisit_bytes are never revisited."""
    spark = pages.sparkSession
    folder = (folder or scratch(spark)).rstrip("/")
    plain = pick(pages, id_col, url_col, html_col)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    table = plain.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    total, repeated = table.count(), table.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = join_hot(table, materialize(repeated), "sha1", "n", "page_id", total, "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.length("payload") >= revisit_bytes)
    rows = met.select(F.col("page_id").cast("string").alias("page"), "url", "payload", F.col("first").cast("string").alias("first"), revisit.alias("revisit"))
    return materialize(rows.mapInArrow(_written(folder, archive_bytes), "file string, bytes bigint, records bigint"))


def parse(data: bytes) -> dict | None:
    """Headers and body of a decoded record; None if data isn't one that is whole."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(MARK) or end < 0:
        return None
    head = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        head[name.strip().lower().decode("ascii", "replace")] = value.strip()
    length = head.get("content-length", b"")
    if not length.isdigit() or len(data) != end + 4 + int(length) + 4 or not data.endswith(b"\r\n\r\n"):
        return None
    return {"head": head, "body": data[end + 4 : -4]}


def _decode(pieces: Iterator[bytes | memoryview]) -> tuple[bytes, int] | None:
    """The first member of the pieces, and its compressed length; None if there is no WARC record."""
    unpacker = zlib.decompressobj(31)
    used, start, out = 0, b"", []
    try:
        for piece in pieces:
            used += len(piece)
            if len(start) < len(MARK):  # the start tells most false candidates; a piece at a range's end may be too short for it
                start += unpacker.decompress(piece, 64)
                if start[: len(MARK)] != MARK[: len(start)]:
                    return None
                piece = unpacker.unconsumed_tail
            out.append(unpacker.decompress(piece))
            if unpacker.eof:
                return start + b"".join(out), used - len(unpacker.unused_data)
    except zlib.error:
        pass
    return None


def records(source, start: int, end: int) -> Iterator[dict]:
    """The records that start in [start, end) of a seekable file of gzip members."""
    source.seek(start)
    data = source.read(end - start + len(MAGIC) - 1)
    view, at = memoryview(data), 0

    def pieces(at: int) -> Iterator[bytes | memoryview]:
        for i in range(at, len(data), PIECE_BYTES):
            yield view[i : i + PIECE_BYTES]
        source.seek(start + len(data))
        while piece := source.read(PIECE_BYTES):
            yield piece

    while 0 <= (at := data.find(MAGIC, at)) < end - start:
        found = _decode(pieces(at))
        one = parse(found[0]) if found else None
        if one is None:
            at += 1
            continue
        yield one
        at += found[1]


def _page(one: dict) -> tuple | None:
    """(page, url, type, payload, bytes, digest, refers_to) of a response or revisit record."""
    head, kind = one["head"], one["head"].get("warc-type", b"").decode()
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = one["body"].partition(b"\r\n\r\n")
    size = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), len(payload))
    stated = head.get("warc-payload-digest", b"").decode().removeprefix("sha1:")
    if kind == "response" and (digest(payload) != stated or len(payload) != size):
        raise ValueError(f"a payload differs from its digest sha1:{stated}")
    text = lambda name: unquote(head[name].decode()) if name in head else None
    url = head["warc-target-uri"].decode("utf-8", "surrogatepass") if "warc-target-uri" in head else None
    return text("x-page-id"), url, kind, payload if kind == "response" else None, size, stated, text("x-refers-to-page") if kind == "revisit" else None


def _read(with_payload: bool):
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], kind) for i, kind in enumerate(kinds)], names=names)
            held.clear()
            return made

        for batch in batches:
            for file, start, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as source:
                    for one in records(source, start, end):
                        if (page := _page(one)) is not None:
                            held.append(page if with_payload else (*page[:3], None, *page[4:]))
                            size += len(page[3] or b"") if with_payload else 0
                            if len(held) >= 5000 or size > 16 << 20:
                                yield out()
                                size = 0
        yield out()

    return run


def read_archives(spark: SparkSession, archives: DataFrame, *, split_bytes: int = SPLIT_BYTES, with_payload: bool = True, id_type: str = "string") -> DataFrame:
    """Response and revisit records of the archives (file, bytes): page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to."""
    plain = pick(archives, "file", "bytes").filter(F.col("bytes") > 0)
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    splits = plain.select("file", "bytes", F.explode(starts).alias("start")).select("file", "start", F.least("bytes", F.col("start") + split_bytes).alias("end"))
    n = plain.agg(F.sum(F.ceil(F.col("bytes") / F.lit(split_bytes)))).first()[0] or 1
    schema = "page_id string, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to string"
    read = splits.repartition(min(int(n), 100_000)).mapInArrow(_read(with_payload), schema)
    return read.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    read = read_archives(spark, write_archives(pages), with_payload=False, id_type=dict(pages.dtypes)["page_id"])
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
bits AS (
  SELECT page_id, b, p.h, first,
         list_transform(range(0, 8), lambda g: CAST('0x' || substr(p.h, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT)) AS five
  FROM p JOIN f ON p.h = f.h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(five, lambda v: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> s) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM bits
"""
