"""Line dedup by two Bloom filters and exact confirmation of suspected repeats.

1. Every task puts its lines' digests into a filter of lines seen once and, where
   that holds them already, into one of lines seen twice.  Tasks' filters meet in
   a tree of merges by 64-kbit chunk: twice = twice | twice' | (once & once'), so a
   key of two documents is always in the second filter, wherever they lie.
2. Only lines that the second filter holds are counted: pre-aggregated per task,
   then summed by their 128-bit digest, with the first occurrence.  Keys found in
   enough documents are confirmed repeats.
3. The confirmed keys go to all tasks if they are few (the count is checked), and
   else meet the suspected lines in a salted join.

The filters' size follows the number of lines.  MAX_BITS bounds what is broadcast:
where filters for all lines would be larger, the lines' digests are written once,
parted by their range of values, and each range has filters of its own, one range at
a time.  So the filters never fill up, and results are the same.

Defined cases: a null text is one empty line; empty keys are never repeats; every
row is a document, repeated rows too; a null id comes first among occurrences; an
empty table gives no rows; a line of any length is one digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, join_hot, materialize, pick, scratch

#: Bits of a filter per line, hashes per line, and the least and most bits of a filter (32 MB) of one range.
BITS_PER_LINE, HASHES, MIN_BITS, MAX_BITS = 8, 4, 1 << 16, 1 << 28
CHUNK = 1 << 16
#: Filters merged by one task at a time.
FAN_IN = 48
#: Confirmed keys up to this number are broadcast (16 bytes each).
BROADCAST_KEYS = 1_000_000
_WHITE = WHITE.encode()


def _keys(text: bytes | None) -> list[bytes]:
    """The key of every line: stripped, ASCII letters lowered."""
    return [line.strip(_WHITE).lower() for line in (text or b"").split(b"\n")]


def _bits(digests: np.ndarray, m: int) -> np.ndarray:
    """(n, HASHES) bit positions of (n, 2) 64-bit halves, by double hashing."""
    step = digests[:, 1:] | np.uint64(1)
    return (digests[:, :1] + np.arange(HASHES, dtype=np.uint64) * step) & np.uint64(m - 1)


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at >> np.uint64(3), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))


def _held(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def held(bitmap: np.ndarray, digests: bytes) -> np.ndarray:
    """Whether the filter holds each 16-byte digest."""
    return _held(bitmap, _bits(np.frombuffer(digests, "<u8").reshape(-1, 2), len(bitmap) * 8))


def _packed(bitmap: np.ndarray) -> dict[int, bytes]:
    """Chunks with bits: as the 16-bit places of the bits if they are few, else as the bitmap."""
    filled = np.flatnonzero(bitmap)
    if not len(filled):
        return {}
    row, bit = np.nonzero(np.unpackbits(bitmap[filled][:, None], axis=1, bitorder="little"))
    places = filled[row] * 8 + bit
    chunk = places // CHUNK
    starts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
    out = {}
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(chunk)], strict=True):
        c = int(chunk[i])
        few = j - i < CHUNK // 16 - 1
        out[c] = (places[i:j] % CHUNK).astype("<u2").tobytes() if few else bitmap[c * CHUNK // 8 : (c + 1) * CHUNK // 8].tobytes()
    return out


def _counts(packed: list[bytes]) -> np.ndarray:
    """How many of the packed chunks have each bit."""
    few = b"".join(p for p in packed if len(p) != CHUNK // 8)
    total = np.bincount(np.frombuffer(few, "<u2"), minlength=CHUNK)
    for p in packed:
        if len(p) == CHUNK // 8:
            total += np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")
    return total


_FILTER = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _line_digests(text: bytes | None) -> bytes:
    return b"".join(xxhash.xxh3_128_digest(k) for k in dict.fromkeys(_keys(text)) if k)


def _filters(m: int, digests_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once, twice = np.zeros(m // 8, np.uint8), np.zeros(m // 8, np.uint8)
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            values = batch.column(0).to_pylist()
            halves = np.frombuffer(b"".join(map(digests_of, values) if digests_of else values), "<u8").reshape(-1, 2)
            order = np.argsort(halves[:, 0], kind="stable")
            halves = halves[order]
            same = np.zeros(len(halves), bool)  # an equal first half before it: at least the two are suspected
            same[1:] = halves[1:, 0] == halves[:-1, 0]
            at = _bits(halves, m)
            _set(twice, at[same | _held(once, at)].ravel())
            _set(once, at.ravel())
        part = TaskContext.get().partitionId()
        for first in range(0, m // CHUNK, 256):
            part_of = slice(first * CHUNK // 8, (first + 256) * CHUNK // 8)
            seen, again = _packed(once[part_of]), _packed(twice[part_of])
            cells = ([first + c for c in seen], [part] * len(seen), list(seen.values()), [again.get(c, b"") for c in seen])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _FILTER, strict=True)], schema=_FILTER)

    return run


def _merge(table: pa.Table) -> pa.Table:
    seen = _counts(table.column("once").to_pylist())
    again = (seen > 1) | (_counts(table.column("twice").to_pylist()) > 0)
    pack = lambda bits: _packed(np.packbits(bits, bitorder="little")).get(0, b"")
    cells = [[table.column("chunk")[0].as_py()], [table.column("up")[0].as_py()], [pack(seen > 0)], [pack(again)]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _FILTER, strict=True)], schema=_FILTER)


def filter_bits(keys: int, max_bits: int = MAX_BITS) -> int:
    """Bits of a filter for so many keys."""
    m = MIN_BITS
    while m < max_bits and m < keys * BITS_PER_LINE:
        m *= 2
    return m


def seen_twice(texts: DataFrame, m: int, digests_of=_line_digests) -> np.ndarray:
    """The merged filter, of m bits, of the 16-byte digests that `digests_of` gives more than once over all texts (None: that are there more than once)."""
    parts = texts.rdd.getNumPartitions()
    schema = "chunk int, part int, once binary, twice binary"
    level = texts.mapInArrow(_filters(m, digests_of), schema)
    merged = lambda up: level.withColumn("up", up).groupBy("chunk", "up").applyInArrow(_merge, schema)
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        level = merged(F.expr(f"cast(part div {FAN_IN} as int)"))
    level = merged(F.lit(0))
    bitmap = np.zeros(m // 8, np.uint8)
    for row in level.select("chunk", "twice").collect():
        if row["twice"]:
            bitmap[row["chunk"] * CHUNK // 8 : (row["chunk"] + 1) * CHUNK // 8] = np.packbits(_counts([bytes(row["twice"])]).astype(bool), bitorder="little")
    return bitmap


def _suspects(texts: list, bitmap: np.ndarray) -> list[dict[bytes, int]]:
    """Per text, the digests that the filter holds with the line each is first on."""
    found: list[dict[bytes, int]] = []
    for text in texts:
        first: dict[bytes, int] = {}
        for at, key in enumerate(_keys(text)):
            if key and key not in first:
                first[key] = at
        found.append({xxhash.xxh3_128_digest(k): at for k, at in first.items()})
    flat = b"".join(d for one in found for d in one)
    if not flat:
        return found
    may = held(bitmap, flat).tolist()
    out, i = [], 0
    for one in found:
        out.append({d: at for (d, at), h in zip(one.items(), may[i : i + len(one)], strict=True) if h})
        i += len(one)
    return out


def _counted(bitmap):
    """Per task: (key, documents, first row key, first line); occurrences in order of the text's row key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}

        def out() -> pa.RecordBatch:
            values = list(seen.values())
            arrays = [pa.array(list(seen), pa.binary()), pa.array([v[0] for v in values], pa.int64())]
            arrays += [pa.array([v[1][0] for v in values], pa.binary()), pa.array([v[1][1] for v in values], pa.int32())]
            seen.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["key", "n", "row", "line"])

        for batch in batches:
            rows = batch.column(0).to_pylist()
            for row, one in zip(rows, _suspects(batch.column(1).to_pylist(), bitmap.value), strict=True):
                for digest, line in one.items():
                    if (had := seen.get(digest)) is None:
                        seen[digest] = [1, (row, line)]
                    else:
                        had[0] += 1
                        had[1] = min(had[1], (row, line))
            if len(seen) > 300_000:
                yield out()
        if seen:
            yield out()

    return run


def _listed(ranges: int):
    """(part, key, row, line): the digests of each text's lines with the line each is first on, and the range they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                owner, lines, keys = [], [], []
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    first: dict[bytes, int] = {}
                    for line, key in enumerate(_keys(text)):
                        if key:
                            first.setdefault(key, line)
                    owner += [row] * len(first)
                    lines += first.values()
                    keys += map(xxhash.xxh3_128_digest, first)
                upper = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)[:, 1] >> np.uint64(32)
                part = ((upper * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)
                arrays = [pa.array(part), pa.array(keys, pa.binary()), pa.array(owner, pa.binary()), pa.array(lines, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "key", "row", "line"])

    return run


def _passed(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            yield batch.filter(pa.array(held(bitmap.value, b"".join(keys)))) if keys else batch

    return run


def ranged_suspects(table: DataFrame, n_lines: int, ranges: int) -> DataFrame:
    """(key, row, line) of the lines of (row, text) that the filters of their range hold twice."""
    spark = table.sparkSession
    folder = scratch(spark)
    table.select("row", "text").mapInArrow(_listed(ranges), "part int, key binary, row binary, line int").write.partitionBy("part").parquet(folder)
    listed = spark.read.schema("key binary, row binary, line int, part int").parquet(folder)
    out: DataFrame | None = None
    for part in range(ranges):
        own = listed.filter(F.col("part") == part).select("key", "row", "line")
        bitmap = spark.sparkContext.broadcast(seen_twice(own.select("key"), filter_bits(-(-n_lines // ranges), 1 << 62), None))
        found = materialize(own.mapInArrow(_passed(bitmap), "key binary, row binary, line int"))
        bitmap.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


_KEPT = "doc_id {id}, n_lines bigint, n_dropped bigint, text binary"


def _keep(text: bytes | None, row: bytes, drops: dict[bytes, tuple | None]) -> tuple[int, int, bytes]:
    lines = (text or b"").split(b"\n")
    if not drops:
        return len(lines), 0, text or b""
    kept = []
    for at, line in enumerate(lines):
        key = line.strip(_WHITE).lower()
        if key and (digest := xxhash.xxh3_128_digest(key)) in drops and drops[digest] != (row, at):
            continue
        kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _applied(drops, listed: bool):
    """Drops the lines: `drops` holds all confirmed keys, or, if None, a third column lists each document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            own = [dict(map(_entry, x or ())) for x in batch.column(3).to_pylist()] if listed else [drops.value] * len(rows)
            done = [_keep(*x) for x in zip(texts, rows, own, strict=True)]
            n, dropped, kept = zip(*done, strict=True) if done else ((), (), ())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_lines", "n_dropped", "text"])

    return run


def _entry(x) -> tuple[bytes, tuple | None]:
    key, row, line = (x["key"], x["row"], x["line"]) if isinstance(x, dict) else x
    return bytes(key), None if row is None else (bytes(row), line)


def row_key(df: DataFrame, id_col: str, body: Column) -> Column:
    """Bytes that tell rows apart by id and text, in the id's order: null first, integers by value, other ids as text."""
    if dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        ordered = F.unhex(F.lpad(F.hex(F.col(id_col).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    else:
        ordered = F.concat(F.col(id_col).cast("string").cast("binary"), F.lit(b"\0"))
    ordered = F.when(F.col(id_col).isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), ordered))
    return F.concat(ordered, F.unhex(F.substring(F.md5(body), 1, 16)))


def key_id(key: Column, kind: str) -> Column:
    """The id that row_key put into a key; null for null."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        value = F.conv(F.hex(F.substring(key, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    else:
        value = F.substring(key, F.lit(2), F.length(key) - 10)
    return F.when(F.substring(key, 1, 1) == F.lit(b"\1"), value.cast("string").cast(kind))


def line_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 2,
    keep_first: bool = True,
    max_bits: int = MAX_BITS,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Drop lines whose key at least `min_docs` (2 or more) documents hold; with keep_first, all but the first occurrence.

    Returns doc_id, n_lines, n_dropped and the kept text.  The first occurrence is
    that of the least id (as an order-keeping byte string for integers, else by
    its text), then the least digest of the text, on its first line; rows alike in
    id and text keep it in each.
    """
    if min_docs < 2:
        raise ValueError("min_docs is 2 at least: the filters tell repeats only")
    plain = pick(docs, id_col, text_col)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    table = plain.select(
        F.col(id_col).alias("doc_id"),
        row_key(plain, id_col, body).alias("row"),
        body.alias("text"),
    )
    n_lines = table.agg(F.sum(F.length("text") - F.length(F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))).cast("long") + 1)).first()[0] or 0
    sc = docs.sparkSession.sparkContext
    ranges = -(-n_lines * BITS_PER_LINE // max_bits)
    suspects = bitmap = None
    if ranges > 1:
        suspects = ranged_suspects(table, n_lines, ranges)
        counts = suspects.withColumn("n", F.lit(1))
    else:
        bitmap = sc.broadcast(seen_twice(table.select("text"), filter_bits(n_lines, max_bits)))
        counts = table.select("row", "text").mapInArrow(_counted(bitmap), "key binary, n bigint, row binary, line int")
    found = counts.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("row", "line")).alias("at")).filter(F.col("n") >= min_docs)
    at = F.col("at")
    drops = materialize(found.select("key", "n", *[(at[c] if keep_first else F.lit(None).cast(t)).alias(c) for c, t in (("row", "binary"), ("line", "int"))]))
    schema = _KEPT.format(id=dict(table.dtypes)["doc_id"])
    if drops.count() <= broadcast_keys:
        known = sc.broadcast(dict(_entry((r["key"], r["row"], r["line"])) for r in drops.collect()))
        kept = table.mapInArrow(_applied(known, False), schema)
    else:

        def suspected(batches):
            for batch in batches:
                pairs = [(r, d) for r, one in zip(batch.column(0).to_pylist(), _suspects(batch.column(1).to_pylist(), bitmap.value), strict=True) for d in one]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["own", "key"])

        if suspects is None:
            suspects = table.select("row", "text").mapInArrow(suspected, "own binary, key binary")
        else:
            suspects = suspects.select(F.col("row").alias("own"), "key")
        met = join_hot(suspects, drops, "key", "n", "own", drops.agg(F.sum("n")).first()[0])
        listed = met.groupBy("own").agg(F.collect_set(F.struct("key", "row", "line")).alias("drops"), F.count("*").alias("n"))
        # each of the rows alike in id and text has every key once
        listed = materialize(listed.select(F.col("own").alias("row"), "drops", F.expr("n div size(drops)").alias("n")))
        met = join_hot(table.withColumn("place", F.monotonically_increasing_id()), listed, "row", "n", "place", table.count(), "left")
        kept = met.select("doc_id", "row", "text", "drops").mapInArrow(_applied(None, True), schema)
    return kept.withColumn("text", F.col("text").cast("string"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents go from all of them: doc_id, n_lines, n_dropped, kept_sha256."""
    kept = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_docs=10, keep_first=False)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, u.line AS line,
         translate(trim(u.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'line': x, 'i': i})) AS u
        FROM documents)),
often AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, o.k IS NOT NULL AS gone FROM lines l LEFT JOIN often o ON l.k = o.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
