"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by (60 bits of the text's MD5, id), so equal texts lie side
by side, and cut into shards of near equal bytes:

1. a sample whose draws are weighted by size gives quantile boundaries for many
   more ranges than shards;
2. one pre-aggregated count finds each range's exact bytes and rows, and ranges
   that are overfull in either are resampled and subdivided;
3. a running sum inside each range, on top of the bytes of all ranges before it,
   places every record; nothing but the ranges' totals reaches the driver.

The text is read once, to a narrow table; only that is shuffled.  Sizes of the
shards differ by less than two of the largest documents.

Defined cases: null text counts as empty (size 1, CRC of no bytes); null ids come
first; repeated rows are interchangeable and keep a slot each; a hot text is
split by id; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import materialize, pick, unit_hash

#: Rows that a range should hold, least ranges per shard, most ranges at first, draws per range.
RANGE_ROWS, RANGES_PER_SHARD, MAX_RANGES, DRAWS = 200_000, 32, 4096, 32
#: A range is overfull beyond this many times its due share; this many rounds subdivide such ranges.
OVERFULL, ROUNDS = 3, 4
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _longs(values) -> str:
    return "array(" + ",".join("bigint('%d')" % v if v == _LOW else f"{v}L" for v in values) + ")"


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of boundaries at or below (k, t), by binary search in two literal arrays."""
    if not bounds:
        return F.lit(0)
    bits = len(bounds).bit_length()
    full = bounds + [(_HIGH, _HIGH)] * ((1 << bits) - 1 - len(bounds))
    ks, ts = _longs(b[0] for b in full), _longs(b[1] for b in full)
    steps = ",".join(str(1 << i) for i in reversed(range(bits)))
    return F.expr(
        f"aggregate(array({steps}), 0, (a, s) -> if(element_at({ks}, a + s) < k"
        f" or (element_at({ks}, a + s) = k and element_at({ts}, a + s) <= t), a + s, a))"
    )


def _sample(table: DataFrame, weight: Column, seed: int) -> list[tuple[int, int, int]]:
    """(k, t, draws), sorted; `weight` is the expected number of draws of a record."""
    whole = F.floor(weight)
    draws = whole + (unit_hash(seed, F.col("k"), F.col("t")) < weight - whole).cast("long")
    return sorted(tuple(r) for r in table.select("k", "t", draws.alias("draws")).filter("draws > 0").collect())


def _quantiles(sample: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int]]:
    total, seen, out = sum(d for *_, d in sample), 0, []
    for k, t, d in sample:
        if seen and (seen * parts) // total != ((seen + d) * parts) // total:
            out.append((k, t))
        seen += d
    return out


def assign_shards(docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> DataFrame:
    """Per record: id, size, text_crc32, shard, slot (its place in the shard, from 0 without gaps)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    integral = isinstance(docs.schema[docs.columns.index(id_col)].dataType, T.IntegralType)
    tie = F.col(id_col).cast("long") if integral else F.xxhash64(id_col)
    table = materialize(
        pick(docs, id_col, text_col).select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("k"),
            F.coalesce(tie, F.lit(_LOW)).alias("t"),
        )
    )
    rows, total = table.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not rows:
        return table.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    n_ranges = min(MAX_RANGES, max(RANGES_PER_SHARD * n_shards, -(-rows // RANGE_ROWS)))
    bounds = _quantiles(_sample(table, F.col("size") * F.lit(n_ranges * DRAWS / total), seed), n_ranges)
    for turn in range(ROUNDS + 1):
        ranged = table.withColumn("rid", _range_of(bounds))
        found = {r["rid"]: (r["bytes"], r["rows"]) for r in ranged.groupBy("rid").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        parts = {r: max(b * n_ranges / total, n * n_ranges / rows) for r, (b, n) in found.items()}
        over = {r: p for r, p in parts.items() if p > OVERFULL}
        if not over or turn == ROUNDS:
            break
        rate = F.element_at(F.create_map(*[x for r in over for x in (F.lit(r), F.lit(over[r] * DRAWS / found[r][1]))]), F.col("rid"))
        again = _sample(ranged.filter(F.col("rid").isin(*over)), rate, seed + turn + 1)
        grouped: dict[int, list] = {}
        for one in again:
            grouped.setdefault(bisect_right(bounds, one[:2]), []).append(one)
        more = {b for r, s in grouped.items() for b in _quantiles(s, max(2, round(over.get(r, 2))))}
        if more <= set(bounds):
            break  # rows of one key only, which are alike
        bounds = sorted({*bounds, *more})
    bytes_to, rows_to, base_bytes, base_rows = 0, 0, [], []
    for r in range(len(bounds) + 1):
        base_bytes.append(bytes_to)
        base_rows.append(rows_to)
        b, n = found.get(r, (0, 0))
        bytes_to, rows_to = bytes_to + b, rows_to + n
    at = Window.partitionBy("rid").orderBy("k", "t")
    inside = F.coalesce(F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        ranged.withColumn("inside", inside)
        .withColumn("nth", F.row_number().over(at) - 1)
        .withColumn("before", F.col("inside") + F.expr(f"element_at({_longs(base_bytes)}, rid + 1)"))
        .withColumn("row", F.col("nth") + F.expr(f"element_at({_longs(base_rows)}, rid + 1)"))
        .withColumn("shard", F.expr(f"cast(cast(before as decimal(28,0)) * {n_shards} div {total} as int)"))
    )
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "row"))
    starts, seen = [], 0
    counts = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    for s in range(n_shards):
        starts.append(seen)
        seen += counts.get(s, 0)
    slot = F.col("row") - F.expr(f"element_at({_longs(starts)}, shard + 1)")
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))


def _shaped(shards: DataFrame) -> DataFrame:
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_documents(docs: DataFrame) -> DataFrame:
    """The shape of op3: eight shards under the law of near equal bytes."""
    return _shaped(assign_shards(docs, 8))


def op3_shard(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for all documents."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH own AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS k FROM documents),
crc AS (
  SELECT *, xor(list_reduce(
      list_transform(range(0, 2 * (size - 1)),
        lambda i: CAST(strpos('0123456789ABCDEF', substr(h, CAST(i + 2 - 2 * (i % 2) AS BIGINT), 1)) - 1 AS BIGINT)),
      lambda c, n: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
        3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][CAST((xor(c, n) & 15) + 1 AS BIGINT)]),
      CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM own),
o AS (SELECT *, sum(size) OVER (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before,
             sum(size) OVER () AS total FROM crc),
s AS (SELECT *, CAST(before * 8 // total AS INTEGER) AS shard FROM o)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY k, doc_id NULLS FIRST) - 1 AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""
