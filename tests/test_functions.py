"""Scalar functions, hashes, and functions of one's own."""

import zlib

import pandas as pd
import xxhash
from pyspark.sql import functions as F

from rillmark.functions.scalar import checksum, hash_long, map_values, ratio, reduce_values, times_ten


def test_hashes_equal_other_programs(spark):
    rows = spark.createDataFrame([(0, ""), (7, "abc"), (-5, "äöü 日本")], "n long, s string")
    for r in rows.select("n", "s", hash_long("n").alias("hn"), hash_long("s").alias("hs"), checksum("s").alias("c"), checksum(F.upper("s")).alias("u")).collect():
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        # the seed is 42, and a long is its eight bytes
        assert r["hn"] == signed(xxhash.xxh64_intdigest((r["n"] % (1 << 64)).to_bytes(8, "little"), 42))
        assert r["hs"] == signed(xxhash.xxh64_intdigest(r["s"].encode(), 42))
        assert r["c"] == zlib.crc32(r["s"].encode()) and r["u"] == zlib.crc32(r["s"].upper().encode())
    assert rows.select(hash_long("n", "s").alias("h")).distinct().count() == 3


def test_functions_of_ones_own_may_be_pandas_udfs(spark):
    @F.pandas_udf("long")
    def collatz(v: pd.Series) -> pd.Series:
        return v.where(v % 2 == 1, v // 2).where(v % 2 == 0, 3 * v + 1)

    @F.pandas_udf("double")
    def middle(v: pd.Series) -> float:
        return float(v.median())

    numbers = spark.range(10).withColumnRenamed("id", "value")
    step = lambda v: v // 2 if v % 2 == 0 else 3 * v + 1
    assert sorted(r["value"] for r in map_values(numbers, "value", collatz, times_ten).collect()) == sorted(10 * step(v) for v in range(10))
    assert reduce_values(numbers, "value", middle).first()["value"] == 4.5


def test_ratio_has_a_divisor_of_one_at_least(spark):
    rows = spark.createDataFrame([(3, 0), (3, 2)], "a long, b long").select(ratio(F.col("a"), F.col("b")).alias("q")).collect()
    assert [r["q"] for r in rows] == [3.0, 1.5]
