"""Scalar functions, and the protocol for functions, aggregates and predicates of one's own.

A function is anything that maps Columns to a Column; built-in expressions stay in
generated code, and a pandas_udf (or, for aggregates, a grouped one) is the way out
where they cannot say it: it is called with Columns and gives one, like the others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnFunction = Callable[[Column], Column]


def times_ten(value: Column) -> Column:
    """Ten times the value."""
    return value * 10


def ratio(over: Column, under: Column) -> Column:
    """Quotient whose divisor is 1 at least."""
    return over / F.greatest(under, F.lit(1))


def hash_long(*columns: Column | str) -> Column:
    """A 64-bit hash of the columns."""
    return F.xxhash64(*columns)


def checksum(column: Column | str) -> Column:
    """CRC-32 of the column's bytes."""
    return F.crc32((F.col(column) if isinstance(column, str) else column).cast("binary"))


def random_int(low: int, high: int, *seed: Column | str) -> Column:
    """A number from low to high, both included, that depends on the seed columns only."""
    return (F.lit(low) + F.pmod(F.xxhash64(*seed), F.lit(high - low + 1))).cast("int")


def map_values(df: DataFrame, column: str, *functions: ColumnFunction) -> DataFrame:
    """Apply the functions to a column, one after the other; one projection, without a shuffle."""
    return df.withColumn(column, reduce(lambda c, f: f(c), functions, F.col(column)))


def reduce_values(df: DataFrame, column: str, aggregate: ColumnFunction = F.sum) -> DataFrame:
    """One row with the aggregate of a column, combined per task first."""
    return df.agg(aggregate(F.col(column)).alias(column))


def keyed_count(df: DataFrame, key: str) -> DataFrame:
    """(key, cnt)."""
    return df.groupBy(key).agg(F.count("*").alias("cnt"))


def keyed_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total); integers are summed as long."""
    return df.groupBy(key).agg(F.sum(value).alias("total"))
