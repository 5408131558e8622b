"""The relational toolkit: selection, projection, distinct, joins, groups, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import all_of


def select(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.filter(all_of(conditions))


def select_project(df: DataFrame, columns: Sequence[str], *conditions: Column) -> DataFrame:
    return select(df, *conditions).select(*columns)


def select_distinct(df: DataFrame, *conditions: Column) -> DataFrame:
    return select(df, *conditions).distinct()


def select_project_distinct(df: DataFrame, columns: Sequence[str], *conditions: Column) -> DataFrame:
    """Distinct over all columns, then the projection, which may hold repeats."""
    return select(df, *conditions).distinct().select(*columns)


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], columns: Sequence[str] | None = None, *conditions: Column) -> DataFrame:
    """Inner equi-join on pairs of (left, right) columns, filtered and projected.

    The planner broadcasts a side it knows to be small and sorts and merges
    otherwise; conditions on one side reach that side's scan.
    """
    met = left.join(right, all_of(left[a] == right[b] for a, b in on), "inner")
    met = select(met, *conditions)
    return met if columns is None else met.select(*columns)


AGGREGATES = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}


def _aggregate(kind: str, column: str | None) -> Column:
    return F.count("*") if kind == "count" else AGGREGATES[kind](column)


def group_by(df: DataFrame, keys: Sequence[str], aggregates: dict[str, tuple[str, str | None]], *conditions: Column) -> DataFrame:
    """Groups with aggregates {name: (min | max | count | sum | avg, column)}, after the conditions."""
    return select(df, *conditions).groupBy(*keys).agg(*[_aggregate(k, c).alias(n) for n, (k, c) in aggregates.items()])


def group_by_all(df: DataFrame, aggregates: dict[str, tuple[str, str | None]], *conditions: Column) -> DataFrame:
    """One row over all rows; over none, counts are 0 and other aggregates null."""
    return select(df, *conditions).agg(*[_aggregate(k, c).alias(n) for n, (k, c) in aggregates.items()])


def sort(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*columns)


def sort_strings(df: DataFrame, *columns: str) -> DataFrame:
    """By the columns' text."""
    return df.orderBy(*[F.col(c).cast("string") for c in columns])


def top(df: DataFrame, by: Sequence[str], rows: int = 25, strings: bool = True) -> DataFrame:
    """The first rows by the columns (as text): each task keeps no more than `rows`."""
    return (sort_strings if strings else sort)(df, *by).limit(rows)


def union_all(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs, by column name."""
    first, *rest = inputs
    for one in rest:
        first = first.unionByName(one)
    return first


def shard_of(columns: Sequence[str], shards: int) -> Column:
    """The sum of integer columns modulo the number of shards, never negative."""
    return F.pmod(sum((F.col(c).cast("long") for c in columns), F.lit(0).cast("long")), F.lit(shards)).cast("int")
