"""Predicates of a column against a constant, and their conjunction."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def greater(column: str, value: Any) -> Column:
    return F.col(column) > F.lit(value)


def less(column: str, value: Any) -> Column:
    return F.col(column) < F.lit(value)


def equal(column: str, value: Any) -> Column:
    return F.col(column) == F.lit(value)


def like(column: str, pattern: str) -> Column:
    """SQL LIKE: % and _ stand for any characters and any one."""
    return F.col(column).like(pattern)


def all_of(conditions: Iterable[Column]) -> Column:
    """True where all hold; without conditions, everywhere."""
    return reduce(and_, conditions, F.lit(True))
