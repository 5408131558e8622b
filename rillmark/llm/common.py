"""Helpers shared by the corpus operators: column picking, shared scratch storage, native text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.storage import materialize, scratch, ship_package

__all__ = ["WHITE", "WHITE_RE", "carried", "join_hot", "materialize", "pick", "scratch", "unit_hash", "words"]

#: A key of fewer rows than this is never hot.
HOT_ROWS = 10_000
#: The six ASCII white-space characters that separate words.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RE = r"[\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Exactly the named columns, found by exact name, and others under a new one (new=old).

    Extra columns are ignored whatever they are called, also when they differ
    from a wanted name in case only or repeat it (the first one counts).
    """
    ship_package(df.sparkSession)
    wanted = dict.fromkeys(names)
    wanted = {n: n for n in wanted} | renamed
    for name in wanted.values():
        if name not in df.columns:
            raise ValueError(f"no column {name!r} among {df.columns}")
    placed = df.toDF(*[f"_in{i}" for i in range(len(df.columns))])
    return placed.select(*[F.col(f"_in{df.columns.index(old)}").alias(new) for new, old in wanted.items()])


def carried(names: Sequence[str]) -> dict[str, str]:
    """Names under which operators hand on columns, whatever they are called: c_0 for the first, and so on."""
    return {f"c_{i}": name for i, name in enumerate(names)}


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RE))


def unit_hash(seed: int, *parts: Column) -> Column:
    """Uniform double in [0, 1) that depends on the seed and the parts only (52 bits of an MD5)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def join_hot(left: DataFrame, right: DataFrame, on: str | Sequence[str], rows: str, spread: str, total: int, how: str = "inner", salts: int = 32) -> DataFrame:
    """Join left to right, whose `on` is unique, so that no hot key lands in one task.

    `rows` is right's count of left rows of a key.  Keys of a thousandth of the
    `total` left rows or more, a thousand at most, are told to all tasks; their
    left rows are dealt over `salts` by a hash of column `spread`, and their right
    row is repeated for each.
    """
    keys = [on] if isinstance(on, str) else list(on)
    least = max(HOT_ROWS, -(-total // 1000))
    hot = right.filter(F.col(rows) >= least).select(*[F.col(k).alias(f"_hot{i}") for i, k in enumerate(keys)])
    dealt = left.join(F.broadcast(hot), [F.col(k) == F.col(f"_hot{i}") for i, k in enumerate(keys)], "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot0").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(salts))).cast("int")).drop(*hot.columns)
    every = F.when(F.col(rows) >= least, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_salt", F.explode(every)), [*keys, "_salt"], how).drop("_salt")
