"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v.

    Large: each node ties its larger neighbours to its least neighbour or itself.
    Small: each node ties its smaller neighbours and itself to the least of them.
    Least neighbours come from a pre-aggregated minimum, so a hub costs no task.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b); the label is the least node of its component.

    Each step is written to shared storage; as many steps as the logarithm of the
    nodes, until the stars no longer change.
    """
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") > F.col("v")).distinct()
    stars = materialize(stars)
    state = None
    # a large star of n edges has n at most, and a small star of those as many again
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        stars = materialize(_star(materialize(_star(stars, True), now[0]), False), 2 * now[0])
    label = stars.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return materialize(label.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), 2 * now[0])
