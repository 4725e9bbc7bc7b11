"""Connected components of an edge table: distributed union-find by alternating large-star and small-star steps.

Each step sends a node's larger (or all smaller) neighbours to the least node it knows; edges never grow in number and
the table ends as stars around each component's least node. Minima are partially aggregated before they are exchanged,
and each step's inputs are stored tables, so a join on a node with very many neighbours can be split.

DataFrame operations only. No edges give no rows. Repeated edges and self-loops are ignored, as are edges with a null end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.runtime import released, stored

MAX_ROUNDS = 100


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge touches; component is its least node."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a") != F.col("b"))
    e = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(e)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = stored(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = stored(both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        nearest = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(nearest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, stored(small.unionAll(nearest.select("u", F.col("m").alias("v"))).distinct())
        released(old, least, large, nearest)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not converge")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    # the one table that the result reads, for ``released``
    out.stored_at = e.stored_at
    return out
