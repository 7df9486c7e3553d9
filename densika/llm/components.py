"""Connected components by alternating large and small stars, on DataFrames.

Each pass hangs the neighbours of every node on the smallest of them, so the edges become stars around the
smallest node of each component in a number of passes that grows with the logarithm of its size.  A node
with very many neighbours costs a partial minimum and a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densika.llm.storage import drop, store


def _star(both: DataFrame, large: bool) -> DataFrame:
    """``both`` holds every edge once as (u, v), u > v for the small star and in both directions for the large."""
    least = both.groupBy(F.col("u").alias("hub")).agg(F.min("v").alias("m")).select("hub", F.least("hub", "m").alias("m"))
    if large:  # stored, so that the join of a hub's many neighbours can be split
        least = store(least, "hubs")
    joined = both.join(least, F.col("u") == F.col("hub"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("hub").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(u, v)`` in any order to ``(node, component)``, the smallest node; nodes that are their own are left out."""
    edges = store(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        turned = store(_star(_star(both, True), False), "edges")
        drop(edges)
        edges = turned
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
