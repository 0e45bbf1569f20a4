"""Connected components of a graph of bigint nodes by alternating large and small stars.

Each round is a grouped minimum and a join, both splittable; nothing is gathered on the
driver but two counters a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (those above it for a large star, below it for a small one) hang on the least of all it sees."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (u, v); component: the least node it reaches."""
    edges = runtime.durable(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = None
    while True:
        before, edges = edges, runtime.durable(_star(_star(edges, True), False), "stars")
        runtime.drop(before)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    found = runtime.durable(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct()), "components")
    runtime.drop(edges)
    return found
