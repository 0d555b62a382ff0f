"""Connected components of a graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import drop_scratch, scratch, stage


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Hangs neighbours of each node on the smallest node of its neighbourhood.

    ``pairs`` (u, v). The smallest neighbour is a map-side combined minimum joined back to the
    pairs, so a node with very many neighbours is never gathered in one task: Spark splits its side
    of the join.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = pairs.join(least, "u")
    if large:
        return met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = least.filter("m < u").select("u", F.col("m").alias("v"))
    rest = met.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(own).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node reachable.

    Each step reads and writes one distributed table of edges in the shared folder; only a count and
    a checksum reach the driver. Loops and repeated edges are allowed, nulls are left out, and no
    edges give no rows.
    """
    spark = edges.sparkSession
    root = scratch(spark)
    plain = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).filter("x != y")
    now = stage(
        plain.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), f"{root}/0"
    )
    mark, step = None, 0
    while True:
        step += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        new = stage(_star(_star(both, True), False), f"{root}/{step}")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_scratch(spark, f"{root}/{step - 1}")
        now = new
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
