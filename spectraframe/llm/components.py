"""Connected components of an edge table, by alternating large and small stars.

Each round is two group-bys; every node keeps one edge at most towards a smaller node at the end. Nothing is
gathered on the driver but a count and a checksum. Every round is written to the shared folder, which cuts lineage. A
node's smallest neighbour goes to its edges by broadcast while edges have been counted and are few; else only those of hot
nodes do, so no task gets all edges of a large component's centre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, discard, join_sized, written


def _with_least(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """edges with the row (u, m, n) of their u; n is how many edges u has."""
    return edges.join(F.broadcast(least.drop("n")), "u") if rows <= MOST_BROADCAST else join_sized(edges, written(least), ["u"], "n", rows).drop("n")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node links its larger neighbours to its smallest one (itself included)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both.where("v > u"), least, 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = _with_least(edges, least, rows)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node with an edge in (u, v); the component is its smallest node."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while (mark := _mark(now)) != before:
        before, old = mark, now
        now = written(_small_star(_large_star(old, mark[0]), mark[0]))  # a large star has no more edges than there were
        discard(edges.sparkSession, old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
