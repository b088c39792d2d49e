"""Connected components of many graphs at once, by alternating large and small stars.

Edges are rows (group, u, v); no edge leaves its group. Each round is two group-bys over all graphs, and is written to the shared folder; at the
end each node has one edge at most, to the smallest node of its component. What a round sends to one node's task is that node's
edges, which the large stars before have spread over the component's nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, written


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest one, itself included."""
    both = edges.unionByName(edges.select("group", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("group", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, ["group", "u"]).select("group", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them; edges have u > v."""
    least = edges.groupBy("group", "u").agg(F.min("v").alias("m"))
    others = edges.join(least, ["group", "u"]).select("group", F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("group", "u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("group", "u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(group, node, root) of the nodes that are not the smallest of their component."""
    now = written(edges.select("group", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before, mark = None, _mark(now)
    while mark != before:
        old, now = now, written(_small(_large(now)))
        before, mark = mark, _mark(now)
        discard(old)
    return now.select("group", F.col("u").alias("node"), F.col("v").alias("root"))
