"""Connected components of a table of edges, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import discard, materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the least node reachable.

    Large-star and small-star rounds (a logarithmic number of them); each writes its edges,
    so lineage stays short.  The least neighbours of all nodes, which are summed before they are dealt,
    are written too: both sides of a join are then dealt for it alone, and Spark can split the
    edges of a node that has very many.  Loops, nulls and repeated edges count for nothing.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        old = now
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        was, mark = mark, _mark(now)
        for done in (old, least, large, low):
            discard(done)
        if was == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
