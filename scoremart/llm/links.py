"""Connected components of undirected links, as Spark joins.

Links are contracted to stars by alternating steps on large and small neighbours; every step is an aggregation with
map-side combine and a join, written to the shared folder.  Nothing of the graph reaches the driver but two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _towards_least(pairs: DataFrame) -> DataFrame:
    """``u, m``: the least of each node and its neighbours in ``u, v``."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the least reachable node, for each node that occurs in a link.  Null ends link nothing."""
    clean = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = stage(clean.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_towards_least(both), "u").where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _towards_least(large)
        moved = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = least.select("u", F.col("m").alias("v"))
        edges = stage(moved.unionByName(kept).where("u <> v").distinct(), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = edges.select(F.col("v").alias("node")).distinct().join(stars.select("node"), "node", "left_anti")
    return stage(stars.unionByName(roots.select("node", F.col("node").alias("component"))), "components")
