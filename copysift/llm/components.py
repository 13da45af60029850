"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copysift.llm.frames import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component_id): for every node of ``edges`` the smallest node that it is connected with.

    Each step is two group-bys with partial aggregation and two joins on a node, so a node with a third
    of all edges is combined on the map side and split by adaptive execution in the joins. Edges with a
    null end and loops are ignored. The number of rounds grows with the logarithm of the largest
    component; edges are cut to the shared folder after each one.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        moved = large.join(least, "high").where("low > m").select(F.col("m").alias("low"), F.col("low").alias("high"))
        edges = cut(moved.unionByName(least.select(F.col("m").alias("low"), "high")).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component_id")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component_id")).unionByName(roots)
