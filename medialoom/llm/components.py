"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialoom.session import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)`` for every vertex that has an edge to another vertex; ``component`` is the smallest id.

    Each step hangs every vertex's neighbours on the smallest of them, first the larger neighbours, then the smaller
    ones. A step aggregates minima with map-side combine and joins them back, so no neighbourhood is gathered; every
    step is written to the shared folder. Steps end when the edges are stars, which edges that come as stars are at
    once. Edges with a null end, self loops and repeated edges add nothing. An empty edge table gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    cur = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    cur = materialize(cur.distinct(), "edges")
    while not are_stars(cur):
        both = cur.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            cur.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component"))
    ).distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether every larger end ``u`` of the distinct edges has one edge and is nobody's smaller end ``v``."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1)).isEmpty()
