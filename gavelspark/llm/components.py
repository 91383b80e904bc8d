"""Connected components by alternating stars, with tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_heat, written


def are_stars(edges: DataFrame) -> bool:
    """Whether each node u of edges (u > v) has one v, and no v is a u: then v
    is the smallest node of its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node that has an edge to another; root is the
    smallest node of its component.

    Each round hangs a node's larger neighbours on its smallest one, then its
    smaller ones; the edges shrink to one star a component in about log(n)
    rounds. The edges of a node that holds many of them are met where they stand
    (see join_by_heat), those of others in a shuffle. Each round ends in a
    written table; edges that are stars already cost one look."""
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not are_stars(e):
        total = e.count()
        both = e.union(e.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n")).select("x", F.least("x", "m").alias("m"), "n")
        large = written(join_by_heat(both.where("y > x"), least, "x", "n", 2 * total).select(F.col("y").alias("u"), F.col("m").alias("v")), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_by_heat(large, low, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(low.select("u", "m")).distinct(), "edges")
    own = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own)
