"""Connected components by alternating large-star and small-star steps.

Both steps point nodes at the smallest id around them; in a few rounds every
node points straight at the smallest of its component. Edges stay in tables;
the driver only learns whether they are stars yet.

The node in the middle of a large component has an edge to all the others. So
the smallest neighbours, which are summed before they are shuffled, are written
down first and then joined: a join of two tables is one whose large partitions
Spark splits at run time, or a broadcast if the smaller one is small enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.frames import stage, unstage


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Larger neighbours of a node go to the smallest of it and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
    moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a != b").distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node and its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = (
        down.join(least, "a")
        .select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("e"))
        .select("e.a", F.col("e.m").alias("b"))
    )
    return moved.where("a != b").distinct(), least


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node that points at another does so once, and at one that
    points at none. One exchange of the nodes; a row or none reaches the driver."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("out")).union(edges.select("b", F.lit(0)))
    nodes = ends.groupBy("x").agg(F.sum("out").alias("out"), F.min("out").alias("low"))
    return nodes.where("out > 1 OR (out = 1 AND low = 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Label the nodes of undirected edges ``(a, b)``: ``(node, component)``.

    A component is named by its smallest node. Loops and repeated edges do no
    harm; nodes without edges are not listed; no edges give an empty result.
    """
    edges = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        for step in (_large_star, _small_star):
            moved, least = step(edges)
            fresh = stage(moved)
            unstage(edges, least)
            edges = fresh
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
