"""Connected components by alternating large and small stars, as joins and groupings of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import keep


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the node's smallest neighbour (or the node itself)."""
    both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
    least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
    return both.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("least").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = edges.join(least, "hi").where("lo > least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("least").alias("lo"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Labels each node of the undirected `edges` with the smallest node reachable.

    Returns (node, component) for nodes that are not the smallest of their component. Loops and rows with a null
    end are no links. Every round is written to the shared folder, so lineage stays short and executors may be lost.
    """
    star = keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    seen = mark(star)
    while seen[0]:
        star = keep(_small_star(_large_star(star)))
        now = mark(star)
        if now == seen:
            break
        seen = now
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
