"""Connected components of an edge table, without bringing links or labels to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.sources.scratch import save_scratch

#: Alternating star rounds take about the logarithm of the longest shortest path.
MAX_ROUNDS = 40


def spanning_roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each node over the given edges."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _join_minimum(rows: DataFrame, minima: DataFrame, node: str) -> DataFrame:
    """Rows with the minimum of their node.

    The join runs on a derived key, so that both sides are shuffled for it and the adaptive planner may
    split the rows of a node with very many neighbours.
    """
    key: Column = F.struct(F.col(node))
    return rows.withColumn("_key", key).join(minima.select(key.alias("_key"), "least"), "_key").drop("_key")


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour (itself included)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    minima = both.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))
    return _join_minimum(both.where("v > u"), minima, "u").select(F.col("v").alias("a"), F.col("least").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; every edge has ``a > b``."""
    minima = edges.groupBy("a").agg(F.min("b").alias("least"))
    lower = _join_minimum(edges, minima, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return lower.unionByName(minima.select("a", F.col("least").alias("b")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has either one smaller neighbour, without a further one, or larger ones only; edges are distinct with ``a > b``."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").count()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes of the edges ``a, b``; the component is its smallest node.

    Self loops and repeated edges do no harm.  Each round is written to the shared scratch folder, and the rounds
    end as soon as every node is linked with its component alone.
    """
    edges = save_scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    for _ in range(MAX_ROUNDS):
        if _are_stars(edges):
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        edges = save_scratch(small_star(large_star(edges)).distinct(), "component-edges")
    raise RuntimeError("the components did not settle")
