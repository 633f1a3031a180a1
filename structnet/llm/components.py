"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structnet.llm.common import written_rows


def _linked(edges: DataFrame) -> DataFrame:
    """Every node with its smallest neighbour or itself; a hot node is pre-aggregated in every task."""
    return edges.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are tied to the smallest one it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_linked(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Takes edges with a > b."""
    low = _linked(edges)
    tied = edges.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return tied.union(low.select("a", F.col("low").alias("b"))).distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node is tied to one smaller node that is tied to none. Takes distinct edges with a > b."""
    ends = edges.select("a", F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    return ends.groupBy("a").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 1 OR ups = 1 AND n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``, component being the smallest node that is reachable.

    Nodes without an edge are not listed; loops are ignored. Every round is written to the checkpoint folder; there is none once all edges
    lead to the smallest node of a component. The joins are between edges and one row per node, so that adaptive execution may split a hot node's edges.
    """
    edges = written_rows(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_forest(edges):
        edges = written_rows(_small_star(_large_star(edges)))
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
