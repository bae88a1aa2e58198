"""Connected components as joins and groupings, with nothing about the graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in the edges (a, b); the component is its smallest id.

    Large-star and small-star steps by turns: every node hands its neighbours on to the
    smallest of them, until all edges are from a node to the smallest of its component.
    The number of turns grows with the logarithm of the size of a component. Minima are
    aggregated before the shuffle, and a node with very many edges is the big side of a
    plain join, which adaptive execution splits.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = staged(edges, "edges"), None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        handed = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(handed.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) after more edges (a, b), which join components that are known; only those are gone through again."""
    of = {c: labels.select(F.col("id").alias(c), F.col("component").alias(f"to_{c}")) for c in "ab"}
    raised = edges.join(of["a"], "a", "left").join(of["b"], "b", "left")
    tops = components(raised.select(*[F.coalesce(f"to_{c}", c).alias(c) for c in "ab"]))
    moved = labels.join(tops.toDF("component", "top"), "component", "left")
    moved = moved.select("id", F.coalesce("top", "component").alias("component"))
    return moved.unionByName(tops.join(labels, "id", "left_anti"))
