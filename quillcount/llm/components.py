"""Connected components by contraction; neither edges nor labels ever reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def _flatten(parent: DataFrame) -> DataFrame:
    """Pointers (v, p) followed to their ends, by doubling."""
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
        hop = staged(parent.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "hop")
        parent = hop.select("v", "p")
        if hop.filter("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(v, p): every vertex of ``edges`` (a, b) that isn't the smallest of its component, with that smallest.

    Each round points a vertex at its smallest neighbour, follows the pointers, renames the edges' ends and
    drops the edges inside a component. Degrees are only ever reduced by min(), which combines before the
    shuffle, so a hub costs no more than any other vertex. No edges: an empty result.
    """
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        parent = _flatten(staged(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")), "parent"))
        ends = [parent.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a", "left").select(F.coalesce("pa", "a").alias("a"), "b")
        moved = moved.join(ends[1], "b", "left").select("a", F.coalesce("pb", "b").alias("b"))
        edges = staged(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            labels = staged(labels.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p")).unionByName(parent), "labels")
    return labels if labels is not None else edges.select(F.col("b").alias("v"), F.col("a").alias("p"))
