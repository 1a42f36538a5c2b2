"""Connected components of an edge table by alternating star contraction, with every step distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import checkpoint


def _stars(edges: DataFrame, *, large: bool) -> DataFrame:
    """One contraction. Large: every node's greater neighbours join its least one. Small: a node and its lesser ones do.

    The least neighbour is found by an aggregation (combined before the shuffle), and joined back, so that a node
    with very many neighbours is never gathered in one task.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        found = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        found = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return found.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; edges are (u, v), whose order means nothing; root is the least node."""
    now = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            break
        mark = tuple(state)
        now = checkpoint(_stars(_stars(now, large=True), large=False))
    # Stable: every node points at the least of its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
