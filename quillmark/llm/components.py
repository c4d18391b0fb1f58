"""Connected components by contraction: every step is a join or an aggregate over edges, none over a whole component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of `edges` (a, b); the label is the component's smallest node.

    In each round every node points at its smallest neighbour, pointers are followed once more, and the edges are
    contracted along them, until none is left.  A hub of any degree is one row of the pointers, and the edges that meet in
    it are summed up before they are exchanged or joined to it in parts.
    """
    left = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "pointers")
        far = near.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        jump = materialize(near.join(far, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "jumps")
        if labels is None:
            labels = jump.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            step = jump.select(F.col("a").alias("label"), "p")
            labels = materialize(labels.join(step, "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        to_a, to_b = jump.select("a", F.col("p").alias("pa")), jump.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = left.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        left = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
