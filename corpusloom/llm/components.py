"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) between 64-bit numbers -> (node, root), root being the same within a component.

    Each round every node moves to the smallest number among itself and its neighbours, and edges move
    with their ends; numbers are hashes, so rounds grow with the logarithm of the nodes. All in tables
    in the shared folder: nothing is collected but one count a round."""
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    roots = None
    while True:
        both = e.union(e.select("b", "a").toDF("a", "b"))
        moved = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "cc-moves")
        if roots is None:
            new = moved.select("node", F.col("to").alias("root"))
        else:
            new = roots.join(moved.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        new = written(new, "cc-roots")
        if roots is not None:
            drop_written(roots)
        roots = new
        left = moved.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = moved.select(F.col("node").alias("b"), F.col("to").alias("y"))
        nxt = written(e.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        drop_written(e)
        drop_written(moved)
        e = nxt
        if e.isEmpty():
            return roots
