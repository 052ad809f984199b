"""Connected components of an edge table by alternating star contractions.

Large stars hang every greater neighbour of a node on the smallest one around
it, small stars do the same for the node and its smaller neighbours.  Both are
an aggregate with map-side combining and a join.  The aggregate is written
first: joined with an aggregate of its own on the same key, a table keeps that
partitioning, and Spark doesn't split a node with very many neighbours; from two
written tables it does.  Each round is written to the shared checkpoint folder.  The loop ends at the fixed point
only, where every node hangs on the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest
    node of the component.  Loops and repeated edges do no harm; an empty
    table gives an empty one."""
    a, b = F.col("a"), F.col("b")
    edges = materialize(edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                        .distinct(), "edges")
    before = None
    while (now := _digest(edges)) != before:
        before = now
        edges = materialize(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    # (b, m) for every neighbour b of a that is greater than a
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b")).join(least, "a") \
        .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    edges = materialize(edges, "edges")
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
