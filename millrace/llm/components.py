"""Connected components by repeated contraction, as joins; nothing gathers a group in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is one node of its component, the same for all.

    Each round every node points to the smallest of itself and its neighbours, pointers are followed twice, and edges are
    rewritten between the nodes pointed to; every round at least halves the nodes that still have edges.
    """
    edges = scratch.save(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges0")
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    k = 0
    while edges.head(1):
        k += 1
        both = edges.select("a", "b").union(edges.select("b", "a"))
        to = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        for _ in range(2):
            up = to.select(F.col("a").alias("p"), F.col("p").alias("q"))
            to = to.join(up, "p").select("a", F.col("q").alias("p"))
        to = scratch.save(to, f"{name}-to{k}")
        moved = to.select(F.col("a").alias("root"), F.col("p"))
        roots = scratch.save(roots.join(moved, "root", "left").select("node", F.coalesce("p", "root").alias("root")), f"{name}-roots{k}")
        one = edges.join(to, "a").select(F.col("p").alias("a"), "b")
        two = one.join(to.select(F.col("a").alias("b"), "p"), "b").select("a", F.col("p").alias("b"))
        edges = scratch.save(two.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges{k}")
    return roots
