"""Graph operators over edge tables (src, dst, ...): frontiers written level by level, never a graph in one process."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.stored import stored


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in): distinct neighbours in either direction."""
    out = edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n_out")).withColumnRenamed("src", "node")
    into = edges.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n_in")).withColumnRenamed("dst", "node")
    zero = F.lit(0).cast("long")
    return out.join(into, "node", "full").select("node", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"))


def reached(starts: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, level, parent): every node within ``depth`` steps (None: any number), at its smallest level; parent is the
    smallest node that reaches it there (null at level 0). Each step joins the last frontier only, which is written once,
    and keeps nodes not seen before."""
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    front = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("level"), F.lit(None).cast(starts.schema["start"].dataType).alias("parent")).distinct()
    seen = front = stored(front, "level0")
    level = 0
    while level != depth and front.head(1):
        level += 1
        step = front.select("start", F.col("node").alias("src")).join(edges, "src").groupBy("start", "dst").agg(F.min("src").alias("parent"))
        step = step.withColumnRenamed("dst", "node").join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = stored(step.select("start", "node", F.lit(level).alias("level"), "parent"), f"level{level}")
        seen = seen.unionByName(front)
    return seen


def hierarchy(parents: DataFrame) -> DataFrame:
    """(node, root, level, path) of a forest given as (node, parent), where a null parent marks a root and the first (smallest)
    parent of a node wins. Levels are taken one after another, each written once. Nodes on a cycle are under no root and
    are left out."""
    one = stored(parents.groupBy("node").agg(F.when(F.count("*") == F.count("parent"), F.min("parent")).alias("parent")), "forest")
    front = one.where("parent IS NULL").select("node", F.col("node").alias("root"), F.lit(0).alias("level"), F.col("node").cast("string").alias("path"))
    tree = front = stored(front, "level0")
    while front.head(1):
        above = front.select(F.col("node").alias("parent"), "root", "level", "path")
        below = one.join(above, "parent").select("node", "root", (F.col("level") + 1).alias("level"), F.concat_ws("/", "path", F.col("node").cast("string")).alias("path"))
        front = stored(below, "level")
        tree = tree.unionByName(front)
    return tree


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without those that no cycle can use, as nothing leads to their source or away from their target."""
    edges = stored(edges, "edges")
    n = edges.count()
    while n:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        edges = stored(kept.select("src", "dst"), "edges")
        n, before = edges.count(), n
        if n == before:
            break
    return edges


def cycles(edges: DataFrame) -> DataFrame:
    """(node) of every node that reaches itself, by cycles of any length: the strongly connected components of two nodes and
    more, and nodes with an edge to themselves. Every node takes the largest node that reaches it as its colour; what
    reaches a colour's largest node inside the colour is its component; the rest goes on. Each round is a join whose result
    is written once, and rounds grow with the length of paths, not with the number of nodes."""
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    found = edges.where("src = dst").select(F.col("src").alias("node"))
    edges = _trimmed(edges.where("src != dst"))
    while edges.head(1):
        colour = stored(_ends(edges).withColumn("colour", F.col("node")).withColumn("moved", F.lit(True)), "colour")
        while colour.where("moved").head(1):
            up = colour.where("moved").join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.max("colour").alias("up"))
            new = colour.drop("moved").join(up, F.col("node") == F.col("dst"), "left")
            colour = stored(new.select("node", F.greatest("colour", F.coalesce("up", "colour")).alias("colour"), F.coalesce(F.col("up") > F.col("colour"), F.lit(False)).alias("moved")), "colour")
        own = colour.select("node", "colour")
        inner = edges.join(own.toDF("src", "colour"), "src").join(own.toDF("dst", "other"), "dst").where("colour = other").select("src", "dst")
        inner = stored(inner, "inner")
        members = front = own.where("node = colour").select("node")
        while front.head(1):
            back = inner.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
            front = stored(back.join(members, "node", "left_anti"), "front")
            members = members.unionByName(front)
        coloured = stored(members.join(own, "node"), "members")
        several = coloured.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(coloured.join(several, "colour", "left_semi").select("node"))
        rest = inner.join(coloured.select(F.col("node").alias("src")), "src", "left_anti").join(coloured.select(F.col("node").alias("dst")), "dst", "left_anti")
        edges = _trimmed(rest)
    return found.distinct()


def similar_nodes(features: DataFrame, edges: DataFrame, k: int, asked: DataFrame, boost: float = 0.3, least: float = 0.05) -> DataFrame:
    """(a, b, score, rank): the k nodes most similar to each asked one, by Jaccard of their features plus ``boost`` where linked, at
    most 1. features: (node, feature); asked: (node). Only nodes that share a feature meet."""
    f = features.distinct()
    size = f.groupBy("node").agg(F.count("*").alias("n"))
    own = f.join(asked.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("a"), "feature")
    both = own.join(f.select(F.col("node").alias("b"), "feature"), "feature").where("a != b").groupBy("a", "b").agg(F.count("*").alias("common"))
    for x in "ab":
        both = both.join(size.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}")), x)
    link = undirected(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(boost).alias("link"))
    s = both.join(link, ["a", "b"], "left").withColumn("score", F.round(F.least(F.lit(1.0), F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common")) + F.coalesce("link", F.lit(0.0))), 6))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return s.where(F.col("score") > least).withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b", "score", "rank")


def upsert(nodes: DataFrame, edges: DataFrame, kept: tuple[str, ...] = ("src", "dst", "rel")) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, seq, ...) with the first of each id; edges (src, dst, rel, seq) with the first of each key, both ends present."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    n = nodes.withColumn("__k", first).where("__k = 1").drop("__k")
    e = edges.withColumn("__k", F.row_number().over(Window.partitionBy(*kept).orderBy("seq"))).where("__k = 1").drop("__k")
    for end in ("src", "dst"):
        e = e.join(n.select(F.col("id").alias(end)), end, "left_semi")
    return n, e
