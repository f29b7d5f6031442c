"""Nested intervals of a forest: each node has a number on entering and the largest number below it, so that ancestors,
subtrees and what a collapsed node hides are comparisons of numbers, not walks.

Numbers follow the depth-first order, siblings by node. A null parent marks a root, the smallest parent of a node wins, nodes on
a cycle or under no root are left out. Levels are taken one after another, down for the levels, up for the sizes, down for the
numbers; sums over siblings are made by ranges, so that a parent of any number of children is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.stored import stored

#: Numbers of one cell of the range join: what a subtree is dealt out by.
CELL = 1024


def running(rows: DataFrame, order: list[str], value: Column, name: str, of=F.sum, group: str | None = None) -> DataFrame:
    """rows with name: of (F.sum, F.max) of value over all rows of the group before this one in the order; null for the first.

    Rows are dealt by ranges of the order; each range sees its own rows, and only one row for each range and group is seen over
    ranges. order tells rows of a group apart.
    """
    by = ([group] if group else []) + order
    ranged = stored(rows.withColumn("_v", value).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranged")
    keys = [group] if group else []
    parts = ranged.groupBy(*keys, "_part").agg(of("_v").alias("_all"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(k).alias("_g") for k in keys), F.col("_part").alias("_p"), of("_all").over(before).alias("_before"))
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("_own", of("_v").over(own))
    same = F.col("_part") == F.col("_p")
    joined = inner.join(parts, same & F.col(group).eqNullSafe(F.col("_g")) if group else same)
    both = F.array_compact(F.array("_before", "_own"))
    total = F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + x) if of is F.sum else F.array_max(both)
    return joined.withColumn(name, F.when(F.size(both) > 0, total)).select(*rows.columns, name)


def labelled(parents: DataFrame) -> DataFrame:
    """(node, parent, root, level, enter, leave) of a forest given as (node, parent)."""
    one = stored(parents.groupBy("node").agg(F.when(F.count("*") == F.count("parent"), F.min("parent")).alias("parent")), "forest")
    levels = [stored(one.where("parent IS NULL").select("node", "parent", F.col("node").alias("root"), F.lit(0).alias("level")), "level0")]
    while levels[-1].head(1):
        above = levels[-1].select(F.col("node").alias("parent"), "root", "level")
        levels.append(stored(one.where("parent IS NOT NULL").join(above, "parent").select("node", "parent", "root", (F.col("level") + 1).alias("level")), f"level{len(levels)}"))
    levels.pop()
    if not levels:
        return one.select("node", "parent", F.col("node").alias("root"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("enter"), F.lit(0).cast("long").alias("leave")).where("false")
    sized = [None] * len(levels)
    for i in reversed(range(len(levels))):
        if i + 1 == len(levels):
            sized[i] = levels[i].withColumn("size", F.lit(1).cast("long"))
            continue
        below = sized[i + 1].groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("below"))
        sized[i] = stored(levels[i].join(below, "node", "left").withColumn("size", 1 + F.coalesce("below", F.lit(0))).drop("below"), f"size{i}")
    begun = running(sized[0], ["node"], F.col("size"), "before").withColumn("enter", F.coalesce("before", F.lit(0))).drop("before")
    done = [stored(begun, "enter0")]
    for i in range(1, len(levels)):
        above = done[-1].select(F.col("node").alias("parent"), (F.col("enter") + 1).alias("base"))
        within = running(sized[i], ["node"], F.col("size"), "before", group="parent").join(above, "parent")
        done.append(stored(within.withColumn("enter", F.col("base") + F.coalesce("before", F.lit(0))).select(*begun.columns), f"enter{i}"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("node", "parent", "root", "level", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))


def subtrees(forest: DataFrame, asked: DataFrame, depth: int | None = None) -> DataFrame:
    """(top, node, below): every node under each asked one (node; itself included, below 0), down to depth. An interval is cut into
    cells of CELL numbers, so it meets only numbers near its own; it has fewer cells than it holds nodes, or one."""
    tops = forest.join(asked.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("top"), F.col("level").alias("_level"), F.col("enter").alias("_from"), F.col("leave").alias("_to"))
    cell = lambda c: F.floor(F.col(c) / CELL)
    cut = tops.withColumn("_cell", F.explode(F.sequence(cell("_from"), cell("_to"))))
    met = forest.withColumn("_cell", cell("enter")).join(cut, "_cell").where("enter BETWEEN _from AND _to").withColumn("below", F.col("level") - F.col("_level"))
    return (met if depth is None else met.where(F.col("below") <= depth)).select("top", "node", "below")


def visible(forest: DataFrame, collapsed: DataFrame) -> DataFrame:
    """forest with visible: whether no node above is collapsed (node). As intervals nest, a node is hidden exactly if the furthest end
    of the collapsed nodes that were entered before it reaches it."""
    closed = collapsed.select(F.col("node").alias("_closed")).distinct()
    told = forest.join(closed, F.col("node") == F.col("_closed"), "left")
    seen = running(told, ["enter"], F.when(F.col("_closed").isNotNull(), F.col("leave")), "_reach", F.max)
    return seen.withColumn("visible", F.coalesce(F.col("_reach") < F.col("enter"), F.lit(True))).select(*forest.columns, "visible")
