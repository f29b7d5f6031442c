import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import forest


def made(seed, n, loop=True):
    r = random.Random(seed)
    parents = {i: (None if i % 17 == 0 else 0 if r.random() < 0.4 else r.randrange(i)) for i in range(n)}
    rows = list(parents.items()) + [(5, 3), (5, 2)]  # several parents: the smallest wins
    if loop:
        rows += [(n, n + 1), (n + 1, n), (n + 2, n)]  # on a cycle and under it
    parents[5] = min(p for p in (parents[5], 3, 2) if p is not None) if parents[5] is not None else None
    return rows, parents


def plain(parents):
    below = {}
    for node, parent in parents.items():
        below.setdefault(parent, []).append(node)
    out, count = {}, 0

    def walk(node, root, level):
        nonlocal count
        enter = count
        count += 1
        for child in sorted(below.get(node, [])):
            walk(child, root, level + 1)
        out[node] = (parents[node], root, level, enter, count - 1)

    for root in sorted(below.get(None, [])):
        walk(root, root, 0)
    return out


@pytest.mark.parametrize("seed,n", [(1, 300), (2, 40)])
def test_labels_subtrees_and_visibility(spark, seed, n, monkeypatch):
    monkeypatch.setattr(forest, "CELL", 8)
    rows, parents = made(seed, n)
    want = plain(parents)
    found = forest.stored(forest.labelled(spark.createDataFrame(rows, "node long, parent long")), "test")
    assert {r.node: (r.parent, r.root, r.level, r.enter, r.leave) for r in found.collect()} == want

    def above(node):
        while (node := parents[node]) is not None:
            yield node

    r = random.Random(seed)
    asked = r.sample(sorted(parents), 12) + [0]
    for depth in (None, 2):
        got = {tuple(x) for x in forest.subtrees(found, spark.createDataFrame([(a,) for a in asked + asked], "node long"), depth).collect()}
        pairs = {(a, node, want[node][2] - want[a][2]) for node in parents for a in {node, *above(node)} if a in asked}
        assert got == {p for p in pairs if depth is None or p[2] <= depth}
    for closed in (r.sample(sorted(parents), 9), [], [0]):
        seen = forest.visible(found, spark.createDataFrame([(c,) for c in closed], "node long"))
        assert {x.node: x.visible for x in seen.collect()} == {node: not set(above(node)) & set(closed) for node in parents}


def test_no_rows_and_no_roots(spark):
    for rows in ([], [(1, 2), (2, 1)]):
        assert forest.labelled(spark.createDataFrame(rows, "node long, parent long")).collect() == []


def test_running_sums_over_ranges(spark):
    r = random.Random(3)
    rows = [(i, r.choice([1, 1, 1, 1, 2, None]), r.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g int, v long")
    got = {x.i: x.s for x in forest.running(df, ["i"], F.col("v"), "s", group="g").collect()}
    for i, g, _ in rows:
        before = [v for j, h, v in rows if j < i and h == g]
        assert got[i] == (sum(before) if before else None)
