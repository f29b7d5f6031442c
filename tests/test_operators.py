import random
from collections import deque

from pyspark.sql import functions as F

from millrace.functions.stem import stem
from millrace.operators import answers, graph, joins
from millrace.operators import sequences as S


def test_stems_of_the_paper():
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit vietnamization vietnam predication predic triplicate triplic hopeful hope goodness good revival reviv allowance allow adjustment adjust adoption adopt probate probat rate rate controll control roll roll".split()
    assert [(w, stem(w)) for w in pairs[::2]] == list(zip(pairs[::2], pairs[1::2]))


def test_reach_matches_a_plain_search(spark):
    r = random.Random(1)
    e = {(r.randrange(40), r.randrange(40)) for _ in range(70)}
    df = spark.createDataFrame(list(e), "src long, dst long")
    starts = spark.createDataFrame([(s,) for s in range(5)], "start long")
    got = {(x.start, x.node): x.level for x in graph.reached(starts, df, 4).collect()}
    want = {}
    for s in range(5):
        seen, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for a, b in e:
                if a == u and b not in seen and seen[u] < 4:
                    seen[b] = seen[u] + 1
                    queue.append(b)
        want |= {(s, n): k for n, k in seen.items()}
    assert got == want


def test_cycles_and_forests(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert sorted(r.node for r in graph.cycles(df).collect()) == [1, 2, 3]
    f = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "node string, parent string")
    assert sorted(map(tuple, graph.hierarchy(f).collect())) == [("a", "a", 0, "a"), ("b", "a", 1, "a/b"), ("c", "a", 2, "a/b/c")]


def test_cycles_of_any_length(spark):
    r = random.Random(4)
    ring = [(i, (i + 1) % 30) for i in range(30)]
    e = ring + [(29, 40), (40, 41), (41, 42), (50, 0), (60, 60), (71, 70), (70, 71), (71, 72)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(70)]
    reach = {n: {n for a, n in e if a == m} for m in {x for p in e for x in p} for n in [m]}
    for _ in range(200):
        reach = {m: s | {x for n in s for x in reach[n]} for m, s in reach.items()}
    got = sorted(x.node for x in graph.cycles(spark.createDataFrame(e, "src long, dst long")).collect())
    assert got == sorted(m for m, s in reach.items() if m in s)


def test_nearest_and_near_pairs_match_plain_loops(spark):
    r = random.Random(6)
    left = [(i, r.randrange(4), r.randrange(20) / 2) for i in range(40)]
    right = [(i, r.randrange(3), r.randrange(20) / 2) for i in range(12)]
    a, b = spark.createDataFrame(left, "l long, g long, x double"), spark.createDataFrame(right, "c long, g long, y double")
    want = {}
    for i, g, x in left:
        d = [(abs(x - y), c) for c, h, y in right if h == g]
        best = [c for v, c in d if v == min(d)[0]]
        want[i] = ("NOT_FOUND", None) if not d else ("RESOLVED", best[0]) if len(best) == 1 else ("AMBIGUOUS", None)
    assert {t.l: (t.status, t.c) for t in joins.nearest(a, b, ["g"], "x", "y", "l", "c").collect()} == want
    near = {(t.l_a, t.l_b) for t in joins.pairs_near(a, ["g"], "l", "x", 1.5, []).collect()}
    assert near == {(i, j) for i, g, x in left for j, h, y in left if i < j and g == h and abs(x - y) < 1.5}


def test_nearest_of_a_large_group_is_linear(spark):
    """No frame of the plan ends with its group: such a frame is gone through anew for every row."""
    a = spark.range(60_000).select(F.col("id").alias("l"), F.lit(1).alias("g"), (F.col("id") * 2.0).alias("x"))
    b = spark.range(40).select(F.col("id").alias("c"), F.lit(1).alias("g"), (F.col("id") * 3000.0 + 1).alias("y"))
    found = joins.nearest(a, b, ["g"], "x", "y", "l", "c")
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    want = {"RESOLVED": 0, "AMBIGUOUS": 0}
    for i in range(60_000):
        d = sorted(abs(2 * i - (3000 * c + 1)) for c in range(40))
        want["RESOLVED" if d[0] < d[1] else "AMBIGUOUS"] += 1
    assert {r.status: r["count"] for r in found.groupBy("status").count().collect()} == {k: v for k, v in want.items() if v}


def test_numbered_is_one_order(spark):
    r = random.Random(9)
    rows = [(i, r.randrange(9)) for i in range(500)]
    got = {t.i: t.place for t in S.numbered(spark.createDataFrame(rows, "i long, v long"), ["v", "i"], "place").collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((v, i) for i, v in rows), 1)}


def test_asof_without_a_match(spark):
    left = spark.createDataFrame([(1, 5, "p"), (1, 1, "q"), (2, 9, "r")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 2, "x"), (1, 5, "y")], "k int, s int, w string")
    assert sorted((r.v, r.w) for r in joins.asof(left, right, ["k"], "t", "s", ["w"]).collect()) == [("p", "y"), ("q", None), ("r", None)]


def test_longest_increasing(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([3, 1, 2, 9, 4, 5])], "k long, i long, v long")
    assert [r.v for r in S.longest_increasing(df, "k", "i", "v").orderBy("i").collect()] == [1, 2, 4, 5]


def plain_longest(values):
    best = [1] * len(values)
    for i, v in enumerate(values):
        best[i] = max([best[j] + 1 for j in range(i) if values[j] < v], default=1)
    return max(best, default=0)


def test_longest_increasing_of_very_many_groups(spark):
    """One fold over sorted rows, not a call for each group; batches cut groups at any place."""
    r = random.Random(4)
    groups = {f"g{k}": [(i, r.choice([None, *range(9)])) for i in range(r.randint(1, 12))] for k in range(300)}
    groups["long"] = [(i, r.randrange(1000)) for i in range(400)]
    rows = [(g, i, v) for g, x in groups.items() for i, v in x]
    r.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {}
        for t in sorted(S.longest_increasing(spark.createDataFrame(rows, "g string, i long, v long"), "g", "i", "v").collect(), key=lambda t: t.i):
            got.setdefault(t.g, []).append((t.i, t.v))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g, x in groups.items():
        kept = got.get(g, [])
        assert len(kept) == plain_longest([v for _, v in x if v is not None]) and set(kept) <= set(x)
        assert all(a[1] < b[1] for a, b in zip(kept, kept[1:]))
    plan = S.longest_increasing(spark.createDataFrame(rows, "g string, i long, v long"), "g", "i", "v")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapGroups" not in plan


def test_longest_increasing_takes_equal_places_by_value(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 1, 3.0), (1, 2, 4.0), (1, 2, 6.0), (2, 1, 8.0), (2, 1, 7.0)], "k long, i long, v double")
    assert sorted((r.i, r.v) for r in S.longest_increasing(df, "k", "i", "v").where("k = 1").collect()) == [(1, 3.0), (2, 4.0), (2, 6.0)]
    assert sorted(r.v for r in S.longest_increasing(df, "k", "i", "v").where("k = 2").collect()) == [7.0, 8.0]


def plain_passages(text, soft=700, hard=1100, tail=200):
    out, now = [], None
    for line in text.split("\n"):
        if line.strip() == "":
            continue
        if now is not None and (len(now) >= soft or len(now) + len(line) > hard):
            out.append(now)
            now = None
        now = line if now is None else now + "\n" + line
        while len(now) > 2 * hard:
            out.append(now[:hard])
            now = now[hard:]
    if now is not None and out and len(now) < tail:
        out[-1] += "\n" + now
    elif now is not None:
        out.append(now)
    return out or [text]


def test_passages_match_a_plain_loop(spark):
    r = random.Random(2)
    texts = ["\n".join(r.choice("xyz") * r.choice([0, 3, 50, 400, 1500, 2500, 7000]) for _ in range(r.randint(0, 12))) for _ in range(60)] + ["", "short", "\n \n"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "doc_id long, text string")
    got = {}
    for x in sorted(S.passages(df).collect(), key=lambda x: x.k):
        got.setdefault(x.doc_id, []).append(x.text)
    assert got == {k: plain_passages(t) for k, t in enumerate(texts)} | {-1: [""]}


def test_clusters_match_a_plain_loop(spark):
    r = random.Random(3)
    rows = [(k % 5, float(r.randrange(60))) for k in range(200)]
    got = sorted((x.g, x.v, x.cluster) for x in answers.clusters(spark.createDataFrame(rows, "g long, v double"), "g", "v", 3.0).collect())
    want = []
    for g in range(5):
        anchors = []
        for v in sorted(v for h, v in rows if h == g):
            if not anchors or v - anchors[-1] > 3:
                anchors.append(v)
            want.append((g, v, len(anchors)))
    assert got == sorted(want)


def test_dialogue_carries_the_focus(spark):
    turns = [(1, 0, "user", "What is the gap limit here?"), (1, 1, "assistant", "Six."), (1, 2, "user", "and for curves then"), (1, 3, "user", "why"), (1, 4, "user", "Tell me about welds now"), (2, 0, "user", "hi"), (3, 0, "assistant", "x")]
    got = sorted((x.conv_id, x.turn, x.query, x.joined) for x in answers.dialogue(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect())
    assert got == [(1, 0, "What is the gap limit here?", False), (1, 2, "What is the gap limit here? and for curves then", True), (1, 3, "What is the gap limit here? why", True), (1, 4, "Tell me about welds now", False), (2, 0, "hi", False)]


def test_located_words(spark):
    item = "one two three four five six seven eight nine ten"
    pairs = [(1, 1, item, "zero " + item), (1, 2, item, "one two. " + item.replace("nine", "9th")), (1, 3, item, "nothing"), (1, 4, item, "say one only"), (1, 5, "", item)]
    got = {x.doc_id: (x.start, x.ratio) for x in answers.located(spark.createDataFrame(pairs, "item_id long, doc_id long, item string, body string")).collect()}
    assert got == {1: (5, 1.0), 2: (9, 0.9), 3: (-1, None), 4: (4, None), 5: (-1, None)}


def test_row_clusters_reads_every_order(spark):
    from millrace.registry import QUERIES, load

    load()

    d = "/root/testdata/sf0.001"
    got = {r[0] for r in QUERIES["row_clusters"](spark, d).select("l_orderkey").distinct().collect()}
    assert got == {r[0] for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey").distinct().collect()}
