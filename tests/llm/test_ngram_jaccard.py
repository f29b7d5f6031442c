import random

import pytest

from millrace.llm import ngram_jaccard
from millrace.llm.ngram_jaccard import similar_components


def sets(text):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, x in enumerate(s):
        for g in x:
            holders.setdefault(g, []).append(i)
    links = [0] * len(rows)
    for i, x in enumerate(s):
        for j in {j for g in x for j in holders[g] if j > i}:
            both = len(x & s[j])
            if 100 * both >= 80 * (len(x) + len(s[j]) - both):
                root[find(j)] = find(i)
                links[i] += 1
                links[j] += 1
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(s[i]), low[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, sig int")
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in similar_components(df, **options).collect())


def cases():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    common = [word() for _ in range(14)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "a b c d e"), (7, "a b c d e f g h i"), (8, "a b c d e f g h i j"), (9, "z " * 20_000), (10, "x " * 9)]
    for g in range(30):
        base = common[: r.randint(0, 14)] + [word() for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                base = w
            rows.append((len(rows) * 7 + r.randint(0, 6) + 20, " ".join(w)))
    r.shuffle(rows)
    return rows + rows[:5]


@pytest.mark.parametrize("hubs", [True, False])
def test_matches_brute_force(spark, hubs):
    rows = cases()
    assert run(spark, rows, hubs=hubs) == brute(rows)


def crowd(n=150):
    """Many near copies of one text, each with edits of its own."""
    r = random.Random(8)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 40)}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [1024, 40])
def test_crowd_is_answered_from_its_hub(spark, monkeypatch, block):
    """All links of a large group come from differences to hubs, in one block and in several; nearly none from lists."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK_ROWS", block)
    rows = crowd()
    assert run(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    join = ngram_jaccard._Join(df, 5, 80, True)
    assert join.members.groupBy("hub").count().agg({"count": "max"}).head()[0] > 100
    assert join._outside().count() < join._inside(True).count() / 10


def test_pairs_are_the_links(spark):
    rows = cases() + [(10_000 + d, t) for d, t in crowd(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {frozenset((r.a, r.b)) for r in ngram_jaccard.similar_sets(df).collect()}
    ids = {r.row_key: r.set_id for r in similar_components(df).collect()}
    keys = {r.text: ids[r.k] for r in df.select("text", ngram_jaccard.row_key().alias("k")).collect()}
    by_set = {s: keys[t] for _, t in rows if (s := sets(t))}
    want = set()
    every = list(by_set)
    for i, x in enumerate(every):
        for y in every[:i]:
            both = len(x & y)
            if both and 100 * both >= 80 * (len(x) + len(y) - both):
                want.add(frozenset((by_set[x], by_set[y])))
    assert found == want


def test_no_documents(spark):
    assert run(spark, []) == []


def test_chain_without_a_common_leader(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[4 * k : 4 * k + 100])) for k in range(60)]
    assert run(spark, rows) == brute(rows)
    assert {c for _, _, c, _ in run(spark, rows)} == {41}


def test_small_table(spark):
    from millrace.llm.ngram_jaccard import op1_ngram_jaccard

    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op1_ngram_jaccard(spark, d).collect())) == brute(rows)
