import hashlib
import random

import numpy as np

from millrace.llm.substring_dedup import FMIndex, dedup_words, smallest_documents


def brute(rows, window=50):
    seen = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = min(d, seen.get(k, d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        cut = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] < d:
                cut.update(range(i, i + window))
        out.append((d, len(w), len(cut), b" ".join(x for i, x in enumerate(w) if i not in cut).decode()))
    return out


def cases():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    passage = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 300)]
    rows = [(1, None), (2, ""), (3, "a " * 49), (4, "a\n" * 200), (5, "a\t" * 120), (6, "x " * 30_000)]
    for d in range(7, 60):
        w = []
        for _ in range(r.randint(0, 4)):
            w += [word() for _ in range(r.randint(0, 40))]
            p = r.choice(passage)
            s = r.randint(0, 30)
            w += p[s : s + r.randint(30, 300)]
        rows.append((r.randint(0, 10**9) * 100 + d, " ".join(w[:1]) + " " + " \v".join(w[1:]) + "  "))
    rows += [(d + 1, t) for d, t in rows[10:20]] + [rows[12]]
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, rk int")
    return sorted(map(tuple, dedup_words(df, **options).collect()))


def test_matches_brute_force(spark):
    rows = cases()
    assert run(spark, rows) == sorted(brute(rows))
    assert run(spark, rows, window=12, gram=3, block=300) == sorted(brute(rows, 12))
    assert run(spark, []) == []


def test_index_finds_the_smallest(spark):
    r = np.random.default_rng(2)
    for _ in range(30):
        size = r.integers(6, 40, 9)
        text = r.integers(0, 3, size.sum()).astype(np.uint32)
        low = r.permutation(9)
        got = smallest_documents(text, size, size - 5, low, np.zeros(9), 6)
        parts = np.split(text, np.cumsum(size)[:-1])
        windows = [(tuple(p[i : i + 6]), x) for p, x in zip(parts, low) for i in range(len(p) - 5)]
        assert got.tolist() == [min(x for w, x in windows if w == v) for v, _ in windows]


def test_small_table(spark):
    from millrace.llm.substring_dedup import op5_substring_dedup

    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((a, b, c, hashlib.sha256(k.encode()).hexdigest()) for a, b, c, k in brute(rows))
    assert sorted(map(tuple, op5_substring_dedup(spark, d).collect())) == want


def naive_statistics(parts, text, depth):
    out = []
    for i in range(len(text)):
        m = 0
        while m < min(depth, len(text) - i) and any(p[j : j + m + 1] == text[i : i + m + 1] for p in parts for j in range(len(p) - m)):
            m += 1
        out.append(m)
    return out


def test_matching_statistics():
    r = random.Random(5)
    for _ in range(60):
        parts = [[r.randint(1, 3) for _ in range(r.randint(1, 14))] for _ in range(r.randint(1, 4))]
        whole = np.array([x for p in parts for x in (*p, 0)])
        value = np.repeat(np.arange(10, 10 + len(parts)), [len(p) + 1 for p in parts])
        depth = r.randint(2, 6)
        index = FMIndex(whole, value, depth)
        texts = [[r.choice([1, 2, 3, 3, 0]) for _ in range(r.randint(1, 15))] for _ in range(3)]
        here = [[x if any(x in p for p in parts) else 0 for x in t] for t in texts]
        length, low = index.stream(np.array([x for t in here for x in t]), np.array([len(t) for t in here]))
        assert length.tolist() == [m for t in here for m in naive_statistics(parts, t, depth)]
        at = 0
        for t in here:
            for i in range(len(t)):
                if length[at] == depth:
                    assert low[at] == min(10 + k for k, p in enumerate(parts) if any(p[j : j + depth] == t[i : i + depth] for j in range(len(p))))
                at += 1


def test_results_come_from_the_index(monkeypatch):
    """Two segments of one anchor whose windows differ: an index that accepts every step would call them equal."""
    size, text = np.array([60, 60]), np.concatenate([np.arange(60), np.arange(60) + 1])
    text[60 + 30] = 5
    args = text, size, size - 49, np.array([1, 2]), np.zeros(2)
    assert smallest_documents(*args).tolist() == [1] * 11 + [2] * 11
    monkeypatch.setattr(FMIndex, "step", lambda self, symbol, low, high: (low, high))
    assert smallest_documents(*args).tolist() != [1] * 11 + [2] * 11
