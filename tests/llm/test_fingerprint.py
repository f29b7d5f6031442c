import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm.fingerprint import SAMPLES, SLOT, edited_and_next, fingerprints, likeness

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def jaccard(a, b):
    a, b = Counter(WORD.findall(a.lower())), Counter(WORD.findall(b.lower()))
    return sum((a & b).values()) / sum((a | b).values())


def edit(rows):
    rows = sorted(rows)
    out = {}
    for k, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        out[d] = (t[: len(t) - n] + nxt[:n], nxt)
    return out


def check(rows, got):
    want = edit(rows)
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)
    texts = dict(rows)
    prints = {}
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(want[r.doc_id][0].encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and len(r.fingerprint) == SLOT * SAMPLES
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for r in got:
        if want[r.doc_id][1] == (texts[r.doc_id] or ""):
            assert r.near_next == 1


def test_small_cases(spark):
    rows = [(5, "alpha beta gamma delta"), (-3, None), (9, ""), (1, "é𝒳ñ one, two; ONE"), (2, "é𝒳ñ one, two; ONE"), (7, " .,"), (10**12, "z " * 40_000)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fingerprint string")
    check(rows, edited_and_next(df).collect())
    assert edited_and_next(df.where("false")).collect() == []
    assert edited_and_next(df.where("doc_id = 5")).first().near_next == 1
    twice = edited_and_next(df.unionByName(df.where("doc_id = 5 OR doc_id = 2"))).collect()
    assert len(twice) == 9 and len({tuple(r) for r in twice}) == 7
    assert edited_and_next(df.withColumn("doc_id", df.doc_id * None)).count() == 7


def test_collision_rate_is_weighted_jaccard(spark):
    rng = np.random.default_rng(5)
    pairs = []
    for k in range(60):
        base = [f"w{x}" for x in rng.zipf(1.3, 800)]
        other = list(base)
        for i in rng.choice(800, int(800 * k / 60), replace=False):
            other[i] = f"v{rng.integers(10**6)}"
        pairs.append((k, " ".join(base), " ".join(other)))
    df = fingerprints(spark.createDataFrame(pairs, "k long, a string, b string"), ["k"], ["a", "b"])
    near = {r.k: r.x for r in df.select("k", likeness(df.a_slots, df.b_slots).alias("x")).collect()}
    off = np.array([near[k] - jaccard(a, b) for k, a, b in pairs])
    assert abs(off.mean()) < 0.03 and np.sqrt((off**2).mean()) < 0.08 and abs(off).max() < 0.25
    assert near[0] == 1


@pytest.mark.parametrize("n,pairs", [(3_000, 60), (60_000, 24)])
@pytest.mark.parametrize("kind", ["few", "zipf"])
def test_long_and_skewed_texts_have_no_bias(spark, n, pairs, kind):
    """Half of one side replaced by rarer words: 64 slots err by some 0.06 a pair, by less than that's share on average."""
    rng = np.random.default_rng(n + len(kind))
    rows = []
    for k in range(pairs):
        base = [f"p{k}w{x}" for x in (rng.integers(0, 41, n) if kind == "few" else rng.zipf(1.4, n))]
        other = list(base)
        for i in rng.choice(n, n // 2, replace=False):
            other[i] = f"v{rng.integers(5000)}"
        rows.append((k, " ".join(base), " ".join(other)))
    df = fingerprints(spark.createDataFrame(rows, "k long, a string, b string").repartition(8), ["k"], ["a", "b"])
    near = {r.k: r.x for r in df.select("k", likeness(df.a_slots, df.b_slots).alias("x")).collect()}
    off = np.array([near[k] - jaccard(a, b) for k, a, b in rows])
    assert abs(off.mean()) < 0.01 + 2 * off.std() / np.sqrt(pairs) and abs(off).max() < 0.25


def test_likeness_of_edited_documents_is_unbiased(spark):
    """Over real documents the likeness is the weighted Jaccard similarity, on average to a hundredth."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    near = {r.doc_id: r.near_edited for r in edited_and_next(docs).collect()}
    off = []
    for k, (d, t) in enumerate(rows):
        cut, after = len(t) // 4, rows[(k + 1) % len(rows)][1]
        off.append(near[d] - jaccard(t, t[: len(t) - cut] + after[:cut]))
    off = np.array(off)
    assert abs(off.mean()) < 0.01 and np.sqrt((off**2).mean()) < 0.07 and abs(off).max() < 0.4


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = edited_and_next(docs).collect()
    check([tuple(r) for r in docs.collect()], got)
    apart = [r for r in got if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in apart]) > 0.85
