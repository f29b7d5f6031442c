import math
import re
from collections import Counter

import pytest

from millrace.llm.lm_score import MIXTURE, score_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, good, min_docs=2):
    """Exact counts by word, so it also shows that the hashed cells kept these words apart."""
    tokens = [WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t in docs]
    df = Counter(w for t in tokens for w in set(t))
    tokens = [[w if df[w] >= min_docs else None for w in t] for t in tokens]
    size = sum(n >= min_docs for n in df.values()) + 1
    out = []
    models = []
    for part in ([t for (d, _), t in zip(docs, tokens) if d in good], tokens):
        models.append((Counter(w for t in part for w in t), Counter(p for t in part for p in zip(["^"] + t, t)), sum(map(bool, part))))
    for (d, _), t in zip(docs, tokens):
        loss = []
        for words, pairs, n in models:
            total, bits = max(1, sum(words.values())), 0.0
            for a, b in zip(["^"] + t, t):
                c = n if a == "^" else words[a]
                single = words[b] / total
                pair = min(1, pairs[a, b] / c) if c else single
                bits -= math.log2(MIXTURE[0] * pair + MIXTURE[1] * single + MIXTURE[2] / size)
            loss.append(bits / len(t) if t else 0.0)
        out.append((d, len(t), loss[0], loss[1], loss[0] - loss[1]))
    return out


def close(got, want):
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want]
    for g, w in zip(got, want):
        assert g[2:] == pytest.approx(w[2:], abs=1e-4)


def test_matches_brute_force(spark):
    docs = [(1, "The good text is good"), (2, "bad text, bad"), (3, None), (4, ""), (5, "good text; one ÉTÉ été"), (6, "..."), (7, "the " * 50_000), (8, "bad text, bad"), (8, "bad text, bad")]
    labels = [(1, 1, 0), (5, 1, 0), (5, 0, 0), (2, 0, 0), (None, 1, 0), (3, None, 1)]
    d = spark.createDataFrame([(i, t, True) for i, t in docs], "doc_id long, text string, target boolean")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, target int")
    close(sorted(map(tuple, score_documents(d, lab).collect())), sorted(brute(docs, {1, 5})))
    close(sorted(map(tuple, score_documents(d, lab.where("false")).collect())), sorted(brute(docs, set())))
    assert score_documents(d.where("false"), lab).collect() == []


def test_small_table(spark):
    from millrace.llm.lm_score import op6_lm_score

    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").collect()}
    got, want = sorted(map(tuple, op6_lm_score(spark, d).collect())), sorted(brute(docs, good))
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want]
    # a few words share a cell of the hashed tables
    off = sorted(abs(g[4] - w[4]) for g, w in zip(got, want))
    assert off[len(off) // 2] < 0.05 and off[int(len(off) * 0.95)] < 0.5, off[-9:]


def test_counts_stay_exact_with_many_words(spark):
    import random

    deal = random.Random(7)
    rare = [" ".join(f"w{deal.randrange(1 << 40)}" for _ in range(500)) for _ in range(300)]
    docs = [(i, f"{t} common {deal.choice('abcdefgh')} {t.split()[0]}") for i, t in enumerate(rare)] + [(None, "common a b"), (None, "common a b"), (7, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    lab = spark.createDataFrame([(i, 1) for i in range(0, 300, 3)], "doc_id long, quality int")
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 6)))
    want = order(brute(docs, set(range(0, 300, 3))))
    for options in ({}, {"block_bytes": 20_000, "bucket_entries": 500}):
        got = order(map(tuple, score_documents(d, lab, **options).collect()))
        assert [r[:2] for r in got] == [r[:2] for r in want]
        for g, w in zip(got, want):
            assert g[2:] == pytest.approx(w[2:], abs=1e-6)
