import hashlib
import random

import numpy as np

from millrace.llm.suffix_dedup import Family, _scanned, _suffix_array, dedup_bytes, smallest_documents


def brute(rows, window=50):
    seen = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            k = b[i : i + window]
            seen[k] = min(d, seen.get(k, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        cut = bytearray(len(b) + 1)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] < d:
                cut[i : i + window] = b"\1" * window
        kept = bytes(x for x, c in zip(b, cut) if not c)
        spans = sum(cut[i] and not (i and cut[i - 1]) for i in range(len(b)))
        out.append((d, len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def cases():
    r = random.Random(8)
    piece = lambda n: "".join(r.choice("ab é\0ñ") for _ in range(n))
    passage = [piece(n) for n in (48, 50, 52, 90, 400)]
    rows = [(1, None), (2, ""), (3, "a" * 49), (4, "a" * 200), (5, "a" * 120), (6, "xy" * 20_000)]
    for d in range(7, 60):
        t = ""
        for _ in range(r.randint(0, 4)):
            p = r.choice(passage)
            s = r.randint(0, 30)
            t += piece(r.randint(0, 40)) + p[s : s + r.randint(30, 400)]
        rows.append((r.randint(0, 10**9) * 100 + d, t))
    return rows + [(d + 1, t) for d, t in rows[10:20]] + [rows[12]]


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, ranges int")
    return sorted(tuple(r)[:5] + (bytes(r.kept),) for r in dedup_bytes(df, **options).collect())


def test_matches_brute_force(spark):
    rows = cases()
    assert run(spark, rows) == sorted(brute(rows))
    assert run(spark, rows, window=12, gram=3, block=300, batch=40) == sorted(brute(rows, 12))
    assert run(spark, []) == []


def test_levels_find_the_smallest():
    r = np.random.default_rng(2)
    for _ in range(30):
        size = r.integers(6, 40, 19)
        text = r.integers(0, 2, size.sum()).astype(np.uint8)
        low = r.permutation(19)
        got = smallest_documents(text, size, size - 5, low, None, 6, 20)
        parts = np.split(text, np.cumsum(size)[:-1])
        windows = [(p[i : i + 6].tobytes(), x) for p, x in zip(parts, low) for i in range(len(p) - 5)]
        best = {}
        for w, x in windows:
            best[w] = min(x, best.get(w, x))
        assert got.tolist() == [best[w] for w, _ in windows]


def test_small_table(spark):
    from millrace.llm.suffix_dedup import op4_suffix_dedup

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op4_suffix_dedup(spark, d).collect())) == sorted(r[:5] for r in brute(rows))


def test_scan_gives_longest_matches_and_levels_merge():
    r = np.random.default_rng(4)
    rows = [np.frombuffer(r.integers(97, 99, 40, dtype=np.uint8).tobytes(), np.uint8) for _ in range(4)]
    keys = [np.array([x[i : i + 6].tobytes() for i in range(35)], "S6") for x in rows]
    levels = [_suffix_array(np.arange(35), k, np.full(35, d)) for d, k in enumerate(keys)]
    length, low = _scanned(levels[0], levels[1])
    common = lambda a, b: next((i for i in range(6) if a[i] != b[i]), 6)
    for w, m, d in zip(levels[1].keys, length, low, strict=True):
        assert m == max(common(w, v) for v in keys[0].tolist()) and (d == 0) == (m == 6)
    family = Family()
    for level in levels:
        family.add(level)
    one, = family.levels
    assert one.batches == 4 and one.keys.tolist() == sorted({x for k in keys for x in k.tolist()})
    assert one.shared[1:].tolist() == [common(a, b) for a, b in zip(one.keys[1:].tolist(), one.keys[:-1].tolist(), strict=True)]
