import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from millrace.llm import quality_rules as q
from millrace.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"


def base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), n_lines."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    hit = {p for i, w in enumerate(windows) if counts[w] > 1 for p in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)), len(lines)


def vector(counts, lines):
    n = counts[0] + 50
    return [round(1000 * v) for v in (np.log((counts[1] + 250) / n), (counts[2] / n) ** 0.5, (counts[3] / (lines + 5)) ** 0.5, (counts[4] / n) ** 0.5)]


def plain(rows):
    """kept of each (lang, source, text), with numpy on whole groups."""
    told = [base(t) for *_, t in rows]
    failed = [c[0] < 10 or 100 * c[4] > 20 * c[0] for c, _ in told]
    xs = np.array([vector(*x) for x in told], dtype=float)
    keys = [[(0, la, so), (1, la), (2,)] for la, so, _ in rows]
    floor = np.diag(np.array(q.FLOORS) ** 2)

    def far(x, mean, cov):
        d = x / 1000 - mean
        return np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov + floor), d)

    shapes = {}
    for key in {k for ks, f in zip(keys, failed) if not f for k in ks}:
        x = np.array([v for v, ks, f in zip(xs, keys, failed) if not f and key in ks])
        mean = np.median(x, axis=0)
        cov = np.diag((1.4826 / 1000 * np.median(np.abs(x - mean), axis=0)) ** 2)
        mean, old = mean / 1000, None
        for _ in range(q.STEPS):
            rank = np.floor(100 * np.log1p(far(x, mean, cov)) + 0.5)
            core = x[rank <= np.percentile(rank, 100 * q.CORE)]
            mean, cov = core.mean(0) / 1000, q.CONSISTENCY * np.cov(core.T, bias=True) / 1e6
            if old is not None and np.array_equal(core, old):
                break
            old = core
        shapes[key] = (len(x), mean, cov)
    out = []
    for x, ks, f in zip(xs, keys, failed):
        if f:
            out.append((True, None, False))
            continue
        own, wide = (shapes[k][0] / (shapes[k][0] + q.LEAN) for k in ks[:2])
        w = [own, (1 - own) * wide, (1 - own) * (1 - wide)]
        mean = sum(a * shapes[k][1] for a, k in zip(w, ks))
        cov = sum(a * (shapes[k][2] + np.outer(shapes[k][1] - mean, shapes[k][1] - mean)) for a, k in zip(w, ks))
        d = far(x[None], mean, cov)[0]
        out.append((False, d, bool(d <= q.CUT)))
    return [c for c, _ in told], out


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n_words string")


def compared(spark, rows):
    got = sorted(q.judged(frame(spark, rows), Scratch(spark, "test")).collect(), key=lambda r: r.doc_id)
    counts, verdicts = plain(rows)
    assert [tuple(r[c] for c in q.COUNTS) for r in got] == counts
    assert [r.base_failed for r in got] == [v[0] for v in verdicts]
    for r, (_, far, kept) in zip(got, verdicts, strict=True):
        assert r.distance == (None if far is None else pytest.approx(far, rel=1e-6, abs=1e-9)), r
        assert r.kept == kept or abs(far - q.CUT) < 1e-6
    return got


def test_like_numpy_on_documents(spark):
    rows = duckdb.sql(f"SELECT lang, source, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    got = compared(spark, rows)
    assert 0 < sum(not r.kept and not r.base_failed for r in got) < 0.3 * len(got)


def test_odd_rows(spark):
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(["alpha", "be", "gamma,", "delta", "epsilon", "of"]) + str(r.randrange(50)) for _ in range(n))
    rows = [(r.choice(["en", "de", None]), r.choice(["a", None, '"]', "b"]), text(r.randint(0, 80))) for _ in range(120)]
    rows += [("en", "a", t) for t in (None, "", " \n\t", "word", "a b c d e " * 300, "x" * 100_000, "\n".join(["same line of words here"] * 40), "%%% ### $$$ " * 30, text(60_000), "ü € \U0001f600 " * 3)]
    rows += [("xx", "alone", text(40))] + [("en", "copies", "one and the same text of ten words or a few more")] * 200
    compared(spark, rows)


def test_empty_table(spark):
    assert q.judged(frame(spark, []), Scratch(spark, "test")).collect() == []


def test_clean_keeps_all_columns(spark):
    rows = duckdb.sql(f"SELECT lang, source, text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 300").fetchall()
    df = frame(spark, rows)
    kept = {r.doc_id for r in q.judged(df, Scratch(spark, "test")).where("kept").collect()}
    got = q.clean(df, Scratch(spark, "test"))
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == kept


def test_labelled_documents(spark):
    """Of documents that keep the base rules nearly all labelled good are kept, nearly all labelled bad go."""
    sf = "/root/testdata/sf0.1"
    told = q.op12_quality_rules(spark, sf).where("NOT base_failed").select("doc_id", "kept").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    share = {r.quality: r.share for r in told.groupBy("quality").agg(q.F.avg(q.F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.99 and share[0] < 0.1
