import hashlib
import re

from millrace.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    index = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for j in range(len(w) - k + 1) if w else ():
            index.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    sizes = sorted({len(k) for k in index})
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if (x := index.get(tuple(w[j : j + k]))) is not None:
                    hit.update(range(j, j + k))
                    found |= x
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def cases():
    item = " ".join(f"Word{i}" for i in range(25))
    items = [(1, item), (12, "just Three words"), (3, None), (4, " ,; "), (5, item), (7, "été ÉTÉ " + item)]
    docs = [
        (1, "x " + item.replace(" ", ", ") + " y"),
        (2, " ".join(item.split()[3:13])),
        (3, " ".join(item.split()[3:12]) + " other"),
        (4, None),
        (5, ""),
        (6, "so JUST-three/words here"),
        (7, "just three"),
        (8, "words just three words just three words"),
        (9, " ".join(item.split()[:9])),
        (10, " ".join(item.split()[9:])),
        (11, "z" * 3_000_000 + " " + item),
        (12, item.upper()),
    ]
    return docs, items


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, items string, n_hit int")
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, spans string")
    return sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate(d, b, **options).collect())


def test_matches_brute_force(spark):
    docs, items = cases()
    assert run(spark, docs, items) == sorted(brute(docs, items))


def test_blocks_give_the_same(spark):
    docs, items = cases()
    assert run(spark, docs, items, block_bytes=100) == sorted(brute(docs, items))


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_small_table(spark):
    from millrace.llm.decontaminate import op2_decontaminate

    d = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet").select(k, "text").collect() for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = sorted((i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x in brute(docs, items))
    assert sorted(map(tuple, op2_decontaminate(spark, d).collect())) == want


def test_blocks_keep_every_row(spark):
    from millrace.llm.decontaminate import _blocks

    docs, items = cases()
    docs = docs + [docs[0], (1, "no hit"), (1, docs[1][1]), (None, docs[0][1]), (None, "none"), (None, None)]
    items = items + [(1, f"more text{k} of the first item") for k in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **o: sorted((str(r.doc_id), r.n_words, r.n_hit, str(r.spans), str(r["items"])) for r in decontaminate(d, b, **o).collect())
    whole = rows()
    assert len(whole) == len(docs)
    assert rows(block_bytes=300) == whole
    sizes = [sum(len((t or "").encode()) for _, t in block) for block in _blocks(b, 300)]
    assert len(sizes) > 2 and max(sizes) <= 300
