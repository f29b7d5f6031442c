import hashlib
import random
import zlib

import duckdb
import pytest

from millrace.llm import manifest
from millrace.llm.manifest import TOP, leaves, merged, op11_manifest, proofs
from millrace.llm.oracles import OP11
from millrace.llm.scratch import Scratch


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """From its definition: (doc_id, leaf, subroot, root, proof, folded root, verified), sorted."""

    def leaf(row):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def steps(tree, i):
        for nodes in tree[:-1]:
            at = i // 3 * 3
            yield nodes[at:i], nodes[i + 1 : at + 3]
            i //= 3

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in of[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, row in enumerate(of[s]):
            way = [*steps(trees[s], i), *steps(top, j)]
            doc, source, lang, n, text = row
            tampered = doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 2 == 0
            fold = leaf((doc, source, lang, n, text.replace("\n", "")) if tampered else row)
            for left, right in way:
                fold = H("".join([*left, fold, *right]))
            out.append((doc, leaf(row), trees[s][-1][0], top[-1][0], H("".join(x for a, b in way for x in a + b)), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, source string, lang string, n_chars long, text string, leaf int")
    return sorted(map(tuple, proofs(leaves(df), Scratch(spark, "test")).collect()), key=repr)


def made(seed, n, sources):
    r = random.Random(seed)
    rows = [(i, r.choice(sources), r.choice(["en", None]), r.choice([None, i]), r.choice([None, "", "a\nb", f"text {i}\n", "ü€\n\U0001f600"])) for i in range(n)]
    return rows + [(None, sources[0], None, None, "x\ny"), (None, None, None, None, None), (7, "once", "en", 1, "a\nb"), (7, "once", "en", 1, "a\nb"), (7, "once", "de", 1, "a\nb")]


@pytest.mark.parametrize("chunk,fan", [(16_384, 8), (1, 2), (4, 3), (7, 2)])
def test_like_the_definition_at_any_size_of_chunks(spark, chunk, fan, monkeypatch):
    monkeypatch.setattr(manifest, "CHUNK", chunk)
    monkeypatch.setattr(manifest, "FAN", fan)
    rows = made(chunk, 150, ["b", "a", "ü", "", "\U0001f600", "￮"])
    assert found(spark, rows) == plain(rows)


def test_one_hot_source_and_many_small_ones(spark, monkeypatch):
    monkeypatch.setattr(manifest, "CHUNK", 100)
    rows = made(1, 700, ["hot"]) + [(1000 + i, f"s{i}", "en", i, "\n" * i) for i in range(300)]
    assert found(spark, rows) == plain(rows)


def test_a_lone_row_and_an_empty_table(spark):
    rows = [(5, "a", "en", 3, "x" * 300_000 + "\n")]
    (got,) = found(spark, rows)
    assert [got] == plain(rows) and got[1] == got[2] == got[3] and got[4] == H("")
    assert found(spark, []) == []


def test_repeated_rows_are_leaves_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(manifest, "CHUNK", 16)
    rows = [(3, "a", "en", 1, "same\n")] * 200 + [(4, "a", "en", 1, "other")]
    assert found(spark, rows) == plain(rows)


def test_merging_is_associative():
    r = random.Random(4)
    widths = {0: 11, 1: 1, 2: 28, TOP: 3}
    nodes = [((t, 0, i), H(f"{t}.{i}")) for t in (0, 1, 2) for i in range(widths[t])]
    whole = merged(dict(nodes), widths)[0]
    for _ in range(50):
        cuts = sorted(r.sample(range(1, len(nodes)), 6))
        parts = [dict(nodes[a:b]) for a, b in zip([0, *cuts], [*cuts, None])]
        parts = [merged(p, widths)[0] for p in parts]
        while len(parts) > 1:
            i = r.randrange(len(parts) - 1)
            parts[i : i + 2] = [merged(parts[i] | parts[i + 1], widths)[0]]
        assert parts[0] == whole and len(whole) == 1


def test_like_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    cursor = c.execute(OP11)
    names = [x[0] for x in cursor.description]
    got = op11_manifest(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.select(names).collect())) == sorted(cursor.fetchall())
    assert 0 < got.where("verified").count() < got.count()
