import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import textbuf as tb
from millrace.llm import toxicity as T


def naive(model, text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    ids, _ = T.features(data, np.array([0, len(data)]), model.config.bits)
    words = model.embed[ids].sum(1)
    hidden = []
    for k, width in enumerate(T.WIDTHS):
        best = np.full(model.config.filters, -1e9)
        for i in range(len(words) - width + 1):
            best = np.maximum(best, sum(words[i + j] @ model.conv[k][j] for j in range(width)))
        hidden.append(best)
    return float(np.maximum(np.concatenate(hidden) + model.bias, 0) @ model.out + model.out_bias[0])


def test_chunks_score_as_one_text_at_a_time(monkeypatch):
    monkeypatch.setattr(T, "BLOCK_WORDS", 7)
    texts = ["", None, "one", "one two", "bad worse worst " * 20, "x", "", "so it goes on and on " * 9]
    model = T.fit(["bad worse worst", "so it goes"] * 5, np.array([1, 0] * 5), T.Config(bits=6, epochs=2))
    assert np.allclose(T.raw_scores(model, texts), [naive(model, t) for t in texts], atol=1e-4)


def test_learns_and_ignores_other_columns(spark):
    rows = [(i, "you rotten fool" if i % 5 == 0 else f"plain words number {i}", 1 if i % 5 == 0 else 0) for i in range(400)] + [(500, None, 0), (501, "", 0)]
    docs = spark.createDataFrame([(i, t, 9.0, "en") for i, t, _ in rows], "doc_id long, text string, score double, lang string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    model = T.train(docs, labels)
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    wrong = [(i, got[i]) for i, t, y in rows if t and (got[i] >= T.THRESHOLD) != (y == 1)]
    assert not wrong
    assert list(model.thresholds) == ["en"] and 0 < model.thresholds["en"] < 1
    more = docs.withColumn("scored_text", F.lit("x"))
    own = T.score(more, model, tuple(more.columns), "score_")
    assert own.columns == [*more.columns, "score_"] and {r.score for r in own.collect()} == {9.0}
    assert {r.doc_id: r.score_ for r in own.collect()} == got
    assert T.score(docs.where("false"), model).collect() == []


def test_thresholds_by_language(spark):
    p, y = np.array([0.05, 0.1, 0.45, 0.6, 0.7]), np.array([0, 0, 0, 1, 1])
    assert T.best_threshold(p, y, 0.1) == 0.46 and T.best_threshold(p, np.zeros(5, int), 0.1) == T.THRESHOLD
    assert T.best_threshold(np.array([0.1, 0.9]), np.array([0, 1]), 0.5) == 0.3
    model = T.fit(["bad", "good"], np.array([1, 0]), T.Config(bits=4, epochs=1))
    model.thresholds = {"en": 0.4, "": 0.6}
    df = spark.createDataFrame([("en",), (None,), ("xx",)], "lang string")
    assert [r[0] for r in df.select(T.threshold_of(model, F.col("lang"))).collect()] == [0.4, 0.6, 0.3]


def test_repeated_and_very_long_texts(spark):
    model = T.fit(["bad worse worst", "so it goes"] * 5, np.array([1, 0] * 5), T.Config(bits=6, epochs=2))
    long = "so it goes on " * 60_000
    df = spark.createDataFrame([(1, long), (1, long), (None, "bad worse worst"), (None, "bad worse worst")], "doc_id long, text string")
    got = T.score(df, model).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1 and len({r.score for r in got if r.doc_id is None}) == 1


def test_gradients_are_those_of_the_loss():
    config = T.Config(bits=5, spread=0.3)
    texts, y, w = ["one two three four", "", "five", "two two one six seven"], np.array([1, 0, 0, 1]), np.array([0.3, 0.2, 0.1, 0.4])
    model = T.fit(["x"], np.array([1]), T.Config(bits=5, epochs=0, spread=0.3))
    docs = [T.features(d := np.frombuffer(t.encode(), np.uint8), np.array([0, len(d)]), config.bits)[0] for t in texts]

    def loss():
        z = np.array([naive(model, t) for t in texts])
        return float((w * (np.log1p(np.exp(z)) - y * z)).sum())

    grads, at, pushed = T._gradients(model, docs, y, w)
    embed = np.zeros_like(model.embed)
    np.add.at(embed, at, pushed)
    named = {"out": model.out, "out_bias": model.out_bias, "bias": model.bias, "conv0": model.conv[0], "conv2": model.conv[2], "embed": model.embed}
    r = np.random.default_rng(1)
    for name, v in named.items():
        g = embed if name == "embed" else grads[name]
        for k in r.choice(v.size, min(30, v.size), replace=False):
            i, old, e = np.unravel_index(k, v.shape), v.flat[k], 1e-6
            v[i] = old + e
            up = loss()
            v[i] = old - e
            down = loss()
            v[i] = old
            assert abs((up - down) / (2 * e) - g[i]) < 1e-5


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, d):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = T.op10_toxicity(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) >= (0.8 if d.endswith("0.01") else 0.97)
    up, down = ([r.score for r in held if toxic[r.doc_id] == y] for y in (1, 0))
    assert np.mean([[a > b for b in down] for a in up]) >= (0.7 if d.endswith("0.01") else 0.95)


def test_unlabelled_input_still_scores(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert len(T.score(docs, T.train(docs, labels)).collect()) == 1


def test_rows_of_a_chunk_do_not_mix():
    import pyarrow as pa

    (_, _, data, offsets), = tb.chunks(pa.array(["ab cd", "ef", None, " gh"]))
    assert T.features(data, offsets, 5)[1].tolist() == [0, 2, 3, 3, 4]


def test_a_null_doc_id_is_scored_and_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "a b", "en"), (2, None, None), (2, None, None)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = T.op10_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 3 and [r.held_out for r in got if r.doc_id is None] == [False] and all(0 <= r.score <= 1 for r in got)


def learnt(n):
    """The first n ids that labels may be learnt from."""
    return [i for i in range(2 * n) if zlib.crc32(str(i).encode()) % 4 != 2][:n]


def test_every_labelled_row_is_learnt_from(spark, monkeypatch):
    """A word that stands only in toxic rows after the first 1,500 by crc32 counts as much as one in those before; several
    shards give the same model however rows are dealt over tasks."""
    monkeypatch.setattr(T, "SHARD_ROWS", 700, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    ids = sorted(learnt(3400), key=lambda i: (zlib.crc32(f"fit{i}".encode()), i))
    bad, good = ids[::2], ids[1::2]
    rows = [(i, f"words number {i} {'rotten' if k < 1500 else 'grubby'}", 1) for k, i in enumerate(bad)] + [(i, f"words number {i} w{i % 400}", 0) for i in good]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    asked = spark.createDataFrame([(1, "words number rotten"), (2, "words number grubby"), (3, "words number other")], "doc_id long, text string")
    found = []
    for parts in (3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        model = T.train(df.repartition(parts).select("doc_id", "text"), df.select("doc_id", "toxic"))
        found.append({r.doc_id: r.score for r in T.score(asked, model).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0][1] >= T.THRESHOLD and found[0][2] >= T.THRESHOLD > found[0][3]
    assert found[0] == found[1]


def test_long_labelled_texts_are_learnt_from(spark):
    ids = learnt(500)
    rows = [(i, f"so it goes {i} {'rotten' if k % 3 == 0 else f'w{i % 100}'} ", int(k % 3 == 0)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.train(df.select("doc_id", F.concat("text", F.expr("repeat('x', 100000)")).alias("text")), df.select("doc_id", "toxic"))
    asked = spark.createDataFrame([(1, "so it goes 5 rotten " + "x" * 100_000), (2, "so it goes 5 other " + "x" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in T.score(asked, model).collect()}
    assert got[1] >= T.THRESHOLD > got[2]


@pytest.mark.parametrize("bits", [8, 1 << 26])
def test_the_filter_before_the_join_loses_no_row(spark, monkeypatch, bits):
    monkeypatch.setattr(T, "FILTER_BITS", bits)
    ids = learnt(3000)
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(ids[0], "again"), (ids[1], None), (None, "x")], "doc_id int, text string")
    known = spark.createDataFrame([(i, i % 2) for i in ids[::3]] + [(10**12, 1)], "doc_id long, toxic int")
    got = sorted((r.doc_id, r.text, r.toxic) for r in T._labelled(docs, known, 1001).collect())
    assert got == sorted([(i, f"t{i}", i % 2) for i in ids[::3]] + [(ids[0], "again", ids[0] % 2)])


def test_gradients_of_cut_texts(monkeypatch):
    texts, y, w = ["one two three four five six", "", "five", "two two one six seven " * 9], np.array([1, 0, 0, 1]), np.array([0.3, 0.2, 0.1, 0.4])
    model = T.fit(["x"], np.array([1]), T.Config(bits=5, epochs=0, spread=0.3))
    docs = [T.features(d := np.frombuffer(t.encode(), np.uint8), np.array([0, len(d)]), 5)[0] for t in texts]
    whole = T._gradients(model, docs, y, w)
    for block in (1, 4, 7):
        monkeypatch.setattr(T, "BLOCK_WORDS", block)
        cut = T._gradients(model, docs, y, w)
        assert all(np.allclose(cut[0][k], v) for k, v in whole[0].items()) and (cut[1] == whole[1]).all() and np.allclose(cut[2], whole[2])
