import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm.packing import _WordTokenizer, best_fit, default_tokenizer, pack


def check(rows, texts, length=2048):
    t = Tokenizer.from_file(default_tokenizer())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    want = {}
    for d, text in texts:
        want.setdefault(d, []).append(t.encode(text or "", add_special_tokens=False).ids + [0])
    for d, copies in want.items():
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[d])
        assert got == sorted((k, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for ids in copies for k, s in enumerate(range(0, len(ids), length)) for p in [ids[s : s + length]])
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= length
    return len(seqs)


TEXTS = [(1, None), (2, ""), (3, "Hello   WORLD's don't 12ab ²½"), (4, "İstanbul ΣΑΣ é \x1c   日本語 x"), (5, "a b c " * 3000), (5, "a b c " * 3000), (6, "<|endoftext|> it"), (7, "é" * 20_000), (8, "'re 've'll!!'s '' ..'s")]


def test_pieces_and_places(spark):
    df = spark.createDataFrame([(d, t, "z") for d, t in TEXTS], "doc_id long, text string, piece string")
    check(pack(df).collect(), TEXTS)
    check(pack(df, pieces_per_bucket=3, open_bins=2, batch=4).collect(), TEXTS)
    assert pack(df.where("false")).collect() == []


def test_word_cache_equals_tokenizer():
    w, t = _WordTokenizer(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    rng = np.random.default_rng(1)
    chars = list("abzAZ09 '’s.,!\n\t\x85\xa0éÉßñÆ²\x00\x1d_-#") + ["'s", " don't", "ſ", "İ"]
    for _ in range(300):
        s = "".join(rng.choice(chars, 60))
        assert w.ids([s])[0] == np.array(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), s


def test_best_fit_closes_the_fullest():
    assert best_fit([6, 7, 3, 4], 10, 2)[0] == [0, 1, 1, 0]
    assert best_fit([6, 7, 8, 3], 10, 2) == ([0, 1, 2, 0], [0, 0, 0, 6])
    with pytest.raises(ValueError):
        best_fit([11], 10, 2)


def test_small_table_is_packed_tightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = pack(docs).collect()
    n = check(rows, [tuple(r) for r in docs.collect()])
    assert n <= 1.03 * sum(r.length for r in rows) / 2048 + 1
