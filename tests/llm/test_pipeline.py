import sys

import corpus_pipeline as C
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_ngram_jaccard import brute as near
from tests.llm.test_packing import check as packed
from tests.llm.test_pii import base

from millrace.llm import pii, toxicity

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_every_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = rows(docs)
    # 10: the decision follows the score of the stage's own model
    one = C.without_toxic(spark, docs, SF)
    assert one.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    limit = lambda d: model.thresholds.get(before[d].lang or "", toxicity.THRESHOLD)
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score >= limit(r.doc_id)}
    after = rows(one)
    assert set(after) == set(before) - bad and all(after[d] == before[d] for d in after)
    # 1
    two = C.without_near_copies(spark, one, SF)
    found = near([(r.doc_id, r.text) for r in after.values()])
    want = {c for _, n, c, _ in found if n} | {d for d, n, *_ in found if not n}
    kept = rows(two)
    assert set(kept) == want and two.columns == docs.columns
    # 2
    three = C.without_benchmark(spark, two, SF)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for d, _, h, _ in hits([(r.doc_id, r.text) for r in kept.values()], items) if not h}
    third = rows(three)
    assert set(third) == clean and three.columns == docs.columns
    # 9
    four = rows(C.without_personal_data(spark, three, SF))
    assert set(four) == clean
    for d, r in four.items():
        assert not base(r.text) and r.n_chars == len(r.text)
        if not base(third[d].text):
            assert r.text == third[d].text
    # 8
    out = C.packed(spark, C.without_personal_data(spark, three, SF), SF).collect()
    packed(out, [(r.doc_id, r.text) for r in four.values()])


def test_run_gives_the_last_stage(spark):
    out = C.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert pii.KINDS and "corpus_pipeline" in sys.modules


def test_copies_and_empty_texts(spark):
    df = spark.createDataFrame([(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (3, None, "z"), (4, "", "z"), (None, "q r s t u", "z")], "doc_id long, text string, first string")
    assert sorted(C.without_near_copies(spark, df, SF).select("doc_id", "text").collect(), key=str) == sorted([(1, "a b c d e f"), (3, None), (4, ""), (None, "q r s t u")], key=str)


CLASH = "doc_id long, text string, lang string, score double, sig long, row_key long, base_spans string, all_spans string, __t string, __row string, threshold double, n_chars long"


def test_clashing_columns_nulls_and_empty_tables(spark):
    """Each stage keeps every column as it is, whatever its name, and takes nulls, empty texts, repeats and empty tables."""
    row = lambda d, t, lang="en": (d, t, lang, 1.0, 2, 3, "b", "a", "t", "r", 0.1, None if t is None else len(t))
    rows = [row(1, "a b c d e f"), row(1, "a b c d e f"), row(2, None), row(3, "", None), row(None, "mail me at x.y@z.org"), row(4, "so it goes " * 3000)]
    df = spark.createDataFrame(rows, CLASH)
    for stage in (C.without_toxic, C.without_benchmark, C.without_personal_data):
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        got = sorted(map(str, out.drop("text", "n_chars").collect()))
        assert got == sorted(map(str, df.drop("text", "n_chars").collect())), stage.__name__
    red = {r.doc_id: r for r in C.without_personal_data(spark, df, SF).collect()}
    assert red[None].text == "mail me at [email]" and red[None].n_chars == 18 and red[2].text is None and red[3].text == ""
    one = C.without_near_copies(spark, df, SF)
    assert one.columns == df.columns and one.count() == 5
    assert C.packed(spark, df, SF).count() >= 6
    for _, stage in C.STAGES:
        assert stage(spark, df.where("false"), SF).collect() == []
