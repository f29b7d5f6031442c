import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import ngram_jaccard, packing, toxicity, workers
from millrace.llm import textbuf as tb
from millrace.llm.scratch import BATCH, Scratch


def held():
    """MB of this process."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


@pytest.mark.skipif(workers._trim is None, reason="needs glibc")
def test_a_task_gives_its_memory_back():
    last = []

    def work(batches):
        made = [np.ones(100_000, np.uint8) for _ in range(3000)]
        last.append(made[-1])  # what stands at the end of the heap keeps it
        yield from batches

    before = held()
    list(work([1]))
    kept = held() - before
    list(workers.gives_back(work)([1]))
    assert kept > 200 > held() - before + 150


def test_an_operator_keeps_no_tables_or_words_after_a_task():
    texts = pa.array(["some words of a short text"] * 50 + [None, ""])
    ids = pa.array(range(52))
    rows = pa.RecordBatch.from_arrays([ids, ids, texts], ["doc_id", "rk", "text"])
    assert sum(b.num_rows for b in ngram_jaccard._about(iter([rows]), 5)) == 52
    assert tb._powers.cache_info().currsize == 0
    path = packing.default_tokenizer()
    one, again = (list(packing._pieces(iter([rows.select(["doc_id", "text"])]), path, 2048)) for _ in range(2))
    assert one == again and one[0].num_rows == 52 and not packing._loaded[path].known


def test_batches_sent_to_python_are_bounded_while_a_table_is_written(spark):
    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    df = spark.range(0, 8000, numPartitions=1).selectExpr("repeat('x', 1000) AS text").mapInArrow(size, "n long")
    before = spark.conf.get(BATCH)
    found = [r.n for r in Scratch(spark, "batches", 1 << 20).save(df, "sizes").collect()]
    assert sum(found) > 8_000_000 and max(found) < 2 << 20
    assert spark.conf.get(BATCH) == before and max(r.n for r in df.collect()) > 7_000_000


def test_a_text_that_is_carried_is_sent_once(spark):
    model = toxicity.initial(toxicity.Config(), np.random.default_rng(1))
    df = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, scored_text string")
    found = toxicity.score(df, model, tuple(df.columns))
    assert "scored_text_" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert {r.doc_id: (r.text, r.scored_text, r.score) for r in found.collect()} == {1: ("a b c", "x", want[1]), 2: (None, "y", want[2]), 3: ("", None, want[3])}
