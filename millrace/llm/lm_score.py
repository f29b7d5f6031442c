"""Cross-entropy difference between a target and a background n-gram model.

Both models are interpolated bigram models over one vocabulary (the words that occur in at least ``MIN_DOCS``
documents of the whole corpus; all others are one unknown word), with the same smoothing, so a token's two losses
differ only by the corpora. The target is learnt from every document labelled good, the background from every
document.

Counts are exact and nowhere whole: they are dealt by hash over buckets, whose number grows with the corpus. Documents
are packed into blocks. A block asks each bucket for the totals of its distinct words, later of its distinct words and
pairs, adding its own counts as it asks, so even a word of every document makes one entry a block; the answers are
joined to the block, which then sums its documents' losses. Words and pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textbuf as tb
from millrace.llm.scratch import Scratch

MIN_DOCS = 2
#: Weights of the pair, the word and the uniform part of a token's probability.
MIXTURE = (0.6, 0.39, 0.01)
#: Text of a block of documents, and entries of a bucket that one task holds; a longer text is a block of its own.
BLOCK_BYTES, BUCKET_ENTRIES = 4 << 20, 1 << 20
#: Fewest buckets, as log2.
BUCKET_BITS = 6

U64 = np.uint64
#: Stand in the place of the word before a row's first one, and in that of a word counted alone.
START, ALONE = U64(2), U64(3)

#: kind: STATE of a block, questions to a BUCKET or its answers (at: the bucket), or a GOOD row of the block (at: which).
STATE, BUCKET, GOOD = 0, 1, 2
ROW = "block long, kind int, at long, data binary"
STATES = ROW + ", entries long, tokens long, good_tokens long, texts long, good_texts long"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, those of like weight side by side, without the high ones that are 0 throughout."""
    head, body = [], []
    for x in arrays:
        planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
        used = next((k for k in range(x.itemsize, 0, -1) if planes[k - 1].any()), 0)
        head.append(f"{x.dtype.str}{used}{len(x)}")
        body.append(planes[:used].tobytes())
    return b"\n".join([",".join(head).encode(), b"".join(body)])


def _unpack(data: bytes) -> list[np.ndarray]:
    head, _, body = data.partition(b"\n")
    out, at = [], 0
    for x in head.decode().split(","):
        kind, used, n = np.dtype(x[:3]), int(x[3]), int(x[4:])
        planes = np.zeros((n, kind.itemsize), np.uint8)
        planes[:, :used] = np.frombuffer(body, np.uint8, n * used, at).reshape(used, n).T
        out.append(planes.reshape(-1).view(kind))
        at += n * used
    return out


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _before(ids: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """The word before each word; before a row's first word stands start."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[first[:-1][np.diff(first) > 0]] = start
    return out


def _keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tb.mix(before * U64(tb.BASE) + word)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """STATES of this task's blocks: doc_id of each row and whether it is there, words of each row, index of each
    word's hash, the distinct hashes and the rows that hold each."""
    task, n = TaskContext.get().partitionId() << 32, 0
    held: list[tuple] = []

    def done() -> pa.RecordBatch:
        docs, there, sizes, words = (np.concatenate(x) for x in zip(*held, strict=True))
        known, index = np.unique(words, return_inverse=True)
        row = np.repeat(np.arange(len(sizes)), sizes)
        rows = np.bincount(np.unique(row * len(known) + index) % max(1, len(known)), minlength=len(known))
        data = _pack(docs, there, sizes.astype(np.int64), index.astype(np.uint32), known, rows.astype(np.uint32))
        return _batch([(task + n, STATE, -1, data, len(known), len(words), 0, int((sizes > 0).sum()), 0)], STATES)

    size = 0
    for batch in batches:
        for a, b, data, offsets in tb.chunks(batch.column(1)):
            if held and size + len(data) > limit:
                yield done()
                held, size, n = [], 0, n + 1
            low = tb.LOWER[data]
            starts, ends, first = tb.words(low, offsets, tb.ALNUM)
            words = np.maximum(tb.span_hashes(low, starts, ends), U64(4))
            docs = batch.column(0).slice(a, b - a)
            held.append((docs.fill_null(0).to_numpy(zero_copy_only=False), docs.is_valid().to_numpy(zero_copy_only=False), np.diff(first), words))
            size += len(data)
    if held:
        yield done()


def _asked(block: int, keys: np.ndarray, counts: list[np.ndarray], bits: int) -> list[tuple]:
    """One row for each bucket that has some of the sorted keys: its first key, the steps from key to key, and the counts."""
    cut = np.searchsorted(keys >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64))
    return [(block, BUCKET, k, _pack(keys[i : i + 1], np.diff(keys[i:j], prepend=keys[i]), *(c[i:j] for c in counts))) for k, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if i < j]


def _word_questions(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            *_, known, rows = _unpack(data.as_py())
            yield _batch(_asked(block, known, [rows], bits), ROW)


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, row and doc_id of each row that has one."""
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            docs, there, *_ = _unpack(data.as_py())
            at = np.flatnonzero(there)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at), pa.array(docs[at])], ["block", "at", "doc_id"])


def _answers(table: pa.Table, least: int) -> pa.Table:
    """To each block's question to this bucket, the totals of its keys in its order; in entries, how many keys have a
    first total of at least ``least``, told once."""
    asked = [_unpack(x.as_py()) for x in table.column("data")]
    known, index = np.unique(np.concatenate([x[0] + np.cumsum(x[1]) for x in asked]), return_inverse=True)
    totals = [np.bincount(index, np.concatenate(c), len(known)).astype(np.int64) for c in list(zip(*asked, strict=True))[2:]]
    kept = int((totals[0] >= least).sum())
    out, at = [], 0
    for block, bucket, keys in zip(table.column("block").to_pylist(), table.column("at").to_pylist(), asked, strict=True):
        mine = index[at : at + len(keys[1])]
        out.append((block, BUCKET, bucket, _pack(*(t[mine] for t in totals)), 0 if at else kept))
        at += len(mine)
    return pa.Table.from_batches([_batch(out, ROW + ", entries long")])


def _gathered(table: pa.Table) -> tuple[int, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(block, its state, answers in the order of its keys, its good rows)."""
    kinds, at = table.column("kind").to_numpy(), table.column("at").to_numpy()
    state = _unpack(table.column("data")[int(np.flatnonzero(kinds == STATE)[0])].as_py())
    from_buckets = np.flatnonzero(kinds == BUCKET)
    parts = [_unpack(table.column("data")[int(i)].as_py()) for i in from_buckets[np.argsort(at[from_buckets])]]
    return table.column("block")[0].as_py(), state, [np.concatenate(x) for x in zip(*parts, strict=True)], at[kinds == GOOD]


def _limited(table: pa.Table, min_docs: int) -> pa.Table:
    """The block's new STATE: as before, and which rows are good, with the words outside the vocabulary as one."""
    block, (docs, there, sizes, index, known, _), totals, good_rows = _gathered(table)
    good = np.zeros(len(sizes), bool)
    good[good_rows] = True
    words, place = np.unique(np.where(totals[0] >= min_docs, known, U64(0)), return_inverse=True) if len(known) else (known, index)
    some = sizes > 0
    sums = (len(index), int(sizes[good].sum()), int(some.sum()), int((good & some).sum()))
    return pa.Table.from_batches([_batch([(block, STATE, -1, _pack(docs, there, sizes, good, place[index].astype(np.uint32), words), 0, *sums)], STATES)])


def _entries(sizes: np.ndarray, index: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """(the sorted keys of a block's distinct pairs and words, distinct pair of each word, places in the keys of each
    distinct pair, of its word and of the word before, and of each word). The place after the last key, which also ends
    the last of these, stands for the start of a row."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    before = _before(index.astype(np.int64), first, len(words))
    pairs, some, which = np.unique(_keys(np.append(words, START)[before], words[index]), return_index=True, return_inverse=True)
    keys = np.concatenate([pairs, _keys(np.full(len(words), ALONE), words)])
    order = np.argsort(keys)
    place = np.empty(len(keys) + 1, np.int64)
    place[order] = np.arange(len(keys))
    place[-1] = len(keys)
    singles = place[len(pairs) :]
    return keys[order], which, place[: len(pairs)], singles[index[some]], singles[before[some]], singles


def _pair_questions(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            _, _, sizes, good, index, words = _unpack(data.as_py())
            keys, which, pair_at, _, _, singles = _entries(sizes, index, words)
            mine = np.repeat(good, sizes)
            counts = []
            for m in (slice(None), mine):
                count = np.zeros(len(keys), np.uint32)
                count[pair_at] = np.bincount(which[m], minlength=len(pair_at))
                count[singles[:-1]] = np.bincount(index[m], minlength=len(words))
                counts.append(count)
            yield _batch(_asked(block, keys, counts, bits), ROW)


def _losses(table: pa.Table, sums: list[int], vocabulary: int, mixture: tuple[float, float, float]) -> pa.Table:
    _, (docs, there, sizes, _, index, words), totals, _ = _gathered(table)
    first = np.concatenate([[0], np.cumsum(sizes)])
    _, which, pair_at, word_at, context_at, _ = _entries(sizes, index, words)
    loss = []
    for k in (1, 0):
        bits = np.zeros(0)
        if len(which):
            counts = np.append(totals[k], sums[2 + k]).astype(np.float64)
            context, single = counts[context_at], counts[word_at] / max(1, sums[k])
            pair = np.where(context > 0, counts[pair_at] / np.maximum(context, 1), single)
            bits = -np.log2(mixture[0] * pair + mixture[1] * single + mixture[2] / (vocabulary + 1))[which]
        added = np.concatenate([[0.0], np.cumsum(bits)])
        loss.append((added[first[1:]] - added[first[:-1]]) / np.maximum(sizes, 1))
    return pa.table({"doc_id": pa.array(docs, pa.int64(), mask=~there), "n_tokens": sizes, "target_loss": loss[0], "background_loss": loss[1], "score": loss[0] - loss[1]})


def _bits(entries: int, bucket_entries: int) -> int:
    return max(BUCKET_BITS, (-(-entries // bucket_entries) - 1).bit_length())


def score_documents(
    docs: DataFrame, labels: DataFrame, mixture: tuple[float, float, float] = MIXTURE, min_docs: int = MIN_DOCS, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES
) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, target_loss and background_loss (bits per token of the whole text) and score,
    their difference; below 0 a text is more like the target.

    docs has doc_id and text; labels has doc_id and quality, where 1 marks the target (a document is in the target if
    any of its labels says so). Texts that are null, empty or without words have no tokens and 0 for all three;
    repeated rows count as often as they occur and get a row each. Without a labelled document the target model is
    uniform over words. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "lm-score")
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.hint("merge")  # labels grow with the documents: never broadcast
    names = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = scratch.save(names.mapInArrow(lambda it: _blocks(it, block_bytes), STATES), "blocks")
    words, tokens = (int(x or 0) for x in blocks.agg(F.sum("entries"), F.sum("tokens")).first())
    word_bits, bits = _bits(words, bucket_entries), _bits(tokens, bucket_entries)
    asked = blocks.select("block", "data").mapInArrow(lambda it: _word_questions(it, word_bits), ROW)
    told = scratch.save(asked.groupBy("at").applyInArrow(lambda t: _answers(t, min_docs), ROW + ", entries long"), "words")
    vocabulary = int(told.agg(F.sum("entries")).first()[0] or 0)
    marked = blocks.select("block", "data").mapInArrow(_document_rows, "block long, at long, doc_id long").join(good, "doc_id")
    columns = ("block", "kind", "at", "data")
    rows = blocks.select(*columns).unionByName(told.select(*columns)).unionByName(marked.select("block", F.lit(GOOD).alias("kind"), "at", F.lit(None).cast("binary").alias("data")))
    limited = scratch.save(rows.groupBy("block").applyInArrow(lambda t: _limited(t, min_docs), STATES), "limited")
    sums = [int(x or 0) for x in limited.agg(*(F.sum(c) for c in ("tokens", "good_tokens", "texts", "good_texts"))).first()]
    scratch.drop("blocks")
    scratch.drop("words")
    asked = limited.select("block", "data").mapInArrow(lambda it: _pair_questions(it, bits), ROW)
    # written, so that the questions' shuffle is gone when the answers' begins
    totals = scratch.save(asked.groupBy("at").applyInArrow(lambda t: _answers(t, 1), ROW + ", entries long").select(*columns), "totals")
    both = limited.select(*columns).unionByName(totals)
    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    return both.groupBy("block").applyInArrow(lambda t: _losses(t, sums, vocabulary, mixture), schema)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both losses and their difference for every row of documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
