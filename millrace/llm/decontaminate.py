"""Benchmark decontamination by winnowing.

Both sides keep, of each window of ``WINDOW`` words, the smallest hash of its ``GRAM``-word runs. A window that a
document and an item share keeps the same run on both sides, so the join of these fingerprints misses none; each
joined fingerprint is extended to the windows it stands for, and only windows that are equal count. Items of fewer
words than a window are one window of their own length, looked up whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textbuf as tb
from millrace.llm.scratch import Scratch
from millrace.llm.workers import gives_back

WINDOW, GRAM = 10, 5
#: Bytes of benchmark text held by one task at a time; a larger benchmark is taken in several blocks.
BLOCK_BYTES = 16 << 20


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row) of lower-cased words."""
    low = tb.LOWER[data]
    starts, ends, first = tb.words(low, offsets, tb.ALNUM)
    return tb.span_hashes(low, starts, ends), first


@dataclass
class _Windows:
    """Sorted hashes of distinct windows of one length, and the numbers of the items that hold each, end to end."""

    hashes: np.ndarray
    begin: np.ndarray
    items: np.ndarray
    bits: np.ndarray = field(init=False)

    def __post_init__(self):
        self.bits = _bits(self.hashes)


def _windows(hashes: np.ndarray, items: np.ndarray) -> _Windows:
    """Of (hash, item) pairs, repeated or not."""
    order = np.lexsort((items, hashes))
    hashes, items = hashes[order], items[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])
    hashes, items = hashes[new], items[new]
    begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return _Windows(hashes[begin], np.append(begin, len(hashes)), items)


def _bits(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return out


def _found(hashes: np.ndarray, bits: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Indices of hashes that are in known."""
    at = np.flatnonzero(bits[(hashes >> np.uint64(44)).astype(np.int64)])
    if len(at) and len(known):
        near = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        return at[known[near] == hashes[at]]
    return at[:0]


def _winnowed(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The smallest gram hash of the window that begins at each word."""
    return tb.sliding_min(tb.gram_hashes(hashes, gram), window - gram + 1)


def _index(items: list[tuple[str, str]], window: int, gram: int) -> dict:
    """Windows by length, the fingerprints of those of full length, and the ids of the items. items: (item_id, text). A window
    costs some dozens of bytes here, so an index is a few times as large as its block of text."""
    names, which = np.unique(np.array([i for i, _ in items], object), return_inverse=True) if items else (np.zeros(0, object), np.zeros(0, np.int64))
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    prints = []
    column = pa.array([t or "" for _, t in items], pa.string())
    for a, b, data, offsets in tb.chunks(column):
        hashes, first = _tokens(data, offsets)
        count, own = np.diff(first), which[a:b].astype(np.int32)
        for size in np.unique(np.minimum(count, window)).tolist():
            if size:
                grams = tb.gram_hashes(hashes, size)
                at = np.flatnonzero(tb.inside_rows(len(grams), first, size))
                row = np.searchsorted(first, at, "right") - 1
                at, row = (x[np.minimum(count, window)[row] == size] for x in (at, row))
                found.setdefault(size, []).append((grams[at], own[row]))
                if size == window:
                    prints.append(np.unique(_winnowed(hashes, window, gram)[at]))
    windows = {size: _windows(*(np.concatenate(x) for x in zip(*parts, strict=True))) for size, parts in found.items()}
    known = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
    return {"windows": windows, "prints": known, "bits": _bits(known), "names": names}


def _scan(batches: Iterator[pa.RecordBatch], index, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    index = index.value
    for batch in batches:
        for a, b, data, offsets in tb.chunks(batch.column(1)):
            hashes, first = _tokens(data, offsets)
            n = len(hashes)
            change = np.zeros(n + 1, np.int64)
            rows = [set() for _ in range(b - a)]
            for size, known in index["windows"].items():
                if n < size:
                    continue
                if size == window:
                    at = _found(_winnowed(hashes, window, gram), index["bits"], index["prints"])
                else:
                    at = np.arange(n - size + 1)
                at = at[tb.inside_rows(n, first, size)[at]]
                grams = hashes[at].copy()
                for j in range(1, size):
                    grams *= np.uint64(tb.BASE)
                    grams += hashes[at + j]
                grams = tb.mix(grams)
                hit = _found(grams, known.bits, known.hashes)
                np.add.at(change, at[hit], 1)
                np.add.at(change, at[hit] + size, -1)
                which = np.searchsorted(known.hashes, grams[hit])
                row = np.searchsorted(first, at[hit], "right") - 1
                for r, w in set(zip(row.tolist(), which.tolist(), strict=True)):
                    rows[r].update(index["names"][known.items[known.begin[w] : known.begin[w + 1]]].tolist())
            hits = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
            edge = np.diff(np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]]))
            s, e = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
            spans = _spans(s, e, first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(first)),
                    pa.array(hits[first[1:]] - hits[first[:-1]]),
                    pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                    pa.array([sorted(x) for x in rows], pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "n_hit", "spans", "items"],
            )


def _spans(s: np.ndarray, e: np.ndarray, first: np.ndarray) -> list[list[list[int]]]:
    """Runs of hit words by row, from the row's first word; a run over the end of a row is cut there."""
    out: list[list[list[int]]] = [[] for _ in range(len(first) - 1)]
    for x, y in zip(s.tolist(), e.tolist(), strict=True):
        r = int(np.searchsorted(first, x, "right")) - 1
        while x < y:
            end = min(y, int(first[r + 1]))
            if x < end:
                out[r].append([x - int(first[r]), end - int(first[r])])
            x, r = end, r + 1
    return out


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(map(list, spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in turn, block_bytes of text at a time; an item of more is a block of its own."""
    held, size = [], 0
    for item, text in benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        n = len((text or "").encode())
        if held and size + n > block_bytes:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += n
    yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside any occurrence of an item's window), spans (runs of hit
    words), items (sorted ids of the items that occur).

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. A null or empty text has no words
    and hits nothing; a null item id is dropped; repeated rows give a row each. A benchmark of up to
    ``block_bytes`` is broadcast whole; a larger one is taken in blocks of that size, one after the other and each
    against all documents, whose rows are told apart by a key written with them.
    """
    spark: SparkSession = docs.sparkSession
    schema = "doc_id long, n_words long, n_hit long, spans array<array<long>>, items array<string>"
    blocks = _blocks(benchmark, block_bytes)
    block, following = next(blocks), next(blocks, None)

    def scanned(rows: DataFrame, block: list[tuple[str, str]]) -> DataFrame:
        index = spark.sparkContext.broadcast(_index(block, window, gram))
        return rows.mapInArrow(lambda it: _scan(it, index, window, gram), schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if following is None:
        return scanned(docs, block)
    scratch = Scratch(spark, "decontaminate")
    docs = scratch.save(docs.withColumn("key", F.monotonically_increasing_id()), "docs")
    both = docs.selectExpr("key", "doc_id", "0L AS n_words", "CAST(array() AS array<array<long>>) AS spans", "CAST(array() AS array<string>) AS items")
    k = 0
    while block is not None:
        part = scanned(docs.select("key", "text"), block).selectExpr("doc_id AS key", "CAST(NULL AS long) AS doc_id", "n_words", "spans", "items")
        part = part if k == 0 else part.where(F.size("spans") > 0)
        both = both.unionByName(scratch.save(part, f"hits{k}"))
        block, following, k = following, next(blocks, None), k + 1
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    both = both.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), items.alias("items")).drop("key")

    def merged(frames):
        for f in frames:
            f["spans"] = [_merged(x) for x in f["spans"]]
            f["n_hit"] = [sum(e - s for s, e in x) for x in f["spans"]]
            yield f[["doc_id", "n_words", "n_hit", "spans", "items"]]

    return both.mapInPandas(merged, schema)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no item's window occurs.

    A null or empty text has no words and stays, as do all rows where benchmark is empty; items of null or without words are
    ignored. Repeated rows stay or go together; a text of any length is read whole, in one row of a batch; an empty table
    gives an empty one.
    """
    spark = docs.sparkSession

    def passed(index):
        @gives_back
        def run(batches):
            for batch in batches:
                own = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text")], ["doc_id", "text"])
                hits = [x.column(2).to_numpy() for x in _scan(iter([own]), index, window, gram)]
                yield batch.filter(pa.array(np.concatenate(hits) == 0)) if hits else batch

        return run

    for block in _blocks(benchmark, block_bytes):
        index = spark.sparkContext.broadcast(_index(block, window, gram))
        docs = docs.mapInArrow(passed(index), docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of documents; whole texts of any length, each a row
    of a batch; contract of decontaminate()."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate(docs.select("doc_id", "text"), bench.select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
