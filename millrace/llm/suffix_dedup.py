"""Suffix-array deduplication of byte windows with a logarithmic family of indexes per shard.

A shard's distinct segments (see repeats) come in batches, by ascending doc_id. Each batch gets a suffix array of its
window starts, compared to the window's length, with the prefixes that neighbours share. It is scanned in order against
every level that stands already: the longest match of a suffix is with one of its neighbours there, and a match of a whole
window reports the level's smallest doc_id. The batch becomes a level itself. Two levels of equal size merge in one pass
into one of twice the size, so a shard of n batches holds at most log2(n) levels and each suffix is merged that often.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import repeats
from millrace.llm import textbuf as tb

WINDOW, GRAM = 50, 20
#: Bytes of segments that one family of indexes covers, and windows of one batch, about.
BLOCK, BATCH = 1 << 20, 1 << 16


@dataclass
class Level:
    """A suffix array: the places of a text at which windows begin, in the order of the window's bytes, each distinct window
    once; the windows themselves in that order; how many first bytes each shares with the one before it; the smallest doc_id
    that has each; and the batches in it."""

    order: np.ndarray
    keys: np.ndarray
    shared: np.ndarray
    low: np.ndarray
    batches: int


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first bytes windows a and b share, pair by pair."""
    if not len(a):
        return np.zeros(0, np.int64)
    width = a.dtype.itemsize
    unlike = np.ascontiguousarray(a).view(np.uint8).reshape(-1, width) != np.ascontiguousarray(b).view(np.uint8).reshape(-1, width)
    return np.where(unlike.any(1), unlike.argmax(1), width)


def _level(order: np.ndarray, keys: np.ndarray, low: np.ndarray, batches: int) -> Level:
    """Of places in the order of their windows, one for each distinct window."""
    shared = np.concatenate([[0], _common(keys[1:], keys[:-1])])
    begin = np.flatnonzero(np.concatenate([[True], shared[1:] < keys.dtype.itemsize]))
    return Level(order[begin], keys[begin], shared[begin], np.minimum.reduceat(low, begin), batches)


def _suffix_array(place: np.ndarray, keys: np.ndarray, low: np.ndarray) -> Level:
    order = np.argsort(keys)
    return _level(place[order], keys[order], low[order], 1)


def _merged(a: Level, b: Level) -> Level:
    """Two levels as one; a stable sort of two sorted runs is one pass over both."""
    keys = np.concatenate([a.keys, b.keys])
    order = np.argsort(keys, kind="stable")
    return _level(np.concatenate([a.order, b.order])[order], keys[order], np.concatenate([a.low, b.low])[order], a.batches + b.batches)


def _scanned(level: Level, new: Level) -> tuple[np.ndarray, np.ndarray]:
    """For each window of new, whose windows are taken in order: (the longest match with a window of the level, which is one of
    its two neighbours there; the level's smallest doc_id where the match is whole, else the largest integer)."""
    at = np.searchsorted(level.keys, new.keys)
    after = np.minimum(at, len(level.keys) - 1)
    length = _common(new.keys, level.keys[after])
    width = new.keys.dtype.itemsize
    part = np.flatnonzero(length < width)
    length[part] = np.maximum(length[part], _common(new.keys[part], level.keys[np.maximum(at[part] - 1, 0)]))
    return length, np.where(length == width, level.low[after], np.iinfo(np.int64).max)


class Family:
    """Levels of growing size over batches of segments, which come by ascending doc_id."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, new: Level) -> np.ndarray:
        """The smallest doc_id of each window of a new batch, by the batch itself and all levels; the batch becomes a level."""
        best = new.low.copy()
        for level in self.levels:
            _, low = _scanned(level, new)
            np.minimum(best, low, out=best)
        self.levels.append(new)
        while len(self.levels) > 1 and self.levels[-1].batches == self.levels[-2].batches:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(_merged(a, b))
        return best


def smallest_documents(text: np.ndarray, size: np.ndarray, n: np.ndarray, low: np.ndarray, anchor: np.ndarray | None = None, window: int = WINDOW, batch: int = BATCH) -> np.ndarray:
    """For each window of each segment, in order: the smallest ``low`` of a segment that holds the same window.
    text: the segments' bytes end to end; size, n, low: of each segment its bytes, windows and smallest doc_id."""
    at = np.cumsum(size) - size
    place = np.cumsum(n) - n
    total = int(n.sum())
    start = np.repeat(at - place, n) + np.arange(total)
    # a window as one value of fixed width; all are equally long, so the zeros that numpy pads with change no comparison
    windows = np.lib.stride_tricks.as_strided(np.ascontiguousarray(text), (max(0, len(text) - window + 1), window), (1, 1))
    owner = np.repeat(np.arange(len(n)), n)
    by_document = np.argsort(low, kind="stable")
    reach = np.cumsum(n[by_document])
    out = np.full(total, np.iinfo(np.int64).max)
    family = Family()
    s = 0
    while s < len(by_document):
        e = max(s + 1, int(np.searchsorted(reach, reach[s] - n[by_document[s]] + batch, "right")))
        pick = by_document[s:e]
        mine = repeats._gathered(np.arange(total), place[pick], n[pick])
        own = np.ascontiguousarray(windows[start[mine]]).view(f"S{window}").ravel()
        new = _suffix_array(start[mine], own, low[owner[mine]])
        out[mine] = family.add(new)[np.searchsorted(new.keys, own)]
        s = e
    return out


def _finished(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for docs, texts, marks in repeats.with_ranges(batches, window):
        out: list[list] = [[], [], [], [], []]
        for a, b, data, offsets in tb.chunks(texts):
            gone = marks(a, b, offsets)
            edge = gone.copy()
            if len(gone):
                edge[1:] &= ~gone[:-1]
            heads = offsets[:-1][np.diff(offsets) > 0]
            edge[heads] = gone[heads]
            cut, spans = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, edge))
            cut, spans = np.diff(cut), np.diff(spans)
            for k in range(b - a):
                row = data[offsets[k] : offsets[k + 1]]
                kept = row[~gone[offsets[k] : offsets[k + 1]]] if cut[k] else row
                for c, v in zip(out, (len(row), int(cut[k]), int(spans[k]), hashlib.sha256(kept.tobytes()).hexdigest(), kept.tobytes()), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([docs, *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes left; a cut
    may fall inside a character, so they are binary).

    A byte of the UTF-8 text is removed if a string of ``window`` bytes over it also starts in a document with a smaller
    doc_id; strings are judged on the input, and overlaps count. docs has doc_id and text; other columns are ignored. A
    null text counts as empty. A null doc_id is smaller than all others. Rows that share a doc_id do not remove from each
    other; equal rows get equal results. A text of any length is read whole: its runs go to shards by blocks, and what is left
    of it is cut in one task, a batch of texts at a time; an empty table gives no rows.
    """

    def index(text, size, n, low, anchor):
        return smallest_documents(text, size, n, low, anchor, window, batch)

    found = repeats.removed_ranges(docs, repeats.byte_units, np.uint8, index, window, gram, block, "bytes")
    out = found.mapInArrow(lambda it: _finished(it, window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of documents."""
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept")
