"""Substring deduplication of word windows with an FM-index per shard.

Of a shard's distinct segments (see repeats) those of smaller documents become one text of word numbers, each segment
closed by a mark. Its FM-index is the Burrows-Wheeler transform in a wavelet matrix of packed bits, and one byte a place
for the prefix that neighbours in suffix order share. The segments of larger documents are streamed from their last word
to their first: each step of backward search extends the match by one word, or shortens it to where it can be extended,
which gives the matching statistics of every place. Where a match is as long as a window, its interval is reported, and
with it the smallest doc_id in the interval.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import repeats
from millrace.llm import textbuf as tb

WINDOW, GRAM = 50, 10
#: Words that one index covers, about.
BLOCK = 1 << 20


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(the suffixes of text in order, how many first symbols each shares with the one before it, at most ``depth``), by
    prefix doubling. Each 0 ends what stands before it and is unlike any other 0 (the earlier the smaller), so no
    comparison runs past one."""
    n = len(text)
    marks = text == 0
    rank = np.where(marks, np.cumsum(marks) - 1, text + marks.sum())
    rank, done = np.unique(rank, return_inverse=True)[1].astype(np.int64), 1
    ranks = []
    while True:
        if done <= depth:
            ranks.append(rank.astype(np.int32))
        ahead = np.zeros(n, np.int64)
        ahead[: n - done] = rank[done:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        done *= 2
        if rank.max(initial=0) == n - 1:
            break
    shared = np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = order[:-1] + shared[1:], order[1:] + shared[1:]
        inside = np.maximum(x, y) < n
        shared[1:] += (inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])).astype(np.int64) << k
    return order, np.minimum(shared, depth).astype(np.uint8 if depth < 256 else np.int32)


class Wavelet:
    """rank of a symbol before a place, over a row of numbers: for each of their bits the bits of the row, 64 to a word, and
    the number of ones before each word."""

    def __init__(self, row: np.ndarray):
        self.bits = max(1, int(row.max(initial=0)).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for b in range(self.bits - 1, -1, -1):
            bit = ((row >> b) & 1).astype(bool)
            packed = np.zeros((len(row) // 64 + 1) * 8, np.uint8)
            packed[: -(-len(row) // 8)] = np.packbits(bit, bitorder="little")
            words = packed.view("<u8")
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(len(row) - int(bit.sum()))
            row = np.concatenate([row[~bit], row[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the places under ``place``; start: where the symbol's own run begins below."""
        at = place
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            one = self.before[k][word] + np.bitwise_count(self.words[k][word] & below)
            at = np.where((symbol >> b) & 1, self.zeros[k] + one, at - one)
        return at - start


class FMIndex:
    """Backward search over a text of symbols from 1, in which 0 closes each part, for matches of up to ``depth`` symbols.
    Of the suffix array only the shared prefixes of neighbours stay, in a byte each; value: one number for each place of
    the text, of which an interval of whole matches reports the smallest."""

    def __init__(self, text: np.ndarray, value: np.ndarray, depth: int):
        order, self.shared = suffix_order(text, depth)
        self.n, self.depth = len(text), depth
        self.wavelet = Wavelet(text[order - 1])  # the mark at the text's end stands before its first symbol
        symbols = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        every = np.arange(symbols)
        self.below = self.wavelet.rank(every, np.zeros(symbols, np.int64), np.zeros(symbols, np.int64))
        self.edges: dict[int, np.ndarray] = {}
        self.smallest = np.minimum.reduceat(value[order], self.edge(depth)[:-1])

    def edge(self, length: int) -> np.ndarray:
        """Where, in suffix order, suffixes differ within their first ``length`` symbols; the first place and the end too."""
        if length not in self.edges:
            at = np.flatnonzero(self.shared < length)
            self.edges[length] = np.append(at if length else [0], self.n)
        return self.edges[length]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with the symbol and go on as those in [low, high)."""
        start = self.below[symbol]
        base = self.first[symbol]
        return base + self.wavelet.rank(symbol, low, start), base + self.wavelet.rank(symbol, high, start)

    def shortened(self, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``length`` symbols of what [low, high) share."""
        edge = self.edge(length)
        return edge[np.searchsorted(edge, low, "right") - 1], edge[np.searchsorted(edge, high, "left")]

    def parent(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The most symbols to which a match has to be shortened for its interval to grow."""
        after = np.where(high < self.n, self.shared[np.minimum(high, self.n - 1)], 0)
        return np.maximum(self.shared[low], after).astype(np.int64)

    def stream(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the parts of ``size`` symbols that text holds end to end (0: a symbol the index has not).
        For each place: the length of the longest match that begins there, at most ``depth``, and the smallest value of an
        occurrence where the length is ``depth``. All parts are read side by side, from their ends."""
        ends = np.cumsum(size)
        length, value = np.zeros(len(text), np.int64), np.full(len(text), np.iinfo(np.int64).max)
        live, low, high, m = np.arange(len(size)), np.zeros(len(size), np.int64), np.full(len(size), self.n), np.zeros(len(size), np.int64)
        for back in range(1, int(size.max(initial=0)) + 1):
            stay = size[live] >= back
            live, low, high, m = live[stay], low[stay], high[stay], m[stay]
            at = ends[live] - back
            symbol = text[at]
            full = np.flatnonzero(m == self.depth)
            if len(full):
                low[full], high[full] = self.shortened(low[full], high[full], self.depth - 1)
                m[full] = self.depth - 1
            to, end = self.step(symbol, low, high)
            lost = symbol == 0
            low[lost], high[lost], m[lost] = 0, self.n, -1
            left = np.flatnonzero((to >= end) & ~lost)
            while len(left):
                up = np.where(m[left] > 0, self.parent(low[left], high[left]), -1)
                up = np.minimum(up, m[left] - 1)
                t = int(up.max())
                mine = left[up == t]
                if t < 0:  # cannot be: each symbol of the text has a suffix
                    raise AssertionError("a symbol of the index has no suffix")
                low[mine], high[mine] = self.shortened(low[mine], high[mine], t)
                m[mine] = t
                to[mine], end[mine] = self.step(symbol[mine], low[mine], high[mine])
                left = left[to[left] >= end[left]]
            found = ~lost
            low[found], high[found] = to[found], end[found]
            m += 1
            length[at] = m
            whole = np.flatnonzero(m == self.depth)
            value[at[whole]] = self.smallest[np.searchsorted(self.edge(self.depth), low[whole], "right") - 1]
        return length, value


def smallest_documents(text: np.ndarray, size: np.ndarray, n: np.ndarray, low: np.ndarray, anchor: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window of each segment, in order: the smallest ``low`` of a segment that holds the same window. Equal windows
    have equal anchors, so the index is built over all segments but each anchor's last document, and all but each
    anchor's first are streamed. text: the segments end to end; size, n, low, anchor: of each segment its symbols, windows,
    smallest doc_id and anchor (equal ones stand together)."""
    out = np.repeat(low, n)
    begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(begin, len(anchor)))
    indexed = low < np.repeat(np.maximum.reduceat(low, begin), count)
    streamed = low > np.repeat(np.minimum.reduceat(low, begin), count)
    if not indexed.any():
        return out
    at = np.cumsum(size) - size
    own, other = (repeats._gathered(text, at[x], size[x]) for x in (indexed, streamed))
    known, numbers = np.unique(own, return_inverse=True)
    ends = np.cumsum(size[indexed] + 1) - 1
    whole = np.zeros(len(own) + len(ends), np.int64)  # 0 closes each segment
    inside = np.ones(len(whole), bool)
    inside[ends] = False
    whole[inside] = numbers + 1
    index = FMIndex(whole, np.repeat(low[indexed], size[indexed] + 1), window)
    near = np.minimum(np.searchsorted(known, other), len(known) - 1)
    length, value = index.stream(np.where(known[near] == other, near + 1, 0), size[streamed])
    # the windows of the streamed segments, among all places of these and among all windows
    sizes, windows = size[streamed], n[streamed]
    places = repeats._gathered(np.arange(len(other)), np.cumsum(sizes) - sizes, windows)
    slots = repeats._gathered(np.arange(len(out)), (np.cumsum(n) - n)[streamed], windows)
    hit = length[places] == window
    out[slots[hit]] = np.minimum(out[slots[hit]], value[places[hit]])
    return out


def _finished(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for docs, texts, marks in repeats.with_ranges(batches, window):
        out: list[list] = [[], [], []]
        for a, b, data, offsets in tb.chunks(texts):
            _, _, first = tb.words(data, offsets, tb.NOT_SPACE)
            gone = marks(a, b, first)
            raw = data.tobytes()
            for k in range(b - a):
                words = raw[offsets[k] : offsets[k + 1]].split()
                cut = gone[first[k] : first[k + 1]]
                m = int(cut.sum())
                out[0].append(len(words))
                out[1].append(m)
                out[2].append(b" ".join(compress(words, ~cut) if m else words))
        yield pa.RecordBatch.from_arrays([docs, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def dedup_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word is removed if a window of ``window`` consecutive words over it also starts in a document with a smaller
    doc_id; windows are judged on the input. docs has doc_id and text; other columns are ignored. A null or empty text
    has no words. A null doc_id is smaller than all others. Rows that share a doc_id do not remove from each other;
    equal rows get equal results.
    """

    def index(text, size, n, low, anchor):
        return smallest_documents(text, size, n, low, anchor, window)

    found = repeats.removed_ranges(docs, repeats.word_units, np.uint32, index, window, gram, block, "words")
    out = found.mapInArrow(lambda it: _finished(it, window), "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of documents."""
    out = dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
