"""Windows of text that repeat across documents, found shard by shard.

A document is a row of units (bytes or words). Each window of ``window`` units has an anchor: its run of ``gram`` units
with the smallest hash, the first on ties. Equal windows have equal anchors, so everything about an anchor can be
settled in the shard that its hash names:

1. ``_anchors``: each document's windows, gathered into runs that share an anchor; a shard keeps the runs of anchors
   that stand in two documents or more. A task sends a shard each anchor once, however many of its documents hold it.
   Where all runs of an anchor have equal text, its smallest doc_id already is the answer for each of their windows, as
   an index over that one text would say.
2. ``_segments``: the text under the other runs; a task sends each distinct one once, with the smallest doc_id that has it.
3. the caller's index over a shard's distinct segments says, for each of their windows, the smallest doc_id of any
   segment that holds it.
4. a join of all occurrences with that answer, on the segment's hash, gives the ranges to remove. Spark splits its
   partitions where a segment is very common.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textbuf as tb
from millrace.llm.scratch import Scratch

#: Bits of a position inside a chunk; a single document may have so many units.
_PLACE = 28
RUN = np.dtype([("anchor", "<u8"), ("start", "<i4"), ("n", "<u2")])
SEGMENT = np.dtype([("anchor", "<u8"), ("seg", "<u8"), ("low", "<i8"), ("high", "<i8"), ("n", "<u2")])
#: A prime above any number of blocks: documents of any regular numbering spread over all blocks.
_SPREAD = 1_000_003
#: Entries that a map task gathers before it sends them.
FLUSH = 1 << 19
#: Bytes of text for each shard and each block of documents; a task takes its shards one after another.
SHARD_BYTES = 32 << 20
#: Bits of an anchor's hash below those that name its shard.
_BELOW = 24


def each(batches: Iterator[pa.RecordBatch], key: str, run: Callable) -> Iterator:
    """What run gives for the batches of each value of key; rows come sorted by it."""

    def slices() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(key)).to_numpy()
            edges = np.append(np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])), len(values)) if len(values) else []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                yield int(values[s]), batch.slice(s, e - s)

    for _, part in groupby(slices(), key=lambda x: x[0]):
        yield from run(x for _, x in part)


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of words; two windows are taken as equal if all their words' hashes are."""
    starts, ends, first = tb.words(data, offsets, tb.NOT_SPACE)
    return (tb.span_hashes(data, starts, ends) >> np.uint64(32)).astype(np.uint32), first


def _runs(values: np.ndarray, first: np.ndarray, window: int, gram: int):
    """(anchor hash, hash of the text, row, first window in the row, number of windows) of the runs that share an anchor."""
    n = len(values)
    at = np.arange(n - gram + 1)
    hashes = tb.span_hashes(values, at, at + gram)
    keys = (hashes >> np.uint64(_PLACE)) << np.uint64(_PLACE)
    keys |= at.astype(np.uint64)
    place = (tb.sliding_min(keys, window - gram + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    valid = np.flatnonzero(tb.inside_rows(n - window + 1, first, window))
    if not len(valid):
        return None
    place = place[valid]
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    start, count = valid[begin], np.diff(np.append(begin, len(valid)))
    row = np.searchsorted(first, start, "right") - 1
    return hashes[place[begin]], tb.span_hashes(values, start, start + count + window - 1), row, start - first[row], count


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts keys, first place of each group in that order, group of each place)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _several(doc: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether each group of consecutive places holds two different doc_ids."""
    return np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)


BY_DOCUMENT = "kind int, block int, docs binary, ths binary, runs binary"


def _by_block(kind: int, doc: np.ndarray, th: np.ndarray, runs: np.ndarray, blocks: int) -> pa.RecordBatch:
    """One row of packed runs for each block of documents, with each run's document. kind 0: runs whose text is to be
    compared; 1: runs that are settled, all their windows being in a smaller document."""
    block = doc % _SPREAD % blocks
    order = np.argsort(block, kind="stable")
    block, doc, th, runs = block[order], doc[order], th[order], runs[order]
    edges = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(block))
    rows = [(int(block[s]), doc[s:e].tobytes(), th[s:e].tobytes(), runs[s:e].tobytes()) for s, e in zip(edges[:-1], edges[1:], strict=True)]
    columns = [pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.binary()) for k in range(4)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), *columns], ["kind", "block", "docs", "ths", "runs"])


ANCHORS = "bucket int, docs binary, ths binary, anchors binary, segs binary, at binary, starts binary, counts binary"
_NAMES = ["bucket", "docs", "ths", "anchors", "segs", "at", "starts", "counts"]


def _anchors(batches: Iterator[pa.RecordBatch], units: Callable, window: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text) -> packed entries by bucket. An anchor of several documents of a task goes out once, without a
    place (starts of -1); the places of its runs follow in rows of negative buckets, which ask nothing."""
    held: list[tuple] = []
    size = turn = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal turn
        anchor, seg, doc, th, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
        order, begin, group = _grouped(anchor)
        several = _several(doc[order], begin)
        known = several[group]
        flag = order[begin[several]]
        mine = order[known]
        if len(mine):
            turn += 1
            yield _packed(np.full(len(mine), -turn), anchor[mine], seg[mine], doc[mine], th[mine], start[mine], count[mine])
        rest = np.concatenate([order[~known], flag])
        start = start.copy()
        start[flag] = -1
        if len(rest):
            bucket = (anchor[rest] >> np.uint64(_BELOW)).astype(np.int64) % buckets
            yield _packed(bucket, anchor[rest], seg[rest], doc[rest], th[rest], start[rest], count[rest])
        held.clear()

    for batch in batches:
        docs, ths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for a, b, data, offsets in tb.chunks(batch.column(2)):
            values, first = units(data, offsets)
            if len(values) < window or (found := _runs(values, first, window, gram)) is None:
                continue
            anchor, seg, row, start, count = found
            held.append((anchor, seg, docs[a:b][row], ths[a:b][row], start.astype(np.int32), count.astype(np.uint16)))
            size += len(anchor)
            if size >= FLUSH:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def _packed(bucket, anchor, seg, doc, th, start, count) -> pa.RecordBatch:
    """Entries as one row for each bucket. Each document of a bucket is named once, as the step from the one before."""
    order = np.lexsort((start, th, doc, bucket))
    bucket, anchor, seg, doc, th, start, count = (x[order] for x in (bucket, anchor, seg, doc, th, start, count))
    columns: list[list] = [[] for _ in _NAMES]
    edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
    six, text = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, 2:] for x in (anchor, seg))
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        new = np.concatenate([[True], (doc[s + 1 : e] != doc[s : e - 1]) | (th[s + 1 : e] != th[s : e - 1])])
        heads = np.flatnonzero(new) + s
        steps = np.diff(doc[heads], prepend=0)
        for c, v in zip(columns, (int(bucket[s]), steps.tobytes(), th[heads].tobytes(), six[s:e].tobytes(), text[s:e].tobytes(), new.tobytes(), start[s:e].tobytes(), count[s:e].astype(np.uint16).tobytes()), strict=True):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(columns)], _NAMES)


def _unpacked(row: dict):
    at = np.cumsum(np.frombuffer(row["at"], bool)) - 1
    wide = np.zeros((2, len(at), 8), np.uint8)
    for k, c in enumerate(("anchors", "segs")):
        wide[k, :, 2:] = np.frombuffer(row[c], np.uint8).reshape(-1, 6)
    anchor, seg = wide.view(np.uint64)[:, :, 0]
    return anchor, seg, np.cumsum(np.frombuffer(row["docs"], np.int64))[at], np.frombuffer(row["ths"], np.int32)[at], np.frombuffer(row["starts"], np.int32), np.frombuffer(row["counts"], np.uint16)


def _repeated(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """A shard's entries -> packed runs, by block of documents, of the anchors that several documents hold."""

    def runs(anchor, start, count) -> np.ndarray:
        out = np.empty(len(anchor), RUN)
        out["anchor"], out["start"], out["n"] = anchor, start, count
        return out

    held = []
    for batch in batches:
        for row in batch.to_pylist():
            entry = _unpacked(row)
            if row["bucket"] < 0:
                yield _by_block(0, entry[2], entry[3], runs(entry[0], entry[4], entry[5]), blocks)
            else:
                held.append(entry)
    if held:
        anchor, seg, doc, th, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, begin, group = _grouped(anchor)
        flagged = np.minimum.reduceat(start[order], begin) < 0
        alike = (np.minimum.reduceat(seg[order], begin) == np.maximum.reduceat(seg[order], begin)) & ~flagged
        low = np.minimum.reduceat(doc[order], begin)
        several = _several(doc[order], begin) | flagged
        settled = order[(alike & several)[group] & (doc[order] > low[group])]
        if len(settled):
            yield _by_block(1, doc[settled], th[settled], runs(anchor[settled], start[settled], count[settled]), blocks)
        keep = order[(several & ~alike)[group]]
        keep = keep[start[keep] >= 0]
        if len(keep):
            yield _by_block(0, doc[keep], th[keep], runs(anchor[keep], start[keep], count[keep]), blocks)


SEGMENTS = "kind byte, bucket int, segments binary, contents binary, seg long, th int, doc_id long, start int"


def _gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all, end to end."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


def _segments(batches: Iterator[pa.RecordBatch], units: Callable, window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of documents -> kind 0: the distinct segments by bucket; kind 1: every occurrence. Rows come with the packed
    runs of a task's blocks before its documents (doc_id, th, text)."""
    none = lambda n, t: pa.nulls(n, t)
    known: list[tuple] = []
    sorted_ = None
    for batch in batches:
        row = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        packed = np.flatnonzero(row["kind"].to_numpy() == 0)
        for i in packed.tolist():
            known.append(tuple(np.frombuffer(row[c][i].as_buffer(), t) for c, t in (("docs", np.int64), ("ths", np.int32), ("runs", RUN))))
        if len(packed) == batch.num_rows or not known and sorted_ is None:
            continue
        if sorted_ is None:
            sorted_ = tuple(np.concatenate(x) for x in zip(*known, strict=True))
            order = np.argsort(sorted_[0], kind="stable")
            sorted_ = tuple(x[order] for x in sorted_)
            known.clear()
        batch = batch.slice(len(packed))
        docs, ths, column = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False), batch.column(4)
        held, texts = [], []
        base = 0
        low, high = np.searchsorted(sorted_[0], docs, "left"), np.searchsorted(sorted_[0], docs, "right")
        for a, b, data, offsets in tb.chunks(column):
            count = high[a:b] - low[a:b]
            if not count.any():
                continue
            values, first = units(data, offsets)
            at = _gathered(np.arange(len(sorted_[0])), low[a:b], count)
            line = np.repeat(np.arange(b - a), count)
            own = sorted_[1][at] == ths[a:b][line]
            runs, line = sorted_[2][at[own]], line[own]
            start, size = first[line] + runs["start"], runs["n"].astype(np.int64) + window - 1
            seg = tb.span_hashes(values, start, start + size)
            held.append((runs["anchor"], seg, docs[a:b][line], ths[a:b][line], runs["start"], runs["n"], start + base))
            texts.append(values)
            base += len(values)
        if not held:
            continue
        values = np.concatenate(texts)
        anchor, seg, doc, th, start, n, at = (np.concatenate(x) for x in zip(*held, strict=True))
        m = len(seg)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(m, np.int8)), none(m, pa.int32()), none(m, pa.binary()), none(m, pa.binary()), pa.array(seg.view(np.int64)), pa.array(th), pa.array(doc), pa.array(start)],
            ["kind", "bucket", "segments", "contents", "seg", "th", "doc_id", "start"],
        )
        order, begin, _ = _grouped(seg)
        one = np.empty(len(begin), SEGMENT)
        head = order[begin]
        one["anchor"], one["seg"], one["n"] = anchor[head], seg[head], n[head]
        one["low"], one["high"] = np.minimum.reduceat(doc[order], begin), np.maximum.reduceat(doc[order], begin)
        bucket = (one["anchor"] >> np.uint64(_BELOW)).astype(np.int64) % buckets
        sort = np.argsort(bucket, kind="stable")
        one, head, bucket = one[sort], head[sort], bucket[sort]
        edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
        rows = [(int(bucket[s]), one[s:e].tobytes(), _gathered(values, at[head[s:e]], one["n"][s:e].astype(np.int64) + window - 1).tobytes()) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        m = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(m, np.int8)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), *(none(m, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int32()))],
            ["kind", "bucket", "segments", "contents", "seg", "th", "doc_id", "start"],
        )


def _answers(batches: Iterator[pa.RecordBatch], index: Callable, dtype, window: int, block: int) -> Iterator[pa.RecordBatch]:
    """A shard's distinct segments -> (seg, off, cnt, low): from window ``off`` on, ``cnt`` windows whose smallest doc_id
    is ``low``. Segments of one anchor stay together; blocks of whole anchors are indexed one after another."""
    heads, contents = [], []
    for batch in batches:
        for row in batch.select(["segments", "contents"]).to_pylist():
            heads.append(np.frombuffer(row["segments"], SEGMENT))
            contents.append(np.frombuffer(row["contents"], dtype))
    if not heads:
        return
    head, text = np.concatenate(heads), np.concatenate(contents)
    heads.clear(), contents.clear()
    size = head["n"].astype(np.int64) + window - 1
    at = np.cumsum(size) - size
    # equal segments of several tasks become one
    order = np.lexsort((head["seg"], head["anchor"]))
    h = head[order]
    begin = np.flatnonzero(np.concatenate([[True], (h["seg"][1:] != h["seg"][:-1]) | (h["anchor"][1:] != h["anchor"][:-1])]))
    low, high = np.minimum.reduceat(h["low"], begin), np.maximum.reduceat(h["high"], begin)
    pick = order[begin]
    anchor, seg, n, size, at = head["anchor"][pick], head["seg"][pick], head["n"][pick].astype(np.int64), size[pick], at[pick]
    total = np.cumsum(size)
    edge = np.append(np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])), len(anchor))
    s = 0
    while s < len(anchor):
        reach = np.searchsorted(total, total[s] - size[s] + block, "right")
        e = int(edge[max(np.searchsorted(edge, s, "right"), np.searchsorted(edge, reach, "right") - 1)])
        m = index(_gathered(text, at[s:e], size[s:e]), size[s:e], n[s:e], low[s:e], anchor[s:e])
        owner = np.repeat(np.arange(s, e), n[s:e])
        within = np.arange(len(m)) - np.repeat(np.cumsum(n[s:e]) - n[s:e], n[s:e])
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (m[1:] != m[:-1])]))
        count = np.diff(np.append(new, len(m)))
        some = m[new] < high[owner[new]]
        new, count = new[some], count[some]
        yield pa.RecordBatch.from_arrays([pa.array(seg[owner[new]].view(np.int64)), pa.array(within[new].astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(m[new])], ["seg", "off", "cnt", "low"])
        s = e


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): a row's key is its doc_id and 32 bits of its text's hash; a null doc_id stands before all others."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.shiftright(F.xxhash64("text"), 32).cast("int").alias("th"), "text")


def removed_ranges(docs: DataFrame, units: Callable, dtype, index: Callable, window: int, gram: int, block: int, name: str) -> DataFrame:
    """Every row of docs with the ranges of its units under windows that also start in a document of a smaller doc_id, laid
    out for with_ranges: blocks of documents, ranges before texts."""
    scratch = Scratch(docs.sparkSession, name)
    rows = keyed(docs)
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    blocks = buckets
    entries = rows.mapInArrow(lambda it: _anchors(it, units, window, gram, buckets), ANCHORS)
    dealt = entries.repartition("bucket").sortWithinPartitions("bucket")
    runs = scratch.save(dealt.mapInArrow(lambda it: each(it, "bucket", lambda x: _repeated(x, blocks)), BY_DOCUMENT), "runs")
    packed = runs.where("kind = 0")
    own = F.pmod(F.pmod("doc_id", F.lit(_SPREAD)), F.lit(blocks)).cast("int").alias("block")
    texts = rows.select(F.lit(2).alias("kind"), own, "doc_id", "th", "text")
    both = packed.unionByName(texts, allowMissingColumns=True).select("kind", "block", "doc_id", "th", "text", "docs", "ths", "runs")
    dealt = both.repartition("block").sortWithinPartitions("block", "kind")
    found = scratch.save(dealt.mapInArrow(lambda it: each(it, "block", lambda x: _segments(x, units, window, buckets)), SEGMENTS), "segments")
    shards = found.where("kind = 0").select("bucket", "segments", "contents").repartition("bucket").sortWithinPartitions("bucket")
    answered = shards.mapInArrow(lambda it: each(it, "bucket", lambda x: _answers(x, index, dtype, window, block)), "seg long, off int, cnt int, low long")
    answers = scratch.save(answered, "answers")
    uses = found.where("kind = 1").select("seg", "th", "doc_id", "start")
    hit = uses.join(answers, "seg").where("low < doc_id")
    ranges = hit.select(F.lit(0).alias("kind"), own, "doc_id", "th", (F.col("start") + F.col("off")).alias("start"), (F.col("cnt") + (window - 1)).alias("size"))
    ranges = scratch.save(ranges, "ranges")
    scratch.drop_others("runs", "ranges")
    settled = runs.where("kind = 1").select(F.lit(1).alias("kind"), "block", "docs", "ths", "runs")
    both = ranges.unionByName(settled, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    both = both.select("kind", "block", "doc_id", "th", "text", "start", "size", "docs", "ths", "runs")
    return both.repartition("block").sortWithinPartitions("block", "kind")


def with_ranges(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.Array, pa.Array, Callable]]:
    """The rows of removed_ranges as (doc_id, text, marks) of some documents at a time, where marks(a, b, first) says which
    units of rows a to b, beginning at first, are removed."""
    return each(batches, "block", lambda x: _with_ranges(x, window))


def _with_ranges(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.Array, pa.Array, Callable]]:
    known: list[tuple] = []
    ready = None
    for batch in batches:
        row = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        kind = row["kind"].to_numpy()
        n0, n1 = int(np.searchsorted(kind, 1)), int(np.searchsorted(kind, 2))
        if n0:
            known.append(tuple(row[c].slice(0, n0).to_numpy(zero_copy_only=False) for c in ("doc_id", "th", "start", "size")))
        for i in range(n0, n1):
            runs = np.frombuffer(row["runs"][i].as_buffer(), RUN)
            known.append((np.frombuffer(row["docs"][i].as_buffer(), np.int64), np.frombuffer(row["ths"][i].as_buffer(), np.int32), runs["start"], runs["n"].astype(np.int32) + (window - 1)))
        if n1 == batch.num_rows:
            continue
        if ready is None:
            parts = known or [(np.zeros(0, np.int64), *(np.zeros(0, np.int32),) * 3)]
            ready = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(ready[0], kind="stable")
            ready = tuple(x[order] for x in ready)
            known.clear()
        batch = batch.slice(n1)
        docs, ths = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        low, high = np.searchsorted(ready[0], docs, "left"), np.searchsorted(ready[0], docs, "right")

        def marks(a: int, b: int, first: np.ndarray, low=low, high=high, ths=ths) -> np.ndarray:
            change = np.zeros(int(first[-1]) + 1, np.int64)
            at = _gathered(np.arange(len(ready[0])), low[a:b], high[a:b] - low[a:b])
            line = np.repeat(np.arange(b - a), high[a:b] - low[a:b])
            own = ready[1][at] == ths[a:b][line]
            start = first[line[own]] + ready[2][at[own]]
            np.add.at(change, start, 1)
            np.add.at(change, start + ready[3][at[own]], -1)
            return np.cumsum(change[:-1]) > 0

        yield batch.column(2), batch.column(4), marks
