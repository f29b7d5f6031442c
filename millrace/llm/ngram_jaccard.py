"""Exact n-gram Jaccard join, with set relations used to skip work.

Documents with equal shingle sets form a class, and everything below handles classes. Two classes of similarity
``PERCENT`` or more share a token of their prefixes (the first n - ceil(0.8 n) + 1 tokens in an order of all shingles,
common ones last), so a token's index list holds all candidates for it. Lists are dealt to shards by the token's hash.

1. Hubs. Each index list names one leader, and each set takes the leader that most sets meet. Where set and leader share
   half of the larger one, the leader is the set's hub and the set is kept as its difference from the hub: the places of
   the hub's tokens that it lacks, and the tokens that it has beyond them.
2. Answers from the hub's. The overlap of two sets Y and Z of hub X follows from X's overlaps with each, corrected by
   what the differences share: |X| - |X-Y| - |X-Z| + |(X-Y) & (X-Z)| + |(Y-X) & (Z-X)|. Members are sorted by the
   size of their difference; where the first three terms alone decide for two runs of members, all their pairs are
   settled at once, and only for the others are the shared differences counted. A member's row carries its number of
   links, so what leaves a group grows with its members, not with their pairs. Large groups are cut into blocks.
3. Other pairs. Sets of different hubs that meet in lists are found by position: a list is cut into blocks of one size,
   sorted by place, and a set visits only the stretch of a block whose places leave room for the overlap it needs.
   Pairs that meet in too few lists are ruled out by the count, and the rest are compared in full. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textbuf as tb
from millrace.llm.components import components
from millrace.llm.counting import COUNTS, SLICE, Counter, sliced, summed
from millrace.llm.scratch import BATCH_BYTES, Scratch, unused
from millrace.llm.workers import gives_back

SHINGLE, PERCENT = 5, 80
#: log2 of the cells in which shingles are counted for their order.
CELL_BITS = 22
#: Share of the larger set, in percent, that a set and its hub have in common.
HUB_PERCENT = 50
#: Slots of a set's sketch, and the share of them that a set and its hub must have alike.
SLOTS, ALIKE = 64, 0.2
#: Members and bytes of differences of a hub that one task compares with as many others.
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20
#: Members whose pairs are settled together where the sizes of their differences decide.
TILE = 64
#: Differences counted in one product.
FEATURES = 4096
#: Members of one hub from which a list keeps them in blocks of their own.
CROWD = 16
#: Bytes of index entries in one shard.
SHARD_BYTES = 32 << 20
FLUSH = 1 << 20
ENTRY = np.dtype([("token", "<u8"), ("sig", "<i8"), ("n", "<i4"), ("at", "<i4")])


def _shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row of each, words of each row) of all runs of k words; a row of fewer words has its whole run."""
    low = tb.LOWER[data]
    starts, ends, first = tb.words(low, offsets, tb.NOT_SPACE)
    words = tb.span_hashes(low, starts, ends)
    grams = tb.gram_hashes(words, k)
    ok = np.flatnonzero(tb.inside_rows(len(grams), first, k))
    count = np.diff(first)
    row = np.searchsorted(first, ok, "right") - 1
    short = np.flatnonzero((count > 0) & (count < k))
    if not len(short):
        return grams[ok], row, count
    more = [tb.gram_hashes(words[first[r] : first[r + 1]], int(count[r]))[0] ^ np.uint64(int(count[r]) * 0x9FB21C651E98DF25 % (1 << 64)) for r in short]
    return np.concatenate([grams[ok], np.array(more, np.uint64)]), np.concatenate([row, short]), count


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each row, ascending, end to end; where each row's begin, and the end)."""
    token, row, _ = _shingles(data, offsets, k)
    order = np.argsort(token)
    order = order[np.argsort(row[order].astype(np.uint16 if len(offsets) < 1 << 16 else np.int64), kind="stable")]
    token, row = token[order], row[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    token, row = token[new], row[new]
    return token, np.searchsorted(row, np.arange(len(offsets)))


def _signatures(token: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set; 0 for an empty one."""
    n = np.diff(begin)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        total = np.add.reduceat(tb.mix(token ^ np.uint64(0x5851F42D4C957F2D)), begin[some])
        either = np.bitwise_xor.reduceat(tb.mix(token + np.uint64(0x14057B7EF767814F)), begin[some])
        out[some] = np.maximum(tb.mix(total * np.uint64(3) + either + n[some].astype(np.uint64)), np.uint64(1))
    return out.view(np.int64)


@gives_back
def _count_cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    counts = Counter(1 << CELL_BITS)
    for batch in batches:
        for _, _, data, offsets in tb.chunks(batch.column(0)):
            counts.add((_shingles(data, offsets, k)[0] >> np.uint64(64 - CELL_BITS)).astype(np.uint32))
    yield from sliced([counts.done()])


@gives_back
def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of counts -> their cells above the usual count, by how far in powers of two, and all that was counted.
    Shingles are ordered by level, then hash: any order gives the same links, this one keeps common ones out of prefixes."""
    for k, counts in summed(batches):
        usual = counts.mean() + 4 * np.sqrt(counts.mean()) + 4
        level = np.clip(np.floor(np.log2(np.maximum(counts, 1) / usual) * 2) + 1, 0, 63).astype(np.uint8)
        at = np.flatnonzero(level)
        row = ([k], [at.astype(np.uint16).tobytes()], [level[at].tobytes()], [int(counts.sum())])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["slice", "cells", "levels", "total"])


def _sketches(token: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """For each row SLOTS bytes: of the tokens of a slot a byte of the smallest, 0 in an empty slot."""
    rows = len(begin) - 1
    key = np.repeat(np.arange(rows), np.diff(begin)) * SLOTS + (token % np.uint64(SLOTS)).astype(np.int64)
    out = np.zeros(rows * SLOTS, np.uint8)
    out[key[::-1]] = np.maximum(token >> np.uint64(40) & np.uint64(0xFF), np.uint64(1)).astype(np.uint8)[::-1]  # the first of a slot is written last
    raw = out.tobytes()
    return [raw[k * SLOTS : (k + 1) * SLOTS] for k in range(rows)]


@gives_back
def _about(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, rk, text) -> doc_id, rk, size of the set, its signature, its sketch."""
    for batch in batches:
        n, sig, sketch = [], [], []
        for _, _, data, offsets in tb.chunks(batch.column(2)):
            token, begin = _sets(data, offsets, k)
            n.append(np.diff(begin))
            sig.append(_signatures(token, begin))
            sketch += _sketches(token, begin)
        if n:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n)), pa.array(np.concatenate(sig)), pa.array(sketch, pa.binary())], ["doc_id", "rk", "n", "sig", "sketch"])


@gives_back
def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, hub, rank) of those whose sketches agree in ALIKE of the slots that either fills. A pair left out here is found
    in the lists, so this only saves reading the sets of unlike pairs."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SLOTS) for k in (3, 4))
        keep = ((x == y) & (x > 0)).sum(1) >= ALIKE * ((x > 0) | (y > 0)).sum(1)
        yield pa.RecordBatch.from_arrays(batch.columns[:3], ["sig", "hub", "rank"]).filter(pa.array(keep))


LISTS, MET = "bucket int, entries binary", "a long, b long, need long, meets long"
#: Stands for a null doc_id.
LOWEST = -(1 << 63)


def _dealt(entries: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = (entries["token"] >> np.uint64(20)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
    rows = [(int(bucket[s]), entries[s:e].tobytes()) for s, e in zip(edges[:-1], edges[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "entries"])


@gives_back
def _prefixes(batches: Iterator[pa.RecordBatch], shared, k: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Prefix tokens of each distinct set of a task, by shard."""
    levels = shared.value
    held, size, seen = [], 0, set()
    for batch in batches:
        for _, _, data, offsets in tb.chunks(batch.column(0)):
            token, begin = _sets(data, offsets, k)
            n, sig = np.diff(begin), _signatures(token, begin)
            fresh = np.zeros(len(n), bool)
            for r in np.flatnonzero(n).tolist():
                if (s := int(sig[r])) not in seen:
                    seen.add(s)
                    fresh[r] = True
            row = np.repeat(np.arange(len(n)), n)
            level = levels[(token >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
            order = np.argsort(level, kind="stable")
            order = order[np.argsort(row[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64), kind="stable")]
            token = token[order]
            at = np.arange(len(token)) - begin[row]
            keep = fresh[row] & (at < (n - -(-percent * n // 100) + 1)[row])
            out = np.empty(int(keep.sum()), ENTRY)
            out["token"], out["sig"], out["n"], out["at"] = token[keep], sig[row[keep]], n[row[keep]], at[keep]
            held.append(out)
            size += len(out)
        if size >= FLUSH:
            yield _dealt(np.concatenate(held), buckets)
            held, size, seen = [], 0, set()
    if size:
        yield _dealt(np.concatenate(held), buckets)


@gives_back
def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's lists of two sets or more, as one row per entry (token, sig, n, at)."""
    held = [np.frombuffer(x.as_buffer(), ENTRY) for batch in batches for x in batch.column(1)]
    if not held:
        return
    e = np.concatenate(held)
    held.clear()
    e = e[np.lexsort((e["sig"], e["token"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["token"][1:] != e["token"][:-1]) | (e["sig"][1:] != e["sig"][:-1])
    e = e[new]
    head = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1]]))
    count = np.diff(np.append(head, len(e)))
    e = e[np.repeat(count > 1, count)]
    for s in range(0, len(e), 1 << 16):
        part = e[s : s + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part["token"]).view(np.int64)), *(pa.array(np.ascontiguousarray(part[c])) for c in ("sig", "n", "at"))], ["token", "sig", "n", "at"])


def _needed(n1, n2, percent: int):
    """Smallest overlap of a link: 100 * overlap >= percent * (n1 + n2 - overlap)."""
    return -(-percent * (n1 + n2) // (100 + percent))


def _meets_needed(n1, n2, percent: int):
    """In how many lists a linked pair meets at least. All tokens they share up to the end of the prefix that ends first
    are lists they meet in, and the set whose prefix that is has only ceil(percent * n / 100) - 1 tokens after it."""
    after = (percent * np.maximum(n1, n2) + 99) // 100 - 1
    return np.maximum(_needed(n1, n2, percent) - after, 1)


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of some whole lists at a time, the token first; rows come sorted by token."""
    held: list[tuple] = []
    for batch in batches:
        columns = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(columns[0]):
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last list may go on
        if held and held[0][0][0] != columns[0][-1] or last:
            yield tuple(np.concatenate(x) for x in zip(*held, tuple(c[:last] for c in columns), strict=True))
            held = []
        held.append(tuple(c[last:] for c in columns))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _begins(*keys: np.ndarray) -> np.ndarray:
    """First place of each run of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _counted(found: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (a, b, need) as distinct ones and how often each occurs."""
    rows = np.concatenate(found, axis=0)
    found.clear()
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    begin = _begins(rows[:, 0], rows[:, 1])
    columns = [np.ascontiguousarray(rows[begin, k]) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, np.diff(np.append(begin, len(rows))))], ["a", "b", "need", "meets"])


@gives_back
def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set of a list with the list's leader, the set of the smallest mixed signature, where sizes allow a hub."""
    found: list[np.ndarray] = []
    size = 0
    for token, sig, n, _ in _whole_lists(batches):
        order = np.lexsort((tb.mix(sig.view(np.uint64) + np.uint64(977)), token))
        token, sig, n = token[order], sig[order], n[order].astype(np.int64)
        first = _begins(token)
        lead = np.repeat(first, np.diff(np.append(first, len(token))))
        other = np.flatnonzero((lead != np.arange(len(lead))) & (100 * np.minimum(n, n[lead]) >= HUB_PERCENT * np.maximum(n, n[lead])))
        if len(other):
            found.append(np.stack([sig[other], sig[lead[other]], np.zeros(len(other), np.int64)], 1))
            size += len(other)
        if size >= FLUSH:
            yield _counted(found)
            size = 0
    if found:
        yield _counted(found)


@gives_back
def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, hub, rank, tokens of the set, tokens of the hub) -> sig, hub, rank, size of the hub, places of the hub's tokens
    that the set lacks, tokens that it has beyond; only where they share enough."""
    for batch in batches:
        ok, size, lacks, more = [], [], [], []
        for x, y in zip(batch.column(3), batch.column(4), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            shared = y[at] == x
            ok.append(100 * int(shared.sum()) >= HUB_PERCENT * max(len(x), len(y)))
            if ok[-1]:
                gone = np.ones(len(y), bool)
                gone[at[shared]] = False
                size.append(len(y))
                lacks.append(np.flatnonzero(gone).astype(np.int32).tobytes())
                more.append(x[~shared].tobytes())
        keep = pa.RecordBatch.from_arrays(batch.columns[:3], ["sig", "hub", "rank"]).filter(pa.array(ok, pa.bool_()))
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(size, pa.int32()), pa.array(lacks, pa.binary()), pa.array(more, pa.binary())], ["sig", "hub", "rank", "hub_n", "lacks", "more"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The rows of each (hub, lo, hi); rows come sorted by these."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if held:
                    yield held
                held, key = [], row[:3]
            held.append(row)
    if held:
        yield held


def _incidence(parts: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(member, number of the value among those that several members have) for all values of all parts."""
    values = np.frombuffer(b"".join(parts), kind)
    member = np.repeat(np.arange(len(parts)), [len(p) // kind.itemsize for p in parts])
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    several = count > 1
    number = np.cumsum(several) - 1
    keep = several[inverse]
    return member[keep], number[inverse[keep]]


def _linked(size: int, lacks: list[bytes], more: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of sets that differ from one hub of ``size`` tokens by what they lack and have more are linked."""
    r, a = np.array([len(x) // 4 for x in lacks], np.int32), np.array([len(x) // 8 for x in more], np.int32)
    m, n = len(r), size - r + a
    most = size - np.maximum(r[:, None], r) + np.minimum(a[:, None], a)
    least = size - r[:, None] - r
    total = n[:, None] + n
    whole, part = np.int64(100 + percent), np.int64(percent)
    link = whole * least >= part * total  # settled by the hub's answers alone
    open_ = ~link & (whole * most >= part * total)
    if not open_.any():
        return link
    tiles = np.add.reduceat(np.add.reduceat(open_, np.arange(0, m, TILE), axis=0, dtype=np.int64), np.arange(0, m, TILE), axis=1) > 0
    common = np.zeros((m, m), np.float32)
    for member, number in (_incidence(lacks, np.dtype(np.int32)), _incidence(more, np.dtype(np.uint64))):
        order = np.argsort(number, kind="stable")
        member, number = member[order], number[order]
        for f in range(0, int(number[-1]) + 1 if len(number) else 0, FEATURES):
            s, e = np.searchsorted(number, (f, f + FEATURES))
            has = np.zeros((m, min(FEATURES, int(number[e - 1]) - f + 1)), np.float32)
            has[member[s:e], number[s:e] - f] = 1
            for i in range(len(tiles)):
                columns = np.flatnonzero(tiles[i])
                if len(columns):
                    lo, hi = columns[0] * TILE, (columns[-1] + 1) * TILE
                    common[i * TILE : (i + 1) * TILE, lo:hi] += has[i * TILE : (i + 1) * TILE] @ has[lo:hi].T
    exact = least + common.astype(np.int32)
    return link | (open_ & (whole * exact >= part * total))


@gives_back
def _solved(batches: Iterator[pa.RecordBatch], percent: int, pairs: bool) -> Iterator[pa.RecordBatch]:
    """Members of hubs by block, as (hub, lo, hi, block, sig, copies, hub_n, lacks, more), sorted by the first three. Gives
    (a, b, links): with ``pairs`` each link of two members; else each member, one that it is connected with here, and how many
    documents it links to here."""
    out: list[tuple[np.ndarray, ...]] = []
    size = 0
    names, kinds = ["a", "b", "links"], [pa.int64()] * 3

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out.clear()
        return batch

    for rows in _groups(batches):
        rows.sort(key=lambda x: len(x[7]) + len(x[8]))
        _, lo, hi, block, sig, copies, hub_n, lacks, more = zip(*rows, strict=True)
        link = _linked(hub_n[0], lacks, more, percent)
        np.fill_diagonal(link, False)
        if lo[0] != hi[0]:  # pairs inside a block are settled with the block itself
            block = np.array(block)
            link &= block[:, None] != block
        sig = np.array(sig)
        if pairs:
            i, j = np.nonzero(np.triu(link))
            out.append((sig[i], sig[j], np.ones(len(i), np.int64)))
        else:
            first = np.arange(len(sig))
            for k in range(len(sig)):
                if first[k] == k and link[k].any():
                    seen = front = np.zeros(len(sig), bool)
                    front = front.copy()
                    front[k] = True
                    while front.any():
                        seen = seen | front
                        front = link[front].any(0) & ~seen
                    first[seen] = k
            copies = np.array(copies, np.int64)
            out.append((sig, sig[first], np.array([copies[x].sum() for x in link], np.int64)))
        size += len(out[-1][0])
        if size >= FLUSH:
            yield flushed()
            size = 0
    if out:
        yield flushed()


@gives_back
def _crossing(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a list that have different hubs and may reach the overlap they need. A list is cut into blocks of one size
    (and one hub, where many have it), sorted by place. Each set goes through the blocks from its own on, up to those too
    large for it, and takes of each only the places at which enough tokens can still be shared; blocks of its hub are
    passed over."""
    found: list[np.ndarray] = []
    size = 0
    for token, sig, n, at, hub in _whole_lists(batches):
        order = np.lexsort((hub, token))
        run = _begins(token[order], hub[order])
        count = np.repeat(np.diff(np.append(run, len(token))), np.diff(np.append(run, len(token))))
        crowd = np.zeros(len(token), np.int64)
        crowd[order] = np.where(count >= CROWD, hub[order], 0)
        order = np.lexsort((sig, at, crowd, n, token))
        token, sig, n, at, hub, crowd = token[order], sig[order], n[order].astype(np.int64), at[order].astype(np.int64), hub[order], crowd[order]
        begin = _begins(token, n, crowd)
        ends = np.append(begin[1:], len(token))
        block = np.repeat(np.arange(len(begin)), ends - begin)
        place = (block.astype(np.int64) << 32) + at  # ascending, as entries are sorted by block and place
        left = np.arange(len(token))
        step = 0
        while len(left):
            to = block[left] + step
            left, to = left[to < len(begin)], to[to < len(begin)]
            head = begin[to]
            keep = (token[head] == token[left]) & (100 * n[left] >= percent * n[head])
            left, to, head = left[keep], to[keep], head[keep]
            step += 1
            if not len(left):
                break
            other = np.flatnonzero((crowd[left] == 0) | (crowd[head] != crowd[left]))
            i, h, t = left[other], head[other], to[other]
            need = _needed(n[i], n[h], percent)
            lo = np.searchsorted(place, (t << 32) + np.maximum(at[i] - (n[i] - need), 0), "left")
            hi = np.searchsorted(place, (t << 32) + np.minimum(at[i] + n[h] - need, (1 << 32) - 1), "right")
            if step == 1:
                lo = np.maximum(lo, i + 1)
            many = np.maximum(hi - lo, 0)
            for s, e in _portions(many, FLUSH):
                ii = np.repeat(i[s:e], many[s:e])
                jj = np.arange(len(ii)) - np.repeat(np.cumsum(many[s:e]) - many[s:e], many[s:e]) + np.repeat(lo[s:e], many[s:e])
                late = np.minimum(at[ii], at[jj])
                meets = _meets_needed(n[ii], n[jj], percent)
                prefix = [n[x] - (percent * n[x] + 99) // 100 + 1 - at[x] for x in (ii, jj)]
                ok = (hub[ii] != hub[jj]) & (late + np.minimum(*prefix) >= meets)
                if ok.any():
                    a, b = sig[ii[ok]], sig[jj[ok]]
                    found.append(np.stack([np.minimum(a, b), np.maximum(a, b), meets[ok]], 1))
                    size += int(ok.sum())
                if size >= FLUSH:
                    yield _counted(found)
                    size = 0
    if found:
        yield _counted(found)


def _portions(many: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of entries whose numbers sum to the limit at most, or single entries."""
    total, s = np.concatenate([[0], np.cumsum(many)]), 0
    while s < len(many):
        e = max(s + 1, int(np.searchsorted(total, total[s] + limit, "right")) - 1)
        yield s, e
        s = e


@gives_back
def _tokens(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(sig, text) -> sig and the packed tokens of the set."""
    for batch in batches:
        for a, b, data, offsets in tb.chunks(batch.column(1)):
            token, begin = _sets(data, offsets, k)
            packed = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((begin * 8).astype(np.int32)), pa.py_buffer(token.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), packed], ["sig", "tokens"])


@gives_back
def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            ok.append(100 * same >= percent * (len(x) + len(y) - same))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def row_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), F.coalesce("text", F.lit("")))


class _Join:
    """One run of the join over docs: classes of equal sets, hubs, and the links found."""

    def __init__(self, docs: DataFrame, shingle: int, percent: int, hubs: bool):
        self.spark, self.shingle, self.percent = docs.sparkSession, shingle, percent
        self.scratch = Scratch(self.spark, "jaccard", BATCH_BYTES)
        self.rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), row_key().alias("rk"), F.coalesce("text", F.lit("")).alias("text"))
        self.about = self.scratch.save(self.rows.mapInArrow(lambda it: _about(it, shingle), "doc_id long, rk long, n long, sig long, sketch binary"), "about")
        named = self.about.where("n > 0").groupBy("sig")
        self.classes = self.scratch.save(named.agg(F.min("doc_id").alias("smallest"), F.min_by("rk", F.struct("doc_id", "rk")).alias("rk"), F.count("*").alias("copies"), F.min("sketch").alias("sketch")), "classes")
        self.lists = self.scratch.save(self._lists(), "lists")
        self.tokens: list[DataFrame] = []
        self.members = self._members() if hubs else None

    def _lists(self) -> DataFrame:
        k, percent = self.shingle, self.percent
        levels, total = np.zeros(1 << CELL_BITS, np.uint8), 0
        counted = self.rows.select("text").mapInArrow(lambda it: _count_cells(it, k), COUNTS).repartition("slice")
        found = self.scratch.save(counted.mapInArrow(_levels, "slice int, cells binary, levels binary, total long"), "levels")
        for r in found.toLocalIterator():
            levels[r["slice"] * SLICE + np.frombuffer(r["cells"], np.uint16).astype(np.int64)] = np.frombuffer(r["levels"], np.uint8)
            total += r["total"]
        shared = self.spark.sparkContext.broadcast(levels)
        entries = total * (100 - percent) // 100 * ENTRY.itemsize
        buckets = max(4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // SHARD_BYTES))
        prefixes = self.rows.select("text").mapInArrow(lambda it: _prefixes(it, shared, k, percent, buckets), LISTS)
        return prefixes.repartition(max(buckets // 4, 1), "bucket").mapInArrow(_several, "token long, sig long, n int, at int")

    def _by_list(self, lists: DataFrame) -> DataFrame:
        return lists.repartition("token").sortWithinPartitions("token")

    def _read(self, pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
        """pairs with the tokens x and y of the sets that a and b name; sets not read before are made from their texts."""
        need = pairs.select(F.col(a).alias("sig")).union(pairs.select(b)).distinct()
        for t in self.tokens:
            need = need.join(t.select("sig"), "sig", "left_anti")
        wanted = need.join(self.classes, "sig").select("sig", "rk")
        texts = self.rows.select("rk", "text").join(wanted.hint("merge"), "rk").dropDuplicates(["sig"]).select("sig", "text")
        k = self.shingle
        self.tokens.append(self.scratch.save(texts.mapInArrow(lambda it: _tokens(it, k), "sig long, tokens binary"), f"{name}-tokens"))
        every = self.tokens[0]
        for t in self.tokens[1:]:
            every = every.unionByName(t)
        one = pairs.hint("merge").join(every.select(F.col("sig").alias(a), F.col("tokens").alias("x")), a)
        return one.hint("merge").join(every.select(F.col("sig").alias(b), F.col("tokens").alias("y")), b)

    def _members(self) -> DataFrame:
        """(hub, sig, hub_n, lacks, more): every set that has a hub, and the hubs themselves."""
        met = self._by_list(self.lists).mapInArrow(_leaders, MET).groupBy("a", "b").agg(F.sum("meets").alias("meets"))
        met = self.scratch.save(met, "met")
        weight = self.scratch.save(met.groupBy("b").agg(F.count("*").alias("weight")), "weight")
        rank = F.struct(F.coalesce("weight", F.lit(0)).alias("weight"), F.col("b").alias("sig"))
        ranked = met.join(weight, "b").select("a", rank.alias("to")).join(weight.select(F.col("b").alias("a"), F.col("weight").alias("own")), "a", "left")
        higher = ranked.where(F.col("to") > F.struct(F.coalesce("own", F.lit(0)).alias("weight"), F.col("a").alias("sig")))
        chosen = self.scratch.save(higher.groupBy("a").agg(F.max("to").getField("sig").alias("b")), "chosen")
        second = chosen.join(chosen.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"), F.lit(2).alias("rank"))
        tried = chosen.withColumn("rank", F.lit(1)).unionByName(second).select(F.col("a").alias("sig"), F.col("b").alias("hub"), "rank")
        sketch = self.classes.select("sig", "sketch")
        tried = tried.join(sketch, "sig").join(sketch.select(F.col("sig").alias("hub"), F.col("sketch").alias("own")), "hub")
        tried = self.scratch.save(tried.select("sig", "hub", "rank", "sketch", "own").mapInArrow(_promising, "sig long, hub long, rank int"), "tried")
        read = self._read(tried, "sig", "hub", "hubs").select("sig", "hub", "rank", "x", "y")
        near = self.scratch.save(read.mapInArrow(_differences, "sig long, hub long, rank int, hub_n int, lacks binary, more binary"), "near")
        own = near.join(near.select(F.col("sig").alias("hub")).distinct(), "hub", "left_anti")
        own = own.groupBy("sig").agg(F.max_by(F.struct("hub", "hub_n", "lacks", "more"), "rank").alias("m")).select("sig", "m.*")
        empty = F.lit(b"")
        hubs = own.groupBy("hub").agg(F.first("hub_n").alias("hub_n")).select(F.col("hub").alias("sig"), "hub", "hub_n", empty.alias("lacks"), empty.alias("more"))
        return self.scratch.save(own.unionByName(hubs), "members")

    def _inside(self, pairs: bool) -> DataFrame:
        """Links among members of one hub (see _solved)."""
        size = F.sum(F.length("lacks") + F.length("more"))
        blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
        groups = self.members.groupBy("hub").agg(blocks.alias("blocks"))
        dealt = self.members.join(groups, "hub").join(self.classes.select("sig", "copies"), "sig")
        block = F.pmod(F.xxhash64("sig"), "blocks").cast("int")
        dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        keys = ["hub", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
        dealt = dealt.select(*keys, "block", "sig", "copies", "hub_n", "lacks", "more")
        percent = self.percent
        return dealt.repartition("hub", "lo", "hi").sortWithinPartitions("hub", "lo", "hi").mapInArrow(lambda it: _solved(it, percent, pairs), "a long, b long, links long")

    def _outside(self) -> DataFrame:
        """The links (a, b) of sets that do not share a hub."""
        lists = self.lists.withColumn("hub", F.col("sig"))
        if self.members is not None:
            named = self.lists.join(self.members.select("sig", "hub"), "sig", "left")
            lists = named.select("token", "sig", "n", "at", F.coalesce("hub", "sig").alias("hub"))
        percent = self.percent
        met = self._by_list(lists).mapInArrow(lambda it: _crossing(it, percent), MET)
        pairs = met.groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("meets").alias("meets")).where("meets >= need").select("a", "b")
        read = self._read(self.scratch.save(pairs, "pairs"), "a", "b", "pairs").select("a", "b", "x", "y")
        return self.scratch.save(read.mapInArrow(lambda it: _verified(it, percent), "a long, b long"), "outside")

    def links(self) -> DataFrame:
        """All pairs (a, b), a < b, of linked sets."""
        out = self._outside()
        if self.members is not None:
            out = out.unionByName(self._inside(True).select("a", "b"))
        return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def components(self) -> DataFrame:
        outside = self._outside()
        both = outside.unionByName(outside.select(F.col("b").alias("a"), F.col("a").alias("b")))
        counts = both.join(self.classes.select(F.col("sig").alias("b"), "copies"), "b").select(F.col("a").alias("sig"), F.col("copies").alias("links"))
        edges = outside
        if self.members is not None:
            inside = self.scratch.save(self._inside(False), "inside")
            counts = counts.unionByName(inside.select(F.col("a").alias("sig"), "links"))
            edges = edges.unionByName(inside.select("a", "b"))
        roots = components(edges, self.scratch, "all")
        counts = counts.groupBy("sig").agg(F.sum("links").alias("links"))
        owned = self.classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        least = owned.groupBy("root").agg(F.min("smallest").alias("component_id"))
        named = owned.join(least, "root").join(counts, "sig", "left")
        named = named.select("sig", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        named = self.scratch.save(named, "named")
        self.scratch.drop_others("about", "named")
        return self.about.join(named, "sig", "left")


def similar_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, hubs: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, n_links, set_id, row_key (equal for rows of equal doc_id and text).

    docs has doc_id and text; other columns are ignored. A set: the distinct runs of ``shingle`` words (lower-cased A-Z,
    split at white space), of a text with fewer words its whole run, of a null, empty or blank text nothing. Two documents
    are linked when 100 * intersection >= percent * union; empty sets are linked with nothing, not even each other.
    component_id is the smallest doc_id reachable by links, itself included; n_links is the number of other rows that the
    row is linked with; set_id is equal for equal sets (0: empty). Rows that share a doc_id are rows of their own in the
    links. A null doc_id stands before all others and is the id of its component. Repeated rows get equal results. Without
    ``hubs`` (tests) all pairs come from the lists.
    """
    found = _Join(docs, shingle, percent, hubs).components()
    return found.select(
        F.when(F.col("doc_id") != LOWEST, F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.coalesce("component_id", "doc_id") != LOWEST, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("sig").alias("set_id"),
        F.col("rk").alias("row_key"),
    )


def similar_sets(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): every pair of different linked sets, by the set_id that similar_components gives their documents. Copies are
    not expanded. Handles rows as similar_components does."""
    return _Join(docs, shingle, percent, True).links()


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, that stay when one document of each component does: the one of the
    smallest doc_id (and row key, where several have it). Documents without words all stay; rows of equal doc_id and text
    are one document."""
    found = similar_components(docs, shingle, percent)
    filled = F.col("n_shingles") > 0
    group = [filled.alias("filled"), F.col("component_id"), F.when(filled, 0).otherwise(F.col("row_key")).alias("own")]
    first = found.groupBy(*group).agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
    name = unused(docs, "row_key")
    stay = first.select(F.col("first.row_key").alias(name)).distinct()
    kept = docs.withColumn(name, row_key()).join(stay, name, "left_semi")
    return kept.dropDuplicates([name]).select(*docs.columns)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links for every row of documents."""
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("set_id", "row_key")
