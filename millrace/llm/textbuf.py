"""Vectorised work on the bytes of many documents at once, for use inside Arrow tasks.

A chunk is the UTF-8 bytes of some consecutive rows laid end to end, with the offsets where rows begin. A row is
never cut, so a very long text makes a chunk of its own. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1


def _table(member) -> np.ndarray:
    return np.array([member(b) for b in range(256)], dtype=bool)


#: Bytes outside white space (space and 0x09 to 0x0D).
NOT_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of digits, lower-case letters and everything outside ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of its rows from 0) for runs of rows of at most ``limit`` bytes, or one row."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    rows = len(column)
    if not rows:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        end = min(end, rows)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


@lru_cache(maxsize=8)
def _powers(log: int, base: int) -> np.ndarray:
    out = np.full(1 << log, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i under n."""
    return _powers(max(16, int(n - 1).bit_length() if n > 1 else 0), base)[:n]


def forget() -> None:
    """Drops the powers that are kept between chunks."""
    _powers.cache_clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    x ^= x >> U64(31)
    return x


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal contents wherever they stand. values: non-negative integers."""
    n = len(values)
    sums = np.zeros(n + 1, U64)
    weighted = values.astype(U64)
    weighted += U64(1)
    weighted *= powers(n)
    np.cumsum(weighted, out=sums[1:])
    out = sums[end] - sums[start]
    out *= powers(n + 1, pow(BASE, -1, 1 << 64))[start]
    out ^= (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the end) of the maximal runs of member bytes inside rows."""
    n = len(data)
    inside = member[data]
    starts, ends = inside.copy(), inside.copy()
    if n:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        starts[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[i : i + k] for each i from 0 to len - k."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = values[:n].copy()
    for j in range(1, k):
        out *= U64(BASE)
        out += values[j : n + j]
    return mix(out)


def inside_rows(n: int, first: np.ndarray, k: int) -> np.ndarray:
    """Whether positions i to i + k - 1 lie in one row, for each i under n; first: where rows begin, and the end."""
    last = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + k <= last[:n]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i : i + width]) for each i from 0 to len - width, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out
