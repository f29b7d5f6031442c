"""Tables of counts by hashed cell: each task fills its own, and only occupied cells are sent and summed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells of a table that are sent in one row.
SLICE = 1 << 16
#: Cells that a counter gathers before it adds them.
HELD = 1 << 21


class Counter:
    """Counts of cells, added in large batches."""

    def __init__(self, cells: int):
        self.counts, self.held, self.size = np.zeros(cells, np.int64), [], 0

    def add(self, cells: np.ndarray) -> None:
        self.held.append(cells)
        self.size += len(cells)
        if self.size >= HELD:
            self.done()

    def done(self) -> np.ndarray:
        if self.held:
            self.counts += np.bincount(np.concatenate(self.held), minlength=len(self.counts))
            self.held, self.size = [], 0
        return self.counts


COUNTS = "slice int, cells binary, counts binary, large binary"


def sliced(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Tables laid end to end and cut into slices of SLICE cells. A row has a slice's cells with a count, their counts in a
    byte each, and in full those of 255 and more; slices without a count are left out."""
    for base, counts in zip(_bases([len(t) for t in tables]), tables, strict=True):
        at = np.flatnonzero(counts)
        edges = np.searchsorted(at, np.arange(0, len(counts) + SLICE, SLICE))
        for k in np.flatnonzero(np.diff(edges)):
            cells = at[edges[k] : edges[k + 1]]
            n = counts[cells]
            row = [[base + int(k)], [(cells - k * SLICE).astype(np.uint16).tobytes()], [np.minimum(n, 255).astype(np.uint8).tobytes()], [n[n >= 255].astype(np.int64).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["slice", "cells", "counts", "large"])


def _bases(sizes: list[int]) -> list[int]:
    """First slice of each table."""
    return [sum(-(-n // SLICE) for n in sizes[:k]) for k in range(len(sizes))]


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Each slice that a task has and its counts; holds each slice once, however many rows there are."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            n = np.frombuffer(row["counts"], np.uint8).astype(np.int64)
            n[n == 255] = np.frombuffer(row["large"], np.int64)
            if row["slice"] not in sums:
                sums[row["slice"]] = np.zeros(SLICE, np.int64)
            sums[row["slice"]][np.frombuffer(row["cells"], np.uint16)] += n
    yield from sums.items()
