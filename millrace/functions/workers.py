"""Memory of Python workers. A worker outlives its task and stands beside the next stage with what allocators and caches keep."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def give_back() -> None:
    """Returns the worker's free memory to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def gives_back(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """work, a generator over a task's batches, after whose end the worker's free memory is given back."""

    @wraps(work)
    def run(*args, **options) -> Iterator:
        try:
            yield from work(*args, **options)
        finally:
            give_back()

    return run
