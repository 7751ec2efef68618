"""Arrow batches in pieces of bounded size, so that what a Python worker holds at once doesn't follow the rows of a batch."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Text bytes that one step of a Python worker handles at once.
SLICE_BYTES = 2_000_000


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in order, in pieces of about limit bytes of the column at place `text`, one row at least."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start)


def release_memory() -> None:
    """Gives this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in some C libraries
    if trim:
        trim(0)


def in_slices(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over slices of its batches. Free memory goes back after each batch and at the end, as a worker is used again and
    its allocators would keep the most that each batch took."""

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from slices(iter([batch]), text)
            del batch
            release_memory()

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(given(batches))
        finally:
            release_memory()

    return wrapped
