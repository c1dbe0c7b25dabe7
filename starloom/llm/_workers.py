"""What a Python worker keeps between tasks, and slices of batches.

Workers are used again by stages of any operator. So one large object is kept at a
time: building another one lets the former go and gives its memory back.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time.
STEP_BYTES = 2_000_000

_held: dict[Any, Any] = {}


def give_back() -> None:
    """Return freed memory to the system, where the allocators can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # no GNU C library: its memory stays with the process
        return


def only(key: Any, build: Callable[[], Any]) -> Any:
    """The object under ``key``, built if it isn't the one that this worker holds."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = build()
        give_back()
    return _held[key]


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """``run`` for a stage whose object is kept; what else the task used is given back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """``run`` for a stage that keeps nothing: the worker holds nothing meanwhile, and what the task used is given back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        if _held:
            _held.clear()
            give_back()
        yield from run(batches)
        give_back()

    return task


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and its offsets into them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def steps(batches: Iterable[pa.RecordBatch], text: int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
        offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
