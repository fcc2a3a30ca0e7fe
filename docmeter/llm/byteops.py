"""Texts as bytes in numpy: slices of an Arrow column, runs of bytes of one class, and polynomial hashes of any substring.

A slice holds whole texts only; a text longer than the wished size makes a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: An odd multiplier has an inverse modulo 2**64, which makes prefix sums of powers usable for any substring.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_spread = np.random.RandomState(7).randint(1, 1 << 62, 256).astype(np.uint64)


def release() -> None:
    """Gives free memory back to the system: idle Python workers hold it else beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task for mapInArrow that releases its memory when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def frugal_group(task: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for applyInArrow on groups."""

    def run(group: pa.Table) -> pa.Table:
        try:
            return task(group)
        finally:
            release()

    return run


def frugal_pair(task: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for applyInArrow on cogroups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return task(left, right)
        finally:
            release()

    return run


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of successive slices of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def runs(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one class other than 0, none across texts: start, end, class and text number."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    kind = classes[data]
    change = np.empty(len(data), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(data))
    kept = kind[start] > 0
    start, end = start[kept], end[kept]
    return start, end, kind[start], np.searchsorted(offsets, start, side="right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit keys over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Substrings:
    """64-bit hashes of substrings [start, end) of one slice, in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.full(n + 1, BASE, np.uint64)
        power[0] = 1
        back = np.full(n + 1, INVERSE, np.uint64)
        back[0] = 1
        np.multiply.accumulate(power, out=power)
        self.back = np.multiply.accumulate(back, out=back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_spread[data] * power[:-1], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(self.raw(start, end))
