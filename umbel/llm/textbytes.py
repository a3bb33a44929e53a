"""Whole Arrow text columns as bytes: word spans and hashes without per-row Python.

Texts are taken as UTF-8 bytes. A word is a run of bytes a class table marks; its
hash depends on its bytes alone, so it is the same in every task and run.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes handled at a time inside a task; one longer text is taken alone.
SLICE_BYTES = 1024 * 1024

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type).cast(large)
    column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = buffers[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    base = int(offsets[0]) if len(offsets) else 0
    end = int(offsets[-1]) if len(offsets) else 0
    return data[base:end], offsets - base


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together, or one longer row."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def pieces(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row, bytes, offsets)`` for slices of a text column."""
    data, offsets = column_bytes(column)
    for first, last in slices(offsets, limit):
        own = offsets[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def letters_table() -> np.ndarray:
    """Letters and every byte of a longer UTF-8 sequence."""
    mark = np.zeros(256, bool)
    mark[65:91] = mark[97:123] = mark[128:] = True
    return mark


def word_spans(data: np.ndarray, offsets: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, ends)`` of runs of marked bytes; no run crosses a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = mark[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] |= inside[edges]
    end[edges - 1] |= inside[edges - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    power = np.full(n + 1, base, np.uint64)
    power[0] = 1
    return np.cumprod(power, out=power)


_KEPT: dict[str, np.ndarray] = {}


class Rolling:
    """Hashes of any spans of one byte array, in one pass over it."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if n > 2 * SLICE_BYTES:
            power, self.back = _powers(_BASE, n), _powers(_INVERSE, n)
        else:
            if "power" not in _KEPT:
                _KEPT["power"], _KEPT["back"] = (_powers(b, 2 * SLICE_BYTES) for b in (_BASE, _INVERSE))
            power, self.back = _KEPT["power"], _KEPT["back"]
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.back[starts])
