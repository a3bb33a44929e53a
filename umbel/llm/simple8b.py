"""Token ids in word-aligned blocks, and the table of files that holds them.

Format of one row of the files (Parquet is the container: it commits whole files
and works on any store):

``part``        number of the id range, ascending with ``doc_id``
``segment``     number of the row in its part; segments hold whole documents
``doc_ids``     ids of the documents in order
``doc_tokens``  token count of each
``n_ids``       ids in the segment
``words``       little-endian unsigned 64-bit words
``blocks``      little-endian unsigned 32-bit: index of the first word of every
                block of ``BLOCK`` ids, so that any block decodes alone

A word has a 4-bit selector on top. Selectors 0 to 13 pack 60 down to 1 values of
1 to 60 bits, selector 14 marks an escape (the next word holds one value of up to
64 bits), selector 15 a run of 120 zeros. No word crosses a block; the last word of
a block is filled with zeros, which the id count cuts off.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4096
# Fixed values of the format: values per word and bits per value, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 120])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64, 0])
ESCAPE, ZEROS = 14, 15


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits each value needs; by the exponent of a double where that is exact."""
    if len(ids) and int(ids.max()) >> 53:
        width = np.zeros(len(ids), np.int8)
        rest = ids.copy()
        while rest.any():
            width += rest > 0
            rest >>= np.uint64(1)
        return width
    exponent = (ids.astype(np.float64).view(np.int64) >> 52) - 1022
    return np.maximum(exponent, 0).astype(np.int8)


def _steps(width: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(selector, values taken)`` of the fullest packing that may begin at each place.

    ``room`` is the number of ids left in the block; a word may run past it, its
    filling is zero.
    """
    n = len(width)
    selector, taken = np.full(n, ESCAPE, np.uint8), np.ones(n, np.int32)
    small_enough = np.cumsum(np.bincount(width, minlength=65))
    # From few values to many, so that the fullest one is written last.
    for s in (13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0, ZEROS):
        if not small_enough[BITS[s]]:
            continue
        if small_enough[BITS[s]] < COUNTS[s] and small_enough[BITS[s]] < int(room.min()):
            continue
        need = np.minimum(room, COUNTS[s])
        if small_enough[BITS[s]] == n:
            selector[:] = s
            taken = need
            continue
        over = np.zeros(n + 1, np.int32)
        np.cumsum(width > BITS[s], out=over[1:])
        fits = over[np.arange(n, dtype=np.int32) + need] == over[:-1]
        selector[fits] = s
        taken[fits] = need[fits]
    return selector, taken


def encode(ids: np.ndarray) -> tuple[bytes, bytes]:
    """``(words, blocks)`` of unsigned 64-bit values."""
    ids = np.asarray(ids, dtype=np.uint64)
    words, blocks, done = [], [], 0
    for at in range(0, len(ids), 8 * BLOCK):
        part, starts = _encode(ids[at : at + 8 * BLOCK])
        words.append(part)
        blocks.append(starts + done)
        done += len(part)
    if not words:
        return b"", b""
    return np.concatenate(words).astype("<u8").tobytes(), np.concatenate(blocks).astype("<u4").tobytes()


def _encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    place = np.arange(n, dtype=np.int32)
    room = np.minimum(BLOCK - place % BLOCK, n - place)
    selector, taken = _steps(_widths(ids), room)
    step, at, starts = taken.tolist(), 0, []
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    kind, left = selector[starts], room[starts]
    size = 1 + (kind == ESCAPE)
    slot = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    padded = np.concatenate((ids, np.zeros(120, np.uint64)))
    for s in np.unique(kind):
        mine = np.flatnonzero(kind == s)
        out = np.full(len(mine), np.uint64(s) << np.uint64(60), np.uint64)
        if s == ESCAPE:
            words[slot[mine] + 1] = ids[starts[mine]]
        elif s != ZEROS:
            first, whole = starts[mine], left[mine]
            short = bool((whole < COUNTS[s]).any())
            for k in range(COUNTS[s]):
                value = padded[first + k]
                if short:
                    value = value * (k < whole)
                out |= value << np.uint64(k * int(BITS[s]))
        words[slot[mine]] = out
    return words, slot[np.searchsorted(starts, np.arange(0, n, BLOCK))]


def decode(words: bytes, n: int) -> np.ndarray:
    """The first ``n`` values of a word sequence, selector by selector."""
    w = np.frombuffer(words, "<u8")
    kind = (w >> np.uint64(60)).astype(np.uint8)
    # The word after an escape is a value; its top bits are no selector. A word is
    # one exactly when an odd run of escape marks precedes it.
    mark = kind == ESCAPE
    if mark.any():
        value, after = np.zeros(len(w), bool), -1
        for i in np.flatnonzero(mark).tolist():
            if i != after:
                after = i + 1
                value[after] = True
        head = np.flatnonzero(~value)
    else:
        head = np.arange(len(w))
    kind = kind[head]
    count = COUNTS[kind].copy()
    return _unpack(w, head, kind, count, n)


def _unpack(w, head, kind, count, n):
    """Lay the values of the words ``head`` out in order; block ends cut the filling."""
    starts, at = np.empty(len(head), np.int64), 0
    ends = np.cumsum(count)
    if n <= BLOCK:
        starts = ends - count
    else:
        # Restart the running position at every block boundary.
        begin, done = 0, 0
        while begin < len(head):
            base = ends[begin - 1] if begin else 0
            room = min(BLOCK, n - done)
            last = int(np.searchsorted(ends, base + room, side="left"))
            starts[begin : last + 1] = ends[begin : last + 1] - count[begin : last + 1] - base + done
            begin, done = last + 1, done + room
    limit = np.minimum((starts // BLOCK + 1) * BLOCK, n)
    out = np.zeros(n + 120, np.uint64)
    for s in np.unique(kind):
        mine = np.flatnonzero(kind == s)
        if s == ZEROS:
            continue
        if s == ESCAPE:
            out[starts[mine]] = w[head[mine] + 1]
            continue
        width, mask = int(BITS[s]), np.uint64((1 << int(BITS[s])) - 1)
        body, first, stop = w[head[mine]], starts[mine], limit[mine]
        for k in range(COUNTS[s]):
            inside = first + k < stop
            out[(first + k)[inside]] = ((body >> np.uint64(k * width)) & mask)[inside]
    return out[:n]


def decode_block(words: bytes, blocks: bytes, n: int, block: int) -> np.ndarray:
    """One block alone, found through its offset."""
    offsets = np.frombuffer(blocks, "<u4")
    stop = int(offsets[block + 1]) if block + 1 < len(offsets) else len(words) // 8
    return decode(words[8 * int(offsets[block]) : 8 * stop], min(BLOCK, n - block * BLOCK))
