"""Whole columns of text to token ids with a word-level BPE file of ``tokenizers``.

The file's normaliser and pre-tokeniser cut a text into words that are encoded one
by one, so equal words have equal ids. Words of Latin-1 texts are found for a whole
slice at once, each distinct word goes to the library's model once per worker, and
ids are spread over the occurrences. A text with other characters, or with a
special token's string in it, goes to the library whole. Either way the ids are the
library's for the whole text.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from . import textbytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Distinct words a worker keeps; past it the table starts anew.
KEPT_WORDS = 3_000_000
# A longer word is compared by its bytes, never by its hash.
LONG_WORD = 64

_ENCODERS: dict[str, Encoder] = {}


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """Latin-1 characters: 0 space, 1 letter, 2 number, 3 other."""
    kind = np.full(256, 3, np.uint8)
    for c in range(256):
        ch = chr(c)
        if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0):
            kind[c] = 0
        elif ch.isalpha():
            kind[c] = 1
        elif ch.isnumeric():
            kind[c] = 2
    return kind


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for c in range(256):
        low = chr(c).lower()
        if len(low) == 1 and ord(low) < 256:
            table[c] = ord(low)
    return table


def _byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in a byte-level vocabulary."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """One tokenizer file, loaded once per worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        letters = _byte_letters()
        self.spell = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        ending = self.model.end_of_word_suffix or ""
        names = self.whole.get_vocab()
        # Bytes of text a token stands for: one per letter of its name.
        self.size_of = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.size_of[i] = len(name.removesuffix(ending))
        self.kind, self.low = _classes(), _lower()
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    @staticmethod
    def at(path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def word(self, raw: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.spell))]

    def _rows(self, hashes: np.ndarray, words) -> np.ndarray:
        """Rows of distinct word hashes; ``words(i)`` gives the bytes of an unseen one."""
        at = np.searchsorted(self.known, hashes)
        seen = at < len(self.known)
        seen[seen] = self.known[at[seen]] == hashes[seen]
        new = np.flatnonzero(~seen)
        if len(new):
            ids, counts = [], []
            for i in new.tolist():
                found = self.word(words(i))
                counts.append(len(found))
                ids += found
            counts = np.array(counts, np.int64)
            first = len(self.pool) + np.cumsum(counts) - counts
            self.pool = np.concatenate((self.pool, np.array(ids, np.int32)))
            place = np.searchsorted(self.known, hashes[new])
            self.known = np.insert(self.known, place, hashes[new])
            self.start = np.insert(self.start, place, first)
            self.count = np.insert(self.count, place, counts)
            at = np.searchsorted(self.known, hashes)
        return at

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(starts, ends)`` of the words of lowered Latin-1 bytes."""
        kind = self.kind[data]
        filled = kind != 0
        start = filled.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start |= edge[:-1] & filled
        # A short ending after an apostrophe that opens a word is a word of its own.
        for i in np.flatnonzero((data == 39) & start).tolist():
            tail = data[i + 1 : i + 3].tobytes()
            size = 2 if tail[:1] in (b"s", b"t", b"m", b"d") else 3 if tail in (b"re", b"ve", b"ll") else 0
            if size and not edge[i + 1 : i + size].any():
                start[i + 1] = False
                if i + size < len(data) and not edge[i + size] and kind[i + size] == 1:
                    start[i + size] = True
        end = filled.copy()
        end[:-1] &= start[1:] | ~filled[1:] | edge[1:-1]
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    def latin(self, data: np.ndarray, offsets: np.ndarray):
        """``(ids, word starts, tokens per word, tokens per text)`` of Latin-1 texts."""
        low = self.low[data]
        starts, ends = self._words(low, offsets)
        if len(self.known) > KEPT_WORDS:
            self.reset()
        hashes = textbytes.Rolling(low).of(starts, ends)
        long_ = np.flatnonzero(ends - starts > LONG_WORD)
        raw = low.tobytes()
        if len(long_):
            special = {w: self.word(w) for w in {raw[starts[i] : ends[i]] for i in long_.tolist()}}
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        rows = self._rows(unique, lambda i: raw[starts[first[i]] : ends[first[i]]])[inverse]
        count, begin = self.count[rows], self.start[rows]
        pool = self.pool
        if len(long_):
            extra, place = [], {}
            for w, found in special.items():
                place[w] = (len(pool) + len(extra), len(found))
                extra += found
            pool = np.concatenate((pool, np.array(extra, np.int32)))
            for i in long_.tolist():
                begin[i], count[i] = place[raw[starts[i] : ends[i]]]
        last = np.cumsum(count)
        total = int(last[-1]) if len(last) else 0
        take = np.repeat(begin - (last - count), count) + np.arange(total)
        upto = np.concatenate(([0], last))[np.searchsorted(starts, offsets)]
        return pool[take], starts, count, np.diff(upto)

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first row, last row, ids, tokens per row)`` over a text column, in order."""
        for first, last, data, offsets in textbytes.pieces(column):
            for a, b, latin in self._runs(data, offsets):
                part = data[offsets[a] : offsets[b]]
                if latin is not None:
                    ids, _, _, counts = self.latin(*latin)
                    yield first + a, first + b, ids, counts
                else:
                    ids = self.whole.encode(part.tobytes().decode(), add_special_tokens=False).ids
                    yield first + a, first + b, np.array(ids, np.int32), np.array([len(ids)])

    def _runs(self, data: np.ndarray, offsets: np.ndarray):
        """``(from, to, (Latin-1 bytes, offsets) or None)``: runs of texts for the fast way, single ones for the library."""
        def latin(a: int, b: int):
            raw = data[offsets[a] : offsets[b]]
            text = raw.tobytes()
            if b"<|" in text:
                return None
            if text.isascii():
                return raw, offsets[a : b + 1] - offsets[a]
            try:
                narrow = np.frombuffer(text.decode().encode("latin-1"), np.uint8)
            except UnicodeEncodeError:
                return None
            heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            return narrow, heads[offsets[a : b + 1] - offsets[a]]

        rows = len(offsets) - 1
        whole = latin(0, rows)
        if whole is not None:
            yield 0, rows, whole
            return
        begin = 0
        for i in range(rows):
            if latin(i, i + 1) is None:
                if begin < i:
                    yield begin, i, latin(begin, i)
                yield i, i + 1, None
                begin = i + 1
        if begin < rows:
            yield begin, rows, latin(begin, rows)
