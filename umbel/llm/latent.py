"""Benchmark passages in documents, found through a latent space and then checked.

Terms are the words of the benchmark. Their weights use document frequencies over
all documents. Passages of the benchmark, as TF-IDF rows, span a latent space by a
randomised SVD whose passes over the rows are Spark jobs. Windows of all documents
are projected into that space and compared with all items by cosine; the benchmark
is a stated query set, taken in blocks. Candidates are checked word by word: the
longest common subsequence of item and document within a span not much longer than
the item. A nearly whole item is a copy; a looser match counts as a paraphrase only
if the item's answer is there too.

Copies do not depend on the latent space or on how common their words are: runs of
three words shared by an item and a document are counted by where the item would
begin, and a place with as many as a copy must have is checked too.
"""

from __future__ import annotations

import sys
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize
from . import shipping, textbytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, STRIDE = 32, 16
RANK, EXTRA, POWER = 128, 16, 1
COSINE = 0.65
# Shares of an item's words in common that make a copy, or a paraphrase with its answer.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.75
# A matching span is at most this many times as long as the item.
STRETCH = 1.25
# Benchmark items compared at a time.
ITEM_BLOCK = 4096
# Words of the runs that find copies.
RUN = 3


def _mark() -> np.ndarray:
    mark = textbytes.letters_table()
    mark[48:58] = True
    return mark


def words(column: pa.Array):
    """``(first row, last row, row of each word, hash of each word)`` of a text column."""
    low, mark = textbytes.lower_table(), _mark()
    for first, last, data, offsets in textbytes.pieces(column):
        data = low[data]
        starts, ends = textbytes.word_spans(data, offsets, mark)
        yield first, last, np.searchsorted(offsets, starts, side="right") - 1, textbytes.Rolling(data).of(starts, ends)


def word_hashes(text: str) -> np.ndarray:
    for _, _, _, hashes in words(pa.array([text])):
        return hashes
    return np.zeros(0, np.uint64)


def answer_of(text: str) -> str:
    """The last sentence of an item, which holds its answer when no column does."""
    parts = [p for p in text.replace("!", ".").replace("?", ".").replace("\n", ".").split(".") if p.strip()]
    return parts[-1] if parts else text


def term_places(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """``doc_id, n_words, place, term``: where the benchmark's words stand, as packed 32-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known = shared.value
        for batch in batches:
            for first, last, row, hashes in words(batch.column(1)):
                count = np.bincount(row, minlength=last - first) if len(row) else np.zeros(last - first, np.int64)
                begin = np.cumsum(count) - count
                at = np.searchsorted(known, hashes)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == hashes[hit]
                hit = np.flatnonzero(hit)
                edge = np.searchsorted(row[hit], np.arange(last - first + 1))
                place = (hit - begin[row[hit]]).astype("<i4").tobytes()
                term = at[hit].astype("<i4").tobytes()
                cut = (4 * edge).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(count.astype(np.int64)),
                     pa.array([place[a:b] for a, b in zip(cut, cut[1:])], pa.binary()),
                     pa.array([term[a:b] for a, b in zip(cut, cut[1:])], pa.binary())],
                    names=["doc_id", "n_words", "place", "term"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, place binary, term binary")


def _flat(batch, n: int):
    """``(row of each occurrence, place, term)`` of a batch of ``term_places``."""
    place = [np.frombuffer(b, "<i4") for b in batch.column(2).to_pylist()]
    term = [np.frombuffer(b, "<i4") for b in batch.column(3).to_pylist()]
    sizes = np.array([len(p) for p in place], np.int64)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return np.repeat(np.arange(n), sizes), join(place), join(term)


def document_frequency(places: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """``(documents with each term, documents)`` over all rows."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            row, _, term = _flat(batch, batch.num_rows)
            pair = np.unique(row.astype(np.int64) * size + term)
            total += np.bincount(pair % size, minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for r in places.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out, places.count()


def _summed(rows: DataFrame, part, matrix: np.ndarray, band: int = 1024) -> np.ndarray:
    """Sum over all rows of the matrices ``part(terms, weights, matrix)`` gives for a batch, in bands of matrix rows."""
    shared = rows.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        total = None
        for batch in batches:
            made = part(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shared.value)
            total = made if total is None else total + made
        if total is not None:
            for i in range(0, len(total), band):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([total.shape[1]], pa.int32()), pa.array([total[i : i + band].tobytes()], pa.binary())],
                    names=["i", "width", "band"],
                )

    def add(pdf):
        return pdf.head(1).assign(band=np.sum([np.frombuffer(b) for b in pdf["band"]], axis=0).tobytes())

    schema = "i int, width int, band binary"
    found = rows.mapInArrow(run, schema).groupBy("i").applyInPandas(add, schema).collect()
    shared.destroy()
    out = [np.frombuffer(r["band"]).reshape(-1, r["width"]) for r in sorted(found, key=lambda r: r["i"])]
    return np.concatenate(out) if out else np.zeros((0, 0))


def randomised_svd(rows: DataFrame, size: int, rank: int = RANK, extra: int = EXTRA, power: int = POWER, seed: int = 7) -> np.ndarray:
    """Right singular vectors (terms by rank) of sparse ``rows`` (``terms array<int>, weights array<double>``).

    A random sketch of the term space is multiplied through the rows and back
    ``power + 1`` times; then the rows are seen in its range, where a small
    eigenproblem gives the vectors. Only terms-by-sketch matrices reach the driver.
    """
    width = min(rank + extra, size)
    sketch = np.random.default_rng(seed).standard_normal((size, width))

    def through(terms, weights, g):
        out = np.zeros(g.shape)
        for t, w in zip(terms, weights):
            # A row names a term once.
            t, w = np.array(t), np.array(w)
            out[t] += w[:, None] * (w @ g[t])[None, :]
        return out

    def within(terms, weights, q):
        seen = np.stack([np.array(w) @ q[np.array(t)] for t, w in zip(terms, weights)])
        return seen.T @ seen

    for _ in range(power + 1):
        made = _summed(rows, through, sketch)
        if not len(made):
            return np.zeros((size, 0))
        sketch, _ = np.linalg.qr(made)
    values, turn = np.linalg.eigh(_summed(rows, within, sketch))
    kept = np.argsort(-values)[: min(rank, int((values > 1e-9 * max(values.max(), 1e-300)).sum()))]
    return sketch @ turn[:, kept]


def common_subsequence(item: dict[int, int], size: int, terms: list[int]) -> int:
    """Length of the longest common subsequence, all of the item's words at once in the bits of a number."""
    full = (1 << size) - 1
    state = full
    for t in terms:
        match = item.get(t)
        if match:
            hit = state & match
            state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def _masks(terms: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, t in enumerate(terms):
        out[t] = out.get(t, 0) | (1 << i)
    return out


class Item:
    """An item's words and answer, ready for checking."""

    def __init__(self, item_id, terms: list[int], answer: list[int]):
        self.item_id, self.terms, self.answer = item_id, terms, answer
        self.masks, self.answer_masks = _masks(terms), _masks(answer)
        self.known = np.unique(terms)

    def best(self, place: np.ndarray, term: np.ndarray, begin: int, end: int):
        """``(words in common, answer words in common, first place)`` of the best span near a window."""
        n = len(self.terms)
        low, high = np.searchsorted(place, (begin - n, end + n))
        near, spots = term[low:high], place[low:high]
        mine = self.known[np.minimum(np.searchsorted(self.known, near), len(self.known) - 1)] == near
        near, spots = near[mine], spots[mine]
        # A span with fewer of its words has no match that counts.
        least = PARAPHRASE * n
        if len(near) < least:
            return 0, 0, 0
        span, found = int(np.ceil(STRETCH * n)) + 1, (0, 0, 0)
        begins = np.arange(int(spots[0]), int(spots[-1]) + 1, max(1, n // 8))
        lows, highs = np.searchsorted(spots, begins), np.searchsorted(spots, begins + span)
        for s, a, b in zip(begins.tolist(), lows.tolist(), highs.tolist()):
            if b - a <= found[0] or b - a < least:
                continue
            part = near[a:b].tolist()
            common = common_subsequence(self.masks, n, part)
            if common > found[0]:
                found = (common, common_subsequence(self.answer_masks, len(self.answer), part), s)
        return found


class Runs:
    """The items' runs of ``RUN`` words, or of all words of a shorter item, in the order of their codes."""

    def __init__(self, items: list[Item]):
        sizes = np.array([len(i.terms) for i in items], np.int64)
        self.sizes = sizes
        # A word of an item that is replaced breaks RUN runs at most.
        lost = np.floor((1 - COPY) * sizes + 1e-9).astype(np.int64)
        self.needed = np.maximum(sizes - RUN + 1 - RUN * lost, 1)
        self.tables = []
        for width in range(1, RUN + 1):
            mine = [i for i in range(len(items)) if min(len(items[i].terms), RUN) == width]
            codes = [run_codes(np.array(items[i].terms, np.int64), width) for i in mine]
            owner = np.repeat(np.array(mine, np.int64), [len(c) for c in codes])
            offset = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
            code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
            order = np.argsort(code, kind="stable")
            self.tables.append((code[order], owner[order], offset[order]))

    def places(self, row: np.ndarray, place: np.ndarray, term: np.ndarray):
        """``(row, item, first word)`` of every stretch of a row with the runs a copy of the item needs."""
        found = []
        for width, (codes, owner, offset) in enumerate(self.tables, 1):
            if not len(codes) or len(term) < width:
                continue
            n = len(term) - width + 1
            own = run_codes(term.astype(np.int64), width)
            whole = np.flatnonzero((row[:n] == row[width - 1 :]) & (place[width - 1 :] - place[:n] == width - 1))
            low = np.searchsorted(codes, own[whole], side="left")
            size = np.searchsorted(codes, own[whole], side="right") - low
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            here = np.repeat(whole, size)
            found.append((row[here], owner[at], place[here].astype(np.int64) - offset[at]))
        if not found:
            return []
        r, i, s = (np.concatenate(c) for c in zip(*found))
        if not len(r):
            return []
        out = set()
        # Begins that lost words shift by half an item at most lie in one block of one of the two rows of blocks.
        for shift in (0, 1):
            width = self.sizes[i]
            block = (s + width + shift * (width // 2)) // np.maximum(width, 1)
            order = np.lexsort((s, block, i, r))
            a, b, c = r[order], i[order], block[order]
            edge = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))))
            enough = edge[np.diff(np.append(edge, len(a))) >= self.needed[b[edge]]]
            out.update(zip(a[enough].tolist(), b[enough].tolist(), np.maximum(s[order][enough], 0).tolist()))
        return sorted(out)


def run_codes(terms: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` terms."""
    n = max(len(terms) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = textbytes.mix(out + terms[j : j + n].astype(np.uint64) + np.uint64(1))
    return out


MATCH = "doc_id long, item_id long, cosine double, common double, answer double, kind string, at long"


def search(places: DataFrame, items: list[Item], idf: np.ndarray, space: np.ndarray, cosine: float, after: ExitStack | None = None) -> DataFrame:
    """``MATCH`` rows for one block of items: checked matches, the best per document and item."""
    latent = space * idf[:, None]
    rows = np.stack([latent[i.terms].sum(axis=0) for i in items]) if items else np.zeros((0, space.shape[1]))
    rows = np.divide(rows, np.linalg.norm(rows, axis=1, keepdims=True), out=np.zeros_like(rows), where=np.linalg.norm(rows, axis=1, keepdims=True) > 0)
    shared = shipping.send(
        places.sparkSession, (items, latent.astype(np.float32), np.ascontiguousarray(rows.T, np.float32), Runs(items))
    )
    if after is not None:
        after.callback(shared.destroy)

    def position(present, wanted):
        """Row of each wanted stride, the last row for those without terms."""
        at = np.minimum(np.searchsorted(present, wanted), len(present) - 1)
        return np.where(present[at] == wanted, at, len(present))

    def run(batches):
        items_, terms_, targets, runs = shipping.receive(shared)
        names = [c.split()[0] for c in MATCH.split(", ")]
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                n = batch.num_rows
                doc, sizes = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                row, place, term = _flat(batch, n)
                if not len(row):
                    continue
                # Every text with a word has a window.
                count = np.maximum((sizes - 1) // STRIDE, (sizes > 0).astype(np.int64))
                owner = np.repeat(np.arange(n), count)
                begin = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
                base = np.cumsum(sizes + 2 * WINDOW) - (sizes + 2 * WINDOW)
                key = base[row] + place
                low, high = np.searchsorted(key, base[owner] + begin), np.searchsorted(key, base[owner] + begin + WINDOW)
                kept = np.flatnonzero(high > low)
                # A row has one stride more than windows.
                stride_base = np.cumsum(count + 1) - (count + 1)
                stride = stride_base[owner] + begin // STRIDE
                edge = np.searchsorted(row, np.arange(n + 1))
                best: dict[tuple[int, int], tuple] = {}

                def check(r, i, b, e, near):
                    item = items_[i]
                    own = slice(edge[r], edge[r + 1])
                    common, answer, at = item.best(place[own], term[own], b, e)
                    share, told = common / len(item.terms), answer / max(len(item.answer), 1)
                    if share < PARAPHRASE or (share < COPY and told < ANSWER):
                        return
                    if near is None:
                        a, z = np.searchsorted(place[own], (at, at + len(item.terms)))
                        span = terms_[term[own][a:z]].sum(axis=0)
                        near = float(span @ targets[:, i]) / max(float(np.linalg.norm(span)), 1e-9)
                    if (share, told, near, at) > best.get((r, i), (0,)):
                        best[r, i] = share, told, near, at

                for r, i, b in runs.places(row, place, term):
                    check(r, i, b, b + len(items_[i].terms), None)
                for c in range(0, len(kept), 2048):
                    mine = kept[c : c + 2048]
                    # Windows overlap by half, so sums are made per stride and added in pairs.
                    a, z = int(low[mine[0]]), int(high[mine[-1]])
                    own_stride = stride_base[row[a:z]] + place[a:z] // STRIDE
                    edges_ = np.flatnonzero(np.diff(own_stride, prepend=-1))
                    present = own_stride[edges_]
                    sums = np.zeros((len(present) + 1, terms_.shape[1]), np.float32)
                    np.add.reduceat(terms_[term[a:z]], edges_, axis=0, out=sums[:-1])
                    seen = sums[position(present, stride[mine])] + sums[position(present, stride[mine] + 1)]
                    length = np.linalg.norm(seen, axis=1)
                    near = seen @ targets
                    for w, i in zip(*np.nonzero(near >= cosine * np.maximum(length, 1e-9)[:, None])):
                        b = int(begin[mine[w]])
                        check(int(owner[mine[w]]), int(i), b, b + WINDOW, float(near[w, i] / max(length[w], 1e-9)))
                if best:
                    cols = list(zip(*[
                        (doc[r], items_[i].item_id, c, s, t, "copy" if s >= COPY else "paraphrase", at) for (r, i), (s, t, c, at) in sorted(best.items())
                    ]))
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(cols, types)], names=names)

    return places.mapInArrow(run, MATCH)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = COSINE, after: ExitStack | None = None) -> DataFrame:
    """``doc_id, item_id, cosine, common, answer, kind, at``: documents that hold an item, per row and item.

    ``common`` and ``answer`` are shares of the item's and its answer's words, ``at``
    the word where the best span begins. ``benchmark`` may have an ``answer`` column;
    else the last sentence is the answer. Items without words match nothing; null and
    empty texts hold nothing; repeated rows and repeated items are reported each.
    Other columns are ignored. ``after`` gets what removes the tables and copies of the
    items made here, to be run once the rows were read.
    """
    spark = docs.sparkSession
    columns = ["item_id", "text"] + (["answer"] if "answer" in benchmark.columns else [])
    # The stated query set: all items, in a fixed order.
    known = benchmark.select(*columns).where("text IS NOT NULL").orderBy("item_id", "text").collect()
    hashes = [word_hashes(r["text"]) for r in known]
    pairs = [(r, h) for r, h in zip(known, hashes) if len(h)]
    terms = np.unique(np.concatenate([h for _, h in pairs])) if pairs else np.zeros(0, np.uint64)
    if not len(terms):
        return spark.createDataFrame([], MATCH)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = materialize(term_places(rows, terms), "places")
    if after is not None:
        after.callback(discard, places)
    frequency, total = document_frequency(places, len(terms))
    idf = np.log((total + 1.0) / (frequency + 1.0)) + 0.1
    items = []
    for r, h in pairs:
        answer = (r["answer"] if "answer" in columns else None) or answer_of(r["text"])
        # Words of an answer that no item has stay in as words nothing matches.
        a = word_hashes(answer)
        at = np.searchsorted(terms, a)
        at = np.where((at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == a), at, -1)
        items.append(Item(r["item_id"], np.searchsorted(terms, h).tolist(), at.tolist()))
    passages = []
    for item in items:
        for a in range(0, max(len(item.terms) - STRIDE, 1), STRIDE):
            t, n = np.unique(item.terms[a : a + WINDOW], return_counts=True)
            w = n * idf[t]
            passages.append((t.tolist(), (w / max(np.linalg.norm(w), 1e-12)).tolist()))
    sparse = spark.createDataFrame(passages, "terms array<int>, weights array<double>")
    space = randomised_svd(sparse, len(terms), rank)
    found = [
        search(places, items[a : a + ITEM_BLOCK], idf, space, cosine, after) for a in range(0, len(items), ITEM_BLOCK)
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows without an id stay."""
    with ExitStack() as after:
        leaks = materialize(find_leaks(docs, benchmark, after=after).select("doc_id").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti")
