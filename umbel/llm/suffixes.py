"""Bytes of repeated long strings, found exactly.

Wanted are all bytes covered by a string of ``length`` bytes that starts anywhere
else too. The work is brought together by anchors: every window of that length is
marked by the place of its smallest gram hash, which depends on the window's bytes
alone, so equal windows have equal anchors at equal offsets. An anchor's context is
all that its own windows cover.

1. Anchors of all texts; those whose gram is met twice are repeated.
2. Repeated anchors with equal contexts: every window in them is repeated.
3. Contexts that share a gram but differ are laid out in shards. A shard builds its
   suffix array and Burrows-Wheeler transform and expands intervals breadth first
   by backward extension: prefixes common to neighbours come out by increasing
   length, and expansion stops at ``length``. Runs of rows never parted before are
   the repeated windows.
4. A gram with more differing contexts than a shard should hold is counted window
   by window instead, which needs no group in one place.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from . import textbytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200
# Long enough that common phrases and short shared lines are no repeated grams.
GRAM = 64
# Differing contexts of one gram that go to a shard; grams with more go window by window.
GROUP = 4096
SHARD_BYTES = 1_000_000
# Bytes of one text looked at together; pieces overlap by the window.
PIECE = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)


def _window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of every ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(key)
    blocks = -(-n // width)
    wide = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    wide[:n] = key
    grid = wide.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """``(places, gram hashes, first windows, last windows)`` of the anchors of all texts in ``data``.

    Grams are ordered by 40 bits of their hash and then by place, so a window's
    anchor follows from its bytes. The windows of an anchor follow one another.
    Windows across two texts are left out.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, np.zeros(0, np.uint64), none, none
    start = np.arange(len(data) - gram + 1)
    hashes = textbytes.Rolling(data).of(start, start + gram)
    least = _window_minima((hashes & ~_PLACE) | start.astype(np.uint64), length - gram + 1)
    cross = np.zeros(len(data) + 1, np.int32)
    edges = offsets[1:-1]
    np.add.at(cross, np.maximum(edges - length + 1, 0), 1)
    np.add.at(cross, edges, -1)
    window = np.flatnonzero(np.cumsum(cross)[: len(least)] == 0)
    place = (least[window] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else none
    last = np.concatenate((new[1:] - 1, [len(place) - 1])) if len(place) else none
    return place[new], hashes[place[new]], window[new], window[last]


def text_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """As ``anchors_of``; a text longer than a piece is cut into pieces that share no window."""
    if len(data) <= PIECE:
        return anchors_of(data, offsets, length, gram)
    found = []
    for i in range(len(offsets) - 1):
        text = data[offsets[i] : offsets[i + 1]]
        for a in range(0, max(len(text) - length + 1, 1), PIECE - length + 1):
            part = text[a : a + PIECE]
            place, hashes, first, last = anchors_of(part, np.array([0, len(part)]), length, gram)
            at = offsets[i] + a
            found.append((place + at, hashes, first + at, last + at))
    return tuple(np.concatenate(c) for c in zip(*found))


ANCHOR = "h long, c long, doc_id long, th int, low long, high long"


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``h, c, doc_id, th, low, high``: gram hash, context hash, text, and where the context begins and ends.

    A context is what the windows of the anchor cover. Its hash includes the
    anchor's place in it. ``th`` tells texts of one id apart.
    """

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            ids, marks = batch.column(0), batch.column(2)
            for begin, _, data, offsets in textbytes.pieces(batch.column(1)):
                place, hashes, first, last = text_anchors(data, offsets, length, gram)
                text = np.searchsorted(offsets, place, side="right") - 1
                high = last + length
                raw = data.tobytes()
                context = np.array(
                    [digest(raw[a:b], s) for a, b, s in zip(first.tolist(), high.tolist(), (place - first).tolist())], np.uint64
                )
                rows, base = pa.array(text + begin), offsets[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(context.view(np.int64)), ids.take(rows), marks.take(rows),
                     pa.array(first - base), pa.array(high - base)],
                    names=["h", "c", "doc_id", "th", "low", "high"],
                )

    return docs.select("doc_id", "text", "th").mapInArrow(run, ANCHOR)


def suffix_order(symbols: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least, by doubling.

    ``left`` is the number of bytes before a context's end; nothing beyond it is
    compared. Suffixes equal up to there keep no order.
    """
    n = len(symbols)
    # Sorting whole numbers is several times as fast as ordering by them, so a place
    # rides in the low bits of its key; 21 bits hold rank, next rank and place each.
    packed = n < (1 << 21)
    place = np.arange(n, dtype=np.uint64)
    wide = np.concatenate((symbols, np.zeros(5, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = (key << np.uint64(8)) | np.where(left > k, wide[k : n + k], 0).astype(np.uint64)
    covered, bits = 5, np.uint64(21)
    while True:
        if packed:
            ordered = np.sort((key << bits) | place)
            order = (ordered & np.uint64((1 << 21) - 1)).astype(np.int64)
            ordered >>= bits
        else:
            order = np.argsort(key)
            ordered = key[order]
        if covered >= depth:
            return order
        rank = np.zeros(n, np.uint64)
        rank[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
        follow = np.zeros(n, np.uint64)
        follow[: n - covered] = rank[covered:] + np.uint64(1)
        follow[left <= covered] = 0
        key = (rank << (bits if packed else np.uint64(32))) | follow
        covered *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each row with the one before, ``limit`` where it is that or longer.

    Intervals of rows that begin with the same string are extended backwards by one
    byte a round through the Burrows-Wheeler transform. A new interval that ends
    where no prefix is known yet sets it to the round's number and is extended in
    the next round; others have nothing new before them. A zero closes a context
    and is never extended over.
    """
    n = len(order)
    transform = symbols[order - 1]
    back = np.empty(n, np.int32)
    back[np.argsort(transform, kind="stable")] = np.arange(n, dtype=np.int32)
    prefix = np.full(n + 1, limit, np.int16)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    prefix[0] = prefix[n] = 0
    closing = np.flatnonzero(symbols[order] == 0)
    prefix[closing], unset[closing] = 0, False
    inner = transform != 0
    low, high = np.array([0], np.int32), np.array([n - 1], np.int32)
    for level in range(limit):
        if not len(low):
            break
        size = high - low + 1
        # Intervals of one row never part again.
        own = np.repeat(np.arange(len(low), dtype=np.int32), size)
        rows = np.arange(int(size.sum()), dtype=np.int32) + np.repeat((low - (np.cumsum(size) - size)).astype(np.int32), size)
        kept = inner[rows]
        rows, own = rows[kept], own[kept]
        if not len(rows):
            break
        ordered = np.sort((back[rows].astype(np.int64) << 32) | np.arange(len(rows)))
        target, by = (ordered >> 32).astype(np.int32), ordered & 0xFFFFFFFF
        own, mark = own[by], transform[rows[by]]
        part = np.flatnonzero((own[1:] != own[:-1]) | (mark[1:] != mark[:-1])) + 1
        low = target[np.concatenate(([0], part))]
        high = target[np.concatenate((part - 1, [len(target) - 1]))]
        fresh = unset[high + 1]
        low, high = low[fresh], high[fresh]
        prefix[high + 1], unset[high + 1] = level, False
    return prefix[:n]


def repeated_windows(texts: list[bytes], owners: np.ndarray, places: np.ndarray, length: int) -> list[np.ndarray]:
    """Per context, the offsets of its windows that start at another place too.

    ``owners`` and ``places`` say where each context begins: two contexts may hold
    the same bytes of one text, and those are no repetition.
    """
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    total = int(sizes.sum()) + len(texts)
    symbols = np.zeros(total, np.uint8)
    inside = np.ones(total, bool)
    inside[starts + sizes] = False
    # A zero closes a context; a zero in a text takes a value UTF-8 never has.
    raw = np.frombuffer(b"".join(texts), np.uint8)
    symbols[inside] = np.where(raw == 0, 255, raw)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    left = starts[owner] + sizes[owner] - np.arange(total)
    order = suffix_order(symbols, left, length)
    prefix = common_prefixes(symbols, order, length)
    # Only rows with a whole window can be repeated windows.
    same = (prefix >= length) & (left[order] >= length)
    same[1:] &= left[order[:-1]] >= length
    context = owner[order]
    offset = order - starts[context]
    group = np.cumsum(~same) - 1
    # The same bytes of the same text give one place.
    where = places[context] + offset
    first = np.flatnonzero(~same)
    spot = owners[context].astype(np.int64) * (1 << 40) + where
    low, high = np.minimum.reduceat(spot, first), np.maximum.reduceat(spot, first)
    hit = (low != high)[group] & (sizes[context] - offset >= length)
    by = np.lexsort((offset[hit], context[hit]))
    context, offset = context[hit][by], offset[hit][by]
    edge = np.searchsorted(context, np.arange(len(texts) + 1))
    return [offset[edge[i] : edge[i + 1]] for i in range(len(texts))]


def runs(offsets: np.ndarray, length: int) -> list[tuple[int, int]]:
    """``(from, to)`` runs covered by windows at ascending ``offsets``."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(offsets[1:] > offsets[:-1] + length)
    low = offsets[np.concatenate(([0], cut + 1))]
    high = offsets[np.concatenate((cut, [len(offsets) - 1]))] + length
    return list(zip(low.tolist(), high.tolist()))


SPAN = "doc_id long, th int, low long, high long"


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """``(spans, texts)``: repeated spans (may overlap), and the texts that can have any.

    ``docs`` is ``doc_id, th, text`` with ``th`` a hash of the text.
    """
    found = materialize(anchors(docs, length, gram), "anchors")
    twice = found.groupBy("h").count().where("count > 1").select("h")
    repeated = materialize(found.join(twice, "h"), "repeated")

    contexts = materialize(
        repeated.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "low", "high")).alias("one")),
        "contexts",
    )
    whole = contexts.where("n > 1").select("h", "c")
    spans = repeated.join(whole, ["h", "c"]).select("doc_id", "th", "low", "high")

    # Contexts that differ under one gram, each by one place that has it.
    differ = contexts.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    sample = contexts.join(differ, "h").select("h", (F.col("m") > GROUP).alias("hot"), F.col("n") > 1, "one.*").toDF(
        "h", "hot", "many", "doc_id", "th", "low", "high"
    )
    wanted = sample.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "hot", "many", "low", "high")).alias("wanted"))
    keys = repeated.select("doc_id", "th").distinct()
    lists = keys.alias("k").join(
        wanted.alias("w"), F.expr("k.doc_id <=> w.doc_id AND k.th = w.th"), "left"
    ).select("k.doc_id", "k.th", "wanted")
    joined = docs.alias("d").join(lists.alias("l"), F.expr("d.doc_id <=> l.doc_id AND d.th = l.th")).select(
        "d.doc_id", "d.th", "d.text", "wanted"
    )

    def cut(batches):
        """Texts as they are, and the bytes of the wanted contexts."""
        names = ["doc_id", "th", "text", "h", "hot", "many", "at", "context"]
        for batch in batches:
            n = batch.num_rows
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary())]
            text = batch.column(2).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, *none], names=names)
            rows, lists_ = [], batch.column(3)
            for i in range(n):
                wanted_ = lists_[i].as_py()
                if not wanted_:
                    continue
                raw, doc, th = text[i].as_py().encode(), batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for w in wanted_:
                    rows.append((doc, th, None, w["h"], w["hot"], w["many"], w["low"], raw[w["low"] : w["high"]]))
            if rows:
                types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    parted = materialize(
        joined.mapInArrow(cut, "doc_id long, th int, text string, h long, hot boolean, many boolean, at long, context binary"),
        "parted",
    )
    texts = parted.where("h IS NULL").select("doc_id", "th", "text")
    pieces = parted.where("h IS NOT NULL").drop("text")
    size = pieces.where("NOT hot").agg(F.sum(F.length("context"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))

    def expand(pdf: pd.DataFrame) -> pd.DataFrame:
        owners = pdf.groupby(["doc_id", "th"], dropna=False, sort=False).ngroup().to_numpy()
        hits = repeated_windows([bytes(c) for c in pdf["context"]], owners, pdf["at"].to_numpy(np.int64), length)
        out = []
        for doc, th, at, many, offsets in zip(pdf["doc_id"], pdf["th"], pdf["at"], pdf["many"], hits):
            # The windows of a context met twice are all known already.
            if not many:
                out += [(doc, th, at + a, at + b) for a, b in runs(offsets, length)]
        frame = pd.DataFrame(out, columns=["doc_id", "th", "low", "high"])
        return frame.astype({"doc_id": "Int64"})

    shared = pieces.where("NOT hot").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).groupBy("shard").applyInPandas(
        expand, SPAN
    )

    def windows(batches):
        names = ["h", "w", "doc_id", "th", "low", "many"]
        for batch in batches:
            for i in range(batch.num_rows):
                raw, at = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                count = len(raw) - length + 1
                if count < 1:
                    continue
                w = np.array([xxhash.xxh3_64_intdigest(raw[k : k + length]) for k in range(count)], np.uint64).view(np.int64)
                kinds = ((0, pa.int64()), (3, pa.int64()), (4, pa.int32()), (5, pa.bool_()))
                same = [pa.array([batch.column(c)[i].as_py()] * count, t) for c, t in kinds]
                yield pa.RecordBatch.from_arrays(
                    [same[0], pa.array(w), same[1], same[2], pa.array(at + np.arange(count)), same[3]],
                    names=names,
                )

    hot = pieces.where("hot").select("h", "context", "at", "doc_id", "th", "many")
    each = materialize(
        hot.mapInArrow(windows, "h long, w long, doc_id long, th int, low long, many boolean"), "windows"
    )
    often = each.groupBy("h", "w").agg(F.count("*").alias("n")).where("n > 1").select("h", "w")
    # The windows of a context met twice are all known already.
    single = each.where("NOT many").join(often, ["h", "w"]).select("doc_id", "th", "low", (F.col("low") + length).alias("high"))
    return spans.unionByName(shared).unionByName(single), texts


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the kept bytes, per row.

    A null text is empty; texts shorter than ``length`` lose nothing. Rows repeated
    whole repeat each other and lose all their long strings. ``kept`` is null where
    nothing was removed or ``keep_bytes`` is off. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text).alias("th"), text.alias("text"))
    spans, texts = repeated_spans(rows, length, gram)
    lists = spans.distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    lists = materialize(lists, "spans")
    touched = texts.alias("t").join(lists.alias("s"), F.expr("t.doc_id <=> s.doc_id AND t.th = s.th")).select(
        "t.doc_id", "t.text", "spans"
    )

    def drop(batches):
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py().encode()
                spans_ = batch.column(2)[i]
                bounds = np.array([[s["low"], s["high"]] for s in spans_.as_py()], np.int64)
                bounds = bounds[np.argsort(bounds[:, 0], kind="stable")]
                reached = np.maximum.accumulate(bounds[:, 1])
                new = np.concatenate(([True], bounds[1:, 0] > reached[:-1]))
                low = bounds[new, 0]
                high = reached[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(reached) - 1]))]
                edges = [0, *np.stack((low, high), 1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((
                    batch.column(0)[i].as_py(), len(raw), len(raw) - len(kept), len(low),
                    hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None,
                ))
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names)

    changed = touched.mapInArrow(drop, RESULT)
    plain = rows.select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"))
    same = plain.alias("p").join(
        lists.select("doc_id", "th").alias("s"), F.expr("p.doc_id <=> s.doc_id AND p.th = s.th"), "left_anti"
    ).select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        "kept_sha256", F.lit(None).cast("binary").alias("kept"),
    )
    return changed.unionByName(same)
