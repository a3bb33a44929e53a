"""Near-duplicate texts by SimHash, searched with vantage-point trees.

Fingerprints have 64 bits; two link at ``radius`` or fewer differing bits. The bits
are cut into segments. Two linked fingerprints differ in at most
``radius // segments`` bits of one segment at least, so each segment gets a
vantage-point tree of its own over the Hamming distance of its bits, searched with
that smaller radius. Distances of a few bits lie well apart there, which is what
makes the triangle bounds prune; one tree over all 64 bits hardly prunes at radius
4. Leaves are shards: a fingerprint is at home in one leaf of each tree and visits
the leaves its ball reaches over a boundary. Inside a leaf all 64 bits are compared.

Only distinct fingerprints are searched, a leaf puts out a star for each group it
finds and never its pairs, and a leaf that outgrows a task is compared in blocks.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.registries import components
from ..runtime import materialize
from . import textbytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 4
RADIUS = 4
SEGMENTS = 3
SEED = 42
# Fingerprints the trees are fitted on; every fingerprint is indexed.
FIT_SAMPLE = 16384
# Home fingerprints a leaf should hold, and levels of a tree at most.
LEAF = 256
LEVELS = 12
# Rows of one comparison inside a task: homes by rows.
BLOCK_HOME, BLOCK_ALL = 4096, 16384


def shingle_hashes(text: bytes, words: int = WORDS) -> list[int]:
    """XXH64 of each run of ``words`` words, repeats included."""
    parts = text.lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(parts) - words, 0)
    first, stop = starts[: last + 1].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(first, stop)]


def fingerprints(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """SimHash of each text as unsigned 64-bit numbers; without words zero."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    hashes, owners, held = [], [], 0

    def settle():
        nonlocal hashes, owners, held
        if not owners:
            return
        flat = np.concatenate(hashes)
        sizes = np.array([len(h) for h in hashes])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[owners] = ((ones * 2 > sizes[:, None]) * weights).sum(axis=1, dtype=np.uint64)
        hashes, owners, held = [], [], 0

    for i, text in enumerate(texts):
        found = shingle_hashes(text, words)
        if len(found) > 100_000:
            ones = np.zeros(64, np.int64)
            for a in range(0, len(found), 100_000):
                part = np.array(found[a : a + 100_000], dtype="<u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = ((ones * 2 > len(found)) * weights).sum(dtype=np.uint64)
        elif found:
            hashes.append(np.array(found, dtype=np.uint64))
            owners.append(i)
            held += len(found)
            if held > 50_000:
                settle()
    settle()
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, fp)``: fp is the signed reading of the 64 bits. A null text has no words."""

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in textbytes.pieces(batch.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                fps = fingerprints(texts, words).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(fps)], names=["doc_id", "fp"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _masks(segments: int) -> list[int]:
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _distance(a: np.ndarray, b, mask: int) -> np.ndarray:
    return np.bitwise_count((a ^ b) & np.uint64(mask)).astype(np.int16)


def fit_tree(sample: np.ndarray, mask: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """``(vantage, middle)`` of a full binary tree; node n has children 2n+1 and 2n+2.

    A vantage point is the first of its node's sample, in hash order; the middle
    is the distance that parts the others most evenly. A node without a sample
    sends everything left.
    """
    nodes = (1 << levels) - 1
    vantage, middle = np.zeros(nodes, np.uint64), np.full(nodes, 64, np.int16)
    held = {0: sample}
    for n in range(nodes):
        own = held.pop(n, sample[:0])
        if len(own) < 2:
            continue
        vantage[n] = own[0]
        d = _distance(own, own[0], mask)
        counts = np.cumsum(np.bincount(d, minlength=65))
        middle[n] = int(np.argmin(np.abs(counts - len(own) / 2)))
        held[2 * n + 1], held[2 * n + 2] = own[d <= middle[n]], own[d > middle[n]]
    return vantage, middle


def route(fps: np.ndarray, tree: tuple[np.ndarray, np.ndarray], mask: int, levels: int, reach: int):
    """``(row, leaf, home)``: the leaf each row is at home in, and those it visits.

    A row at home left of a boundary visits the right side when its ball reaches
    it; a visitor follows both sides its ball reaches. Of two rows within reach
    one then meets the other in the other's home leaf.
    """
    vantage, middle = tree
    row = np.arange(len(fps))
    node = np.zeros(len(fps), np.int64)
    home = np.ones(len(fps), bool)
    for _ in range(levels):
        gap = _distance(fps[row], vantage[node], mask) - middle[node]
        left = gap <= 0
        over = np.where(left, gap > -reach, (gap <= reach) & ~home)
        own, other = np.where(left, 2 * node + 1, 2 * node + 2), np.where(left, 2 * node + 2, 2 * node + 1)
        row = np.concatenate((row, row[over]))
        node = np.concatenate((own, other[over]))
        home = np.concatenate((home, np.zeros(int(over.sum()), bool)))
    return row, node - ((1 << levels) - 1), home


def stars(homes: np.ndarray, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``(member, root)`` for rows linked to a home row, each group as a star."""
    rows = np.unique(np.concatenate((homes, rows)))
    homes = np.unique(homes)
    seeds = []
    for a in range(0, len(homes), 64):
        near = np.bitwise_count(homes[a : a + 64, None] ^ rows[None, :]) <= radius
        seeds.append(homes[a : a + 64][near.sum(axis=1) > 1])
    member, root = [], []
    rest, done = rows, set()
    for seed in np.concatenate(seeds).tolist() if seeds else []:
        if seed in done:
            continue
        group, front = [], np.array([seed], np.uint64)
        rest = rest[rest != np.uint64(seed)]
        while len(front):
            group.append(front)
            reached = np.zeros(len(rest), bool)
            for a in range(0, len(front), 64):
                open_ = np.flatnonzero(~reached)
                near = np.bitwise_count(front[a : a + 64, None] ^ rest[open_][None, :]) <= radius
                reached[open_[near.any(axis=0)]] = True
            front, rest = rest[reached], rest[~reached]
        group = np.concatenate(group)
        done.update(group.tolist())
        member.append(group)
        root.append(np.full(len(group), group.min()))
    none = np.zeros(0, np.uint64)
    return (np.concatenate(member), np.concatenate(root)) if member else (none, none)


def links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """``(fp, root)``: stars that join exactly the distinct ``fps`` within ``radius`` bits."""
    spark = fps.sparkSession
    total = fps.count()
    # A bounded sample in hash order fits the trees.
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(FIT_SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    levels = min(LEVELS, max(0, math.ceil(math.log2(max(1, total / LEAF)))))
    masks, reach = _masks(segments), radius // segments
    trees = [fit_tree(sample, mask, levels) for mask in masks]

    def assign(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(own), 4096):
                part = own[a : a + 4096]
                for t, (tree, mask) in enumerate(zip(trees, masks)):
                    row, leaf, home = route(part, tree, mask, levels, reach)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[row].view(np.int64)), pa.array(np.full(len(row), t, np.int32)),
                         pa.array(leaf.astype(np.int32)), pa.array(home)],
                        names=["fp", "tree", "leaf", "home"],
                    )

    placed = materialize(fps.select("fp").mapInArrow(assign, "fp long, tree int, leaf int, home boolean"), "vantage")
    # One row per leaf: at most segments * 2**LEVELS rows.
    sizes = placed.groupBy("tree", "leaf").agg(
        F.sum(F.col("home").cast("int")).alias("homes"), F.count("*").alias("rows")
    ).where("homes > 0").select(
        "tree", "leaf", F.ceil(F.col("homes") / BLOCK_HOME).cast("int").alias("nh"),
        F.ceil(F.col("rows") / BLOCK_ALL).cast("int").alias("na"),
    )
    known = placed.join(F.broadcast(sizes), ["tree", "leaf"])
    slot = F.xxhash64("fp")
    own = known.where("home").select(
        "fp", "tree", "leaf", F.lit(True).alias("home"), F.pmod(slot, "nh").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("j"),
    )
    every = known.where((F.col("nh") > 1) | (F.col("na") > 1) | ~F.col("home")).select(
        "fp", "tree", "leaf", F.lit(False).alias("home"),
        F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("i"), F.pmod(slot, "na").cast("int").alias("j"),
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        values, home = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool)
        member, root = stars(values[home], values[~home], radius)
        return pd.DataFrame({"fp": member.view(np.int64), "root": root.view(np.int64)})

    return own.unionByName(every).groupBy("tree", "leaf", "i", "j").applyInPandas(compare, "fp long, root long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = WORDS, radius: int = RADIUS, segments: int = SEGMENTS,
) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links. A null or empty text
    has fingerprint zero and links like any other; a null id never names a
    component unless all ids of it are null; repeated rows come back repeated.
    Other columns of ``docs`` are ignored.
    """
    marked = materialize(with_fingerprints(docs, id_col, text_col, words), "fingerprints")
    first = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = links(first, radius, segments)
    stars_ = materialize(found.unionByName(found.select(F.col("root").alias("fp"), "root")).distinct(), "stars")
    joined = components(stars_, node="fp", key="root")
    group = first.join(joined, "fp", "left").select("fp", "first", F.coalesce("cluster", "fp").alias("cluster"))
    named = group.groupBy("cluster").agg(F.min("first").alias("component_id"))
    return marked.join(group.join(named, "cluster").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the smallest id of each.

    One row of an id stays; rows without an id all stay, having no name to be
    chosen by.
    """
    near = near_duplicates(docs, words=words, radius=radius)
    stay = near.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id IS NULL"))
