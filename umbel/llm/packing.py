"""Shards of documents by best-fit-decreasing packing of indivisible groups.

Documents of equal text are one group. Groups enter by falling size, each the shard
with the least room that still holds it, found in a balanced tree over the room left;
where none does, a new shard opens. What the packer needs is the number of groups of
each size, no more: groups of one size are alike, so they enter together. Sizes that
differ add up to the bytes of all groups, hence there are at most sqrt(2 * bytes) of
them: a few million for 100 TB, and as a rule as many as there are text lengths. They
are all that the driver reads, 16 bytes each; groups and documents stay in Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import row_index
from ..runtime import broadcast_if_small, materialize

PLAN = ["group_size", "low", "high", "shard"]
# Sizes turned into Python numbers at a time.
STEP = 65_536


class Classes:
    """``(size, number of groups)`` by falling size, 16 bytes for each size."""

    def __init__(self, sizes: np.ndarray, numbers: np.ndarray):
        self.sizes, self.numbers = sizes, numbers

    def __iter__(self) -> Iterator[tuple[int, int]]:
        for at in range(0, len(self.sizes), STEP):
            yield from zip(self.sizes[at : at + STEP].tolist(), self.numbers[at : at + STEP].tolist())


class RoomTree:
    """AVL tree of ``(room, shard)``, to take out the least room that is enough."""

    __slots__ = ("top",)

    def __init__(self):
        self.top = None

    # A node is [key, left, right, height].
    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _fix(self, node) -> None:
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))

    def _turn(self, node, side: int):
        up = node[side]
        node[side], up[3 - side] = up[3 - side], node
        self._fix(node)
        self._fix(up)
        return up

    def _level(self, node):
        self._fix(node)
        lean = self._height(node[1]) - self._height(node[2])
        if abs(lean) < 2:
            return node
        side = 1 if lean > 0 else 2
        if self._height(node[side][3 - side]) > self._height(node[side][side]):
            node[side] = self._turn(node[side], 3 - side)
        return self._turn(node, side)

    def add(self, room: int, shard: int) -> None:
        path, node, key = [], self.top, (room, shard)
        while node:
            side = 1 if key < node[0] else 2
            path.append((node, side))
            node = node[side]
        self._climb(path, [key, None, None, 1])

    def _climb(self, path, below) -> None:
        for node, side in reversed(path):
            node[side] = below
            below = self._level(node)
        self.top = below

    def take(self, room: int) -> tuple[int, int] | None:
        """Remove and return the smallest entry of at least ``room``, if any."""
        path, node, best = [], self.top, None
        while node:
            if node[0][0] >= room:
                best = len(path)
                path.append((node, 1))
                node = node[1]
            else:
                path.append((node, 2))
                node = node[2]
        if best is None:
            return None
        found, path = path[best][0], path[:best]
        key = found[0]
        if found[1] and found[2]:
            # The next larger entry takes the place of the one removed.
            path.append((found, 2))
            node = found[2]
            while node[1]:
                path.append((node, 1))
                node = node[1]
            found[0], below = node[0], node[2]
        else:
            below = found[1] or found[2]
        self._climb(path, below)
        return key


def best_fit(classes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """``(size, low, high, shard)``: which groups of a size go to which shard.

    ``classes`` has ``(size, number of groups)`` by falling size. A group larger than
    ``capacity`` has a shard of its own. Once ``most`` shards would not do, the last
    row has shard -1 and packing ends.
    """
    tree, shards = RoomTree(), 0
    for size, number in classes:
        low = 0
        while low < number:
            entry = tree.take(size)
            if entry is None:
                if most is not None and shards >= most:
                    yield size, low, number, -1
                    return
                entry, shards = (max(capacity, size), shards), shards + 1
            room, shard = entry
            # The shard stays the tightest for this size as long as it holds another.
            here = min(number - low, room // size) if size else number - low
            yield size, low, low + here, shard
            tree.add(room - here * size, shard)
            low += here


def capacity_for(classes: Iterable[tuple[int, int]], shards: int) -> int:
    """A capacity near the least at which ``best_fit`` needs ``shards`` shards at most.

    Groups larger than an equal part have shards of their own, the rest is parted
    equally. From there the excess doubles until all groups fit.
    """
    rest, left = sum(s * n for s, n in classes), shards
    part = -(-rest // left) if left else 0
    for size, number in classes:
        for _ in range(number):
            if left <= 1 or size <= part:
                break
            rest, left = rest - size, left - 1
            part = -(-rest // left)
        if left <= 1 or size <= part:
            break
    excess = 0
    while any(shard < 0 for *_, shard in best_fit(classes, part + excess, shards)):
        excess = max(2 * excess, part >> 20, 1)
    return part + excess


def shard_documents(
    docs: DataFrame, shards: int | None = None, capacity: int | None = None, overhead: int = 8,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, shard_bytes)`` of every row.

    Either ``capacity``: as few shards of that many bytes as best-fit-decreasing
    finds; or ``shards``: that many, their bytes as near equal as groups allow.
    A size is the UTF-8 bytes of the text and ``overhead``. Rows of equal text share
    a shard; a group larger than the capacity has one to itself. Slots count from 0
    by id inside a shard (null ids first, then by text). A null text is an empty one,
    repeated rows count each, an empty table gives no rows, other columns are ignored.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give shards or capacity")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"),
        ),
        "sizes",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("group_size"))
    placed = materialize(row_index(groups, ["group_size", "group"], ["group_size"]).drop("total"), "groups")
    counts = placed.groupBy("group_size").agg(F.count("*").alias("n")).orderBy(F.desc("group_size")).toArrow()
    classes = Classes(counts.column("group_size").to_numpy(), counts.column("n").to_numpy())
    if capacity is None:
        capacity = capacity_for(classes, shards)
    # Numbers only, four for each row of the plan.
    flat = np.fromiter(chain.from_iterable(best_fit(classes, capacity)), np.int64).reshape(-1, 4)
    plan = docs.sparkSession.createDataFrame(pa.table(list(flat.T), names=PLAN))
    plan = materialize(plan.withColumn("shard", F.col("shard").cast("int")), "plan")
    side, _ = broadcast_if_small(plan)
    inside = (F.col("row_index") >= F.col("low")) & (F.col("row_index") < F.col("high"))
    homes = placed.join(side, "group_size").where(inside).select("group", "shard")
    dealt = row_index(rows.join(homes, "group"), ["shard", "doc_id", "group"], ["shard"])
    sums = plan.groupBy("shard").agg(F.sum(F.col("group_size") * (F.col("high") - F.col("low"))).alias("shard_bytes"))
    bytes_side, _ = broadcast_if_small(sums)
    return dealt.join(bytes_side, "shard").select(
        "doc_id", "size", "text_crc32", "shard", F.col("row_index").alias("slot"), "shard_bytes"
    )
