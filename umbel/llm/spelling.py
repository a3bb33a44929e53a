"""Spelling variants: words one edit apart, found with k-d trees over letter counts.

One replaced letter moves one count up and one down, one inserted letter moves one
count up. So the letter counts of two near words differ by two at most in L1, and a
query needs only the boxes of a k-d tree that one step up and one step down can
reach. There is one tree per word length: words of that length live in its leaves,
words of the same length and of one letter more are its queries. What the boxes
leave is compared letter by letter.

Trees are fitted on a bounded sample of the words; every word is indexed. A leaf is a
unit of work; a leaf that outgrows ``BLOCK`` words is dealt into blocks of its words
and of its queries, and each pair of blocks is a unit.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, discard, materialize
from .textbytes import lower_table, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words, about, that all trees together are fitted on, and words of a leaf aimed at.
SAMPLE = 65_536
LEAF = 8_192
# Words, and queries, a unit of work takes at most.
BLOCK = 65_536
# Counts of a-z; the other letters share the last six.
DIMS, PLAIN = 32, 26
# Signatures compared one with another at the bottom of a tree; pairs verified at a time.
BOTTOM = 48
PAIRS = 1 << 20

HOME, OWN, EQUAL, LONGER = range(4)
NO_CUT = 255


def _fold() -> np.ndarray:
    table = PLAIN + np.arange(256) % (DIMS - PLAIN)
    table[97:123] = np.arange(PLAIN)
    return table


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, letters)`` of runs of A-Z, a-z and U+00C0 to U+00FF.

    Those above ASCII are the two-byte sequences led by C3.
    """
    low = data | 32
    lead = data == 0xC3
    inside = ((low >= 97) & (low <= 122) & (data < 128)) | lead
    inside[1:] |= lead[:-1]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] |= inside[edges]
    finish[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    leads = np.concatenate(([0], np.cumsum(lead)))
    return starts, ends, ends - starts - (leads[ends] - leads[starts])


def _crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of spans, each going on from the crc32 of what precedes it."""
    table, out, sizes = _crc_table(), np.zeros(len(starts), np.uint32), ends - starts
    by_size = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[by_size], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(by_size)]):
        own, size = by_size[a:b], int(sizes[by_size[a]])
        if size > 64:
            for i in own:
                out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]))
            continue
        crc = ~state[own]
        for j in range(size):
            crc = table[(crc ^ data[starts[own] + j]) & 255] ^ (crc >> 8)
        out[own] = ~crc
    return out


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as a string column, their bytes gathered at once."""
    sizes = ends - starts
    stops = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    flat = data[np.repeat(starts - stops[:-1], sizes) + np.arange(stops[-1])]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(stops), pa.py_buffer(np.ascontiguousarray(flat)))


def word_counts(
    docs: DataFrame, least: int = 7, slip: int = 31, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(word, n)``: words of ``least`` letters or more, with their occurrences.

    A-Z are lower-cased, nothing else. Where ``slip`` divides ``h``, the crc32 of
    ``<id>:<word>``, the letter at ``h % length`` is left out (``slip`` 0: nowhere).
    A row without an id leaves nothing out; a null text has no words; repeated rows
    count again; an empty table gives no rows. Other columns are ignored.
    """

    def run(batches):
        lower = lower_table()
        for batch in batches:
            prefix = np.array([0 if i is None else zlib.crc32(b"%d:" % i) for i in batch.column(0).to_pylist()], np.uint32)
            known = np.array([i is not None for i in batch.column(0).to_pylist()], bool)
            found = []
            for first, last, data, offsets in pieces(batch.column(1)):
                data = lower[data]
                starts, ends, letters = _runs(data, offsets)
                long = letters >= least
                starts, ends, letters = starts[long], ends[long], letters[long]
                if not len(starts):
                    continue
                row = first + np.searchsorted(offsets, starts, side="right") - 1
                whole = np.ones(len(starts), bool)
                if slip:
                    h = _crc32(data, starts, ends, prefix[row])
                    whole = (h % np.uint32(slip) != 0) | ~known[row]
                    cut = []
                    for i in np.flatnonzero(~whole & (letters > least)):
                        word, at = data[starts[i] : ends[i]].tobytes().decode(), int(h[i]) % int(letters[i])
                        cut.append(word[:at] + word[at + 1 :])
                    found.append(pa.array(cut, pa.large_string()))
                found.append(_spans(data, starts[whole], ends[whole]))
            if found:
                counted = pc.value_counts(pa.concat_arrays(found))
                yield pa.RecordBatch.from_arrays([counted.field(0).cast(pa.string()), counted.field(1)], names=["word", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _matrix(words: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), size)


def _counts(letters: np.ndarray) -> np.ndarray:
    fold, rows = _fold(), np.arange(len(letters))
    counts = np.zeros((len(letters), DIMS), np.uint8 if letters.shape[1] < 256 else np.int64)
    for j in range(letters.shape[1]):
        counts[rows, fold[letters[:, j]]] += 1
    return counts


def _best_cut(counts: np.ndarray) -> tuple[int, int] | None:
    """The dimension and value that halve the rows best; none if all are equal."""
    best, found = len(counts), None
    for d in np.flatnonzero(counts.min(0) < counts.max(0)):
        values, n = np.unique(counts[:, d], return_counts=True)
        below = np.cumsum(n)[:-1]
        at = int(np.argmin(np.abs(2 * below - len(counts))))
        off = abs(int(2 * below[at]) - len(counts))
        if off < best:
            best, found = off, (int(d), int(values[at]))
    return found


def fit_tree(counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and cut of each inner node, in heap order."""
    dims, cuts = np.zeros(2**depth, np.int64), np.full(2**depth, NO_CUT, np.int64)
    held = {1: np.arange(len(counts))}
    for node in range(1, 2**depth):
        own = held.pop(node, None)
        cut = None if own is None or len(own) < 2 else _best_cut(counts[own])
        if cut is not None:
            dims[node], cuts[node] = cut
            right = counts[own, cut[0]] > cut[1]
            held[2 * node], held[2 * node + 1] = own[~right], own[right]
    return dims, cuts


def _descend(counts: np.ndarray, tree: tuple[np.ndarray, np.ndarray], up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, leaf)`` of all leaves that ``up`` steps up and ``down`` steps down reach.

    A cut lies strictly inside its node's box, so steps already taken are never
    asked for again.
    """
    dims, cuts = tree
    row, node = np.arange(len(counts)), np.ones(len(counts), np.int64)
    ups, downs = np.full(len(counts), up), np.full(len(counts), down)
    for _ in range(int(np.log2(len(dims)))):
        value, cut = counts[row, dims[node]].astype(np.int64), cuts[node]
        right = value > cut
        climbs, falls = ~right & (cut + 1 - value <= ups), right & (value - cut <= downs)
        near, over, under = 2 * node + right, 2 * node[climbs] + 1, 2 * node[falls]
        left_up, left_down = (ups - (cut + 1 - value))[climbs], (downs - (value - cut))[falls]
        row = np.concatenate((row, row[climbs], row[falls]))
        node = np.concatenate((near, over, under))
        ups, downs = np.concatenate((ups, left_up, ups[falls])), np.concatenate((downs, downs[climbs], left_down))
    return row, node - len(dims)


def _close(homes: np.ndarray, queries: np.ndarray, h: np.ndarray, q: np.ndarray, up: int, down: int, found: list) -> None:
    """Signature pairs within ``up`` steps up and ``down`` down, by a tree over ``homes``."""
    if not len(q) or not len(h):
        return
    cut = _best_cut(homes[h]) if len(h) > BOTTOM else None
    if cut is None:
        size = max(1, (1 << 22) // (len(h) * DIMS))
        for a in range(0, len(q), size):
            step = queries[q[a : a + size], None, :].astype(np.int16) - homes[None, h, :]
            far = np.abs(step).sum(2)
            shared = (far == 0) & (homes[h, PLAIN:].sum(1) > 0)[None] if up else False
            i, j = np.nonzero((far == up + down) | shared)
            found.append((h[j], q[a + i]))
        return
    d, c = cut
    right, value = homes[h, d] > c, queries[q, d].astype(np.int64)
    _close(homes, queries, h[~right], q[value <= c + down], up, down, found)
    _close(homes, queries, h[right], q[value + up > c], up, down, found)


def _signatures(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct letter counts; words in order of them, first place and number of each."""
    counts = np.ascontiguousarray(_counts(letters))
    keys = counts.view(f"S{counts.itemsize * DIMS}").ravel()
    _, first, of, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return counts[first], np.argsort(of, kind="stable"), np.concatenate(([0], np.cumsum(n)[:-1])), n


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def _one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether ``long`` without one letter is ``short``."""
    size = short.shape[1]
    ahead, behind = short != long[:, :-1], short != long[:, 1:]
    first = np.where(ahead.any(1), ahead.argmax(1), size)
    last = np.where(behind.any(1), size - behind[:, ::-1].argmax(1), 0)
    return last <= first


def near_pairs(homes: list[str], queries: list[str], size: int, longer: bool):
    """Arrays ``(home, query)`` of all near pairs, some at a time."""
    if not homes or not queries:
        return
    a, b = _matrix(homes, size), _matrix(queries, size + longer)
    (sig_a, order_a, first_a, n_a), (sig_b, order_b, first_b, n_b) = _signatures(a), _signatures(b)
    found: list = []
    # A longer query loses a letter to become a home; equal ones lose one and gain one.
    _close(sig_a, sig_b, np.arange(len(sig_a)), np.arange(len(sig_b)), 0 if longer else 1, 1, found)
    if not found:
        return
    i, j = (np.concatenate(x) for x in zip(*found))
    stops = np.cumsum(n_a[i] * n_b[j])
    for start in range(0, int(stops[-1]) if len(stops) else 0, PAIRS):
        flat = np.arange(start, min(start + PAIRS, int(stops[-1])))
        pair = np.searchsorted(stops, flat, side="right")
        inside = flat - (stops[pair] - n_a[i[pair]] * n_b[j[pair]])
        home = order_a[first_a[i[pair]] + inside // n_b[j[pair]]]
        query = order_b[first_b[j[pair]] + inside % n_b[j[pair]]]
        same = _one_inserted(a[home], b[query]) if longer else _one_replaced(a[home], b[query])
        yield home[same], query[same]


def _unit(table: pa.Table) -> pa.Table:
    """Near words of one unit: per word their number and the most frequent of them."""
    size = table.column("size")[0].as_py()
    role, n = table.column("role").to_numpy(), table.column("n").to_numpy()
    words = table.column("word").to_pylist()
    where = [np.flatnonzero(role == r) for r in range(4)]
    # Most frequent first, ties in code-point order.
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    homes = [words[i] for i in where[HOME]]
    for kind in (OWN, EQUAL, LONGER):
        for h, q in near_pairs(homes, [words[i] for i in where[kind]], size, kind == LONGER):
            h, q = where[HOME][h], where[kind][q]
            if kind == OWN:
                # A pair inside one leaf meets twice; rank differs unless it is one word.
                once = place[h] < place[q]
                h, q = h[once], q[once]
            near += np.bincount(h, minlength=len(words)) + np.bincount(q, minlength=len(words))
            np.minimum.at(best, h, place[q])
            np.minimum.at(best, q, place[h])
    hit = np.flatnonzero(near)
    of = [order[p] for p in best[hit]]
    return pa.table(
        {"word": pa.array([words[i] for i in hit], pa.string()), "near": pa.array(near[hit]),
         "best_n": pa.array(n[of] if len(of) else [], pa.int64()), "best": pa.array([words[i] for i in of], pa.string())}
    )


def _trees(words: DataFrame, sample: int, leaf: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A tree per word length with more than a leaf of words, from about ``sample`` words chosen by hash."""
    sizes = {r["size"]: r["n"] for r in words.groupBy("size").agg(F.count("*").alias("n")).where(F.col("n") > leaf).collect()}
    picked = None
    if sizes:
        # A cut on the hash: no task sends more than its share.
        cut = int(min(1.0, sample / sum(sizes.values())) * 2**31)
        chosen = words.where(F.pmod(F.xxhash64("word"), F.lit(2**31)) < cut)
        picked = chosen.where(F.col("size").isin(list(sizes))).orderBy("word")
    by_size: dict[int, list[str]] = {}
    for r in picked.select("size", "word").collect() if picked is not None else []:
        by_size.setdefault(r["size"], []).append(r["word"])
    return {
        size: fit_tree(_counts(_matrix(own, size)), int(np.ceil(np.log2(sizes[size] / leaf)))) for size, own in by_size.items()
    }


def near_words(words: DataFrame, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """``(word, n_near, best, best_n)`` of every word with a near word.

    ``words`` holds distinct ``word`` of letters up to U+00FF, and ``n``. ``best`` is
    the near word of largest ``n``, ties to the smaller in code-point order. Null
    words and words with other letters are left out; an empty table gives no rows.
    """
    usable = words.where("n is not null").where(F.col("word").rlike("^[\\x{00}-\\x{FF}]+$"))
    held = materialize(usable.select("word", F.col("n").cast("long").alias("n"), F.length("word").alias("size")), "words")
    trees = _trees(held, sample, leaf)
    flat = (np.zeros(1, np.int64), np.full(1, NO_CUT, np.int64))

    def route(batches):
        for batch in batches:
            names, sizes = batch.column("word").to_pylist(), batch.column("size").to_numpy()
            out: dict[str, list] = {"row": [], "size": [], "leaf": [], "role": []}

            def add(row, size, leaf, role):
                for key, value in zip(out, (row, np.full(len(row), size), leaf, np.full(len(row), role))):
                    out[key].append(value)

            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                counts = _counts(_matrix([names[i] for i in own], size))
                tree = trees.get(size, flat)
                row, home = _descend(counts, tree, 0, 0)
                at = np.empty(len(own), np.int64)
                at[row] = home
                add(own, size, at, HOME)
                add(own, size, at, OWN)
                row, leaf = _descend(counts, tree, 1, 1)
                # The earlier leaf of a pair goes to the later one.
                later = leaf > at[row]
                add(own[row[later]], size, leaf[later], EQUAL)
                row, leaf = _descend(counts, trees.get(size - 1, flat), 0, 1)
                add(own[row], size - 1, leaf, LONGER)
            if out["row"]:
                row, size, leaf, role = (np.concatenate(v) for v in out.values())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(size, pa.int32()), pa.array(leaf, pa.int64()), pa.array(role, pa.int32()),
                     batch.column("word").take(take), batch.column("n").take(take)],
                    names=["size", "leaf", "role", "word", "n"],
                )

    routed = held.mapInArrow(route, "size int, leaf long, role int, word string, n long")
    routed = materialize(routed, "routed")
    full = (
        routed.groupBy("size", "leaf").agg(F.count_if(F.col("role") == HOME).alias("h"), F.count_if(F.col("role") != HOME).alias("q"))
        .where("h > 0 and (h > {0} or q > {0})".format(block))
        .select("size", "leaf", F.ceil(F.col("h") / block).alias("hs"), F.ceil(F.col("q") / block).alias("qs"))
    )
    side, _ = broadcast_if_small(materialize(full, "full"))
    at_home = F.col("role") == HOME
    own = F.pmod(F.xxhash64("word"), F.when(at_home, F.coalesce("hs", F.lit(1))).otherwise(F.coalesce("qs", F.lit(1))))
    other = F.when(at_home, F.coalesce("qs", F.lit(1))).otherwise(F.coalesce("hs", F.lit(1)))
    dealt = routed.join(side, ["size", "leaf"], "left").select(
        "size", "leaf", "role", "word", "n", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), other - 1)).alias("other")
    )
    units = dealt.select(
        "size", "leaf", "role", "word", "n",
        F.when(at_home, F.col("own")).otherwise(F.col("other")).alias("hb"),
        F.when(at_home, F.col("other")).otherwise(F.col("own")).alias("qb"),
    )
    found = units.groupBy("size", "leaf", "hb", "qb").applyInArrow(_unit, "word string, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("b")).select(
        "word", "n_near", F.col("b.w").alias("best"), (-F.col("b.n")).alias("best_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the last word that forms lead to, from ``(word, form)``.

    A form has a larger count than its word, so there are no cycles. Steps double
    each round; each round is a table in the shared folder.
    """
    reach = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(reach.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        discard(reach)
        reach = moved.select("word", "root")
        reach._scratch_path = moved._scratch_path
        if moved.where("next is not null").isEmpty():
            return reach


def group_variants(words: DataFrame, times: int = 10, **tree) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``words`` ``(word, n)``.

    The form of a word is its near word of largest ``n`` if that is ``times`` its own
    or more, else null; the root is where forms lead, the word itself if it has none.
    """
    held = materialize(words.select("word", F.col("n").cast("long").alias("n")), "counted")
    judged = held.join(near_words(held, **tree), "word", "left")
    better = F.col("best_n") >= F.lit(times) * F.col("n")
    judged = materialize(
        judged.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n"),
        ),
        "judged",
    )
    last = roots(judged.where("form is not null"))
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
