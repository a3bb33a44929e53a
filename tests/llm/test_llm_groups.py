"""Shards, spelling variants and whitening against brute force, on the smallest tables and on odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from umbel.llm import packing, queries, spelling, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, shard string, slot long, size string, `group` string, n long, word string, total long"
ODD = [
    (1, None), (2, ""), (3, "one"), (4, "one"), (5, "été Étéaaaa abcdefg"), (6, "abcdefg abcdefh"), (7, "wordword " * 30000),
    (7, "wordword " * 30000), (8, "日本語 の abcdefgh"), (9, " \t\n"), (None, "abcdefg lost"), (None, "abcdefg lost"), (10, "a" * 100_000),
    (11, "b" * 70_000 + "é×÷ÿ"), (12, "x" * 300),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "s", 1, "z", "g", 5, "w", 6) for i, t in rows], SCHEMA)


def test_room_tree_against_a_list():
    rng, tree, held = random.Random(1), packing.RoomTree(), []
    for step in range(4000):
        if rng.random() < 0.55:
            held.append((rng.randrange(300), step))
            tree.add(*held[-1])
        else:
            room = rng.randrange(320)
            want = min((x for x in held if x[0] >= room), default=None)
            assert tree.take(room) == want
            if want:
                held.remove(want)

    def height(node):
        if not node:
            return 0
        left, right = height(node[1]), height(node[2])
        assert abs(left - right) < 2
        return 1 + max(left, right)

    assert height(tree.top) <= 1.45 * math.log2(len(held) + 2)


def test_best_fit_decreasing_one_by_one():
    rng = random.Random(2)
    for _ in range(200):
        items, capacity = sorted((rng.randrange(1, 100) for _ in range(rng.randrange(80))), reverse=True), rng.randrange(60, 150)
        rooms, want = [], Counter()
        for size in items:
            fits = min(((r, i) for i, r in enumerate(rooms) if r >= size), default=None)
            at = len(rooms) if fits is None else fits[1]
            if fits is None:
                rooms.append(max(capacity, size))
            rooms[at] -= size
            want[at, size] += 1
        got, placed = Counter(), Counter()
        for size, low, high, shard in packing.best_fit(sorted(Counter(items).items(), reverse=True), capacity):
            got[shard, size] += high - low
            placed[size] += high - low
        assert got == want and placed == Counter(items)


@pytest.mark.parametrize("rows", [None, ODD, []])
def test_shards(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if rows is None else odd(spark, rows)
    got = packing.shard_documents(docs, shards=24).collect()
    want = Counter(
        (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect()
    )
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    of, slots, filled = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        of[r["size"], r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        filled[r.shard] += r["size"]
    assert all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.shard_bytes == filled[r.shard] for r in got) and all(0 <= s < 24 for s in filled)
    if rows is None:
        assert len(filled) == 24 and max(filled.values()) - min(filled.values()) < 0.02 * sum(filled.values()) / 24
        one = queries.op11(spark, SF)
        assert one.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]


def test_a_large_group_leaves_the_rest_even(spark):
    rows = [(i, "copied " * 50) for i in range(600)] + [(1000 + i, f"text {i} " * (5 + i % 40)) for i in range(1200)]
    got = packing.shard_documents(odd(spark, rows), shards=6).collect()
    filled = {r.shard: r.shard_bytes for r in got}
    alone = {r.shard for r in got if r.doc_id < 1000}
    rest = [v for s, v in filled.items() if s not in alone]
    assert len(alone) == 1 and len(rest) == 5 and max(rest) - min(rest) < 0.01 * max(rest)
    assert {r.shard for r in got if r.doc_id >= 1000}.isdisjoint(alone)


def test_capacity_of_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.shard_documents(docs, capacity=40_000).collect()
    filled = {r.shard: r.shard_bytes for r in got}
    assert max(filled.values()) <= 40_000 and len(filled) <= 1 + sum(filled.values()) / 40_000 * 1.02


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += len(run) >= 7
            run = ""
    return {w: n for w, n in counts.items() if n}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, times=10):
    out = {}
    near = {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= times * counts[w]:
            form[w] = best
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w)))
    return out


def variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_word_counts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for frame, own in ((spark.read.parquet(f"{SF}/documents.parquet"), rows), (odd(spark), ODD), (odd(spark, []), [])):
        got = spelling.word_counts(frame).collect()
        assert {r.word: r.n for r in got} == brute_words(own) and len(got) == len(brute_words(own))


def test_variants_of_the_smallest_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_variants({w: n for w, n in brute_words(rows).items() if n >= 2})
    assert variants(queries.op12(spark, SF)) == want and sum(v[0] is not None for v in want.values()) > 5


@pytest.mark.parametrize("shape", [{}, {"leaf": 16, "block": 40}, {"leaf": 4, "sample": 60}])
def test_variants_of_dense_words(spark, shape):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcàö×") for _ in range(rng.choice((7, 7, 8, 9, 300)))) for _ in range(150)}
    for w in list(words):
        for _ in range(3):
            at = rng.randrange(len(w))
            words.add(w[:at] + rng.choice("abcàöÿÁ") + w[at + 1 :])
            words.add(w[:at] + rng.choice("abé") + w[at:])
    counts = {w: rng.choice((2, 2, 3, 30, 30, 400, 5000)) for w in words}
    table = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, best string")
    assert variants(spelling.group_variants(table, **shape)) == brute_variants(counts)
    assert variants(spelling.group_variants(table.limit(0), **shape)) == {}


def usable(rows):
    return [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def brute_whitened(rows, k=16):
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    y = (n * u - s) / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1], basis[:, ::-1]
    real = values[:k] > 1e-10 * values[0]
    white = ((n * x - s) / n) @ basis[:, :k][:, real] / np.sqrt(values[:k][real])
    return n, ((n * x - s) ** 2).sum(1), white, values[:k][real] / values.sum()


def check_whitened(got, rows):
    n, deviation, white, share = brute_whitened(rows)
    k = white.shape[1]
    by_row = defaultdict(list)
    for r in got:
        by_row[r.vec_id].append(r)
    assert sum(map(len, by_row.values())) == k * len(rows) and all(r.n == n for r in got)
    table = np.array([[r.whitened for r in sorted(by_row[i], key=lambda r: r.component)[:k]] for i, _ in rows])
    sign = np.sign((table * white).sum(0))
    assert np.abs(table * sign - white).max() < 1e-9
    assert {(i, r.deviation) for i in by_row for r in by_row[i]} == {(i, d) for (i, _), d in zip(rows, deviation.tolist())}
    assert all(abs(r.explained - share[r.component - 1]) < 1e-12 and r.identity_error < 1e-9 for r in got)


def test_whitening_of_the_smallest_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(queries.op13(spark, SF).collect(), rows)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, [1], 2, 0.5) for i, v in rows], "vec_id long, embedding array<double>, x array<int>, n int, whitened double")


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [1, 5, 2, 0, 1]]) for i in range(80)]
    rows += [(100 + i, list(rows[3][1])) for i in range(60)]
    lost = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [math.nan] * 5), (204, [math.inf, 0.0, 0.0, 0.0, 0.0]), (205, [1e300, 0.0, 0.0, 0.0, 0.0]), (206, [1.0, 2.0])]
    check_whitened(whitening.whitened_components(vectors(spark, rows + lost)).collect(), rows)
    assert whitening.whitened_components(vectors(spark, lost[:5])).collect() == []
    assert whitening.whitened_components(vectors(spark, [])).collect() == []
    assert whitening.whitened_components(vectors(spark, rows[3:4] * 3)).collect() == []
    null_id = whitening.whitened_components(vectors(spark, [(None, rows[0][1]), *rows[1:9]])).collect()
    assert sum(r.vec_id is None for r in null_id) == len({r.component for r in null_id}) == 4


def test_whitening_with_few_directions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=24) * np.linspace(9, 1, 24) ** 2]) for i in range(400)]
    x = whitening.integers(vectors(spark, rows))
    model = whitening.fit(x, keep=6, components=3)
    _, _, white, share = brute_whitened(rows, 3)
    got = sorted(whitening.whiten(x, model).collect(), key=lambda r: (r.vec_id, r.component))
    table = np.array([r.whitened for r in got]).reshape(-1, 3)
    assert np.abs(np.abs(table) - np.abs(white)).max() < 1e-8 and np.abs(model["values"] / model["trace"] - share).max() < 1e-12


@pytest.mark.parametrize("dim,rows,kind", [(6, 3, 0), (12, 200, 0), (64, 150, 0), (10, 60, 1), (8, 80, 2)])
def test_rank_one_updates(dim, rows, kind):
    rng = np.random.default_rng(dim)
    x = np.floor(rng.normal(size=(rows, dim)) * np.linspace(1, 9, dim))
    if kind == 1:
        x = np.round(x / 10)  # many ties, repeated rows, nil directions
    if kind == 2:
        x = np.tile(np.eye(dim), (rows // dim, 1)) * 7  # equal eigenvalues
    one, halves = whitening.Spectrum(dim), [whitening.Spectrum(dim), whitening.Spectrum(dim)]
    for row in x:
        one.absorb(1, row, np.zeros((0, dim)))
    halves[0].add(x[: rows // 2])
    halves[1].add(x[rows // 2 :])
    halves[0].merge(whitening.Spectrum.unpack(halves[1].pack(), dim))
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    for s in (one, halves[0]):
        assert s.n == rows and np.allclose(s.mean, x.mean(0))
        assert np.abs(s.basis * s.values @ s.basis.T - scatter).max() < 1e-10 * np.abs(scatter).max()
        assert np.abs(s.basis.T @ s.basis - np.eye(dim)).max() < 1e-10
