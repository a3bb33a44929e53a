"""Operators against brute force on the smallest tables and on odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.compare import connect, difference
from umbel.llm import attribution, queries, simhash, simple8b, suffixes, tokenfiles, topk, wordbpe

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, section string"
ODD = [
    (1, None), (2, ""), (3, "one"), (4, "one"), (5, "a b c d e"), (6, "a b c d e"), (7, "word " * 30000),
    (8, "日本語 の text"), (9, " \t\n"), (10, "A B C D E"), (10, "A B C D E"), (None, "lost id"), (11, "don't <|endoftext|> we'll"),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, None, None, None, 7, "x") for i, t in rows], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.encode().split()]
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    ids = list(fps)
    found = {}
    for start in sorted(i for i in ids if i is not None):
        if start in found:
            continue
        found[start], front = start, [start]
        while front:
            a = front.pop()
            for b in ids:
                if b is not None and b not in found and (fps[a] ^ fps[b]).bit_count() <= radius:
                    found[b] = start
                    front.append(b)
    return found


def test_simhash_matches_brute_force(spark):
    rows = documents(spark).select("doc_id", "text").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    groups = brute_components(fps, 4)
    got = queries.op4(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == groups[r.doc_id]


def test_simhash_odd_rows(spark):
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(odd(spark)).collect()}
    by_id = {i: (fp, c) for i, fp, c in got}
    assert by_id[1] == by_id[2] == by_id[9] == (0, 1)
    assert by_id[5][1] == by_id[6][1] == by_id[10][1] == 5
    assert by_id[4][1] == 3
    assert simhash.near_duplicates(odd(spark, [])).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(odd(spark)).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 3, 5, 7, 8, 11] and None in kept


@pytest.mark.parametrize("segments,radius", [(1, 4), (3, 4), (6, 11)])
def test_links_of_dense_groups_in_blocks(spark, monkeypatch, segments, radius):
    monkeypatch.setattr(simhash, "LEAF", 16)
    monkeypatch.setattr(simhash, "BLOCK_HOME", 20)
    monkeypatch.setattr(simhash, "BLOCK_ALL", 50)
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 40)
    near = [int(c) ^ int(sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 6)))) for c in centre for _ in range(12)]
    fps = sorted(set(near))
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    stars = simhash.links(table, radius, segments).collect()
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in stars:
        a, b = sorted((top(r.fp), top(r.root)))
        parent[b] = a
    brute = brute_components(dict(zip(fps, fps)), radius)
    assert {f: top(f) for f in fps} == brute


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for k in range(60):
        n = int(rng.integers(0, 30000))
        bits = rng.integers(1, [2, 5, 13, 17, 31, 61, 65][k % 7], size=n)
        ids = (rng.integers(0, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) >> (64 - bits).astype(np.uint64)
        if k % 5 == 0:
            ids[:] = 0
        if k % 11 == 0:
            ids[100:400] = 0
        words, blocks = simple8b.encode(ids)
        assert (simple8b.decode(words, n) == ids).all()
        for b in range(-(-n // simple8b.BLOCK)):
            part = ids[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]
            assert (simple8b.decode_block(words, blocks, n, b) == part).all()


def library():
    return wordbpe.Encoder.at(wordbpe.default_path()).whole


def check_token_files(spark, docs, path):
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    tokenfiles.encode_documents(docs, path)
    got = sorted(tokenfiles.read_documents(spark, path).collect(), key=lambda r: r.start)
    digests = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_documents(spark, path, digest=True).collect()}
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    at = 0
    for r, (_, text) in zip(got, rows):
        ids = [*library().encode(text or "", add_special_tokens=False).ids, 1]
        assert list(r.ids) == ids and r.start == at and r.n_tokens == len(ids)
        assert (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) in digests
        at += len(ids)


def test_token_files_match_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SEGMENT_IDS", 20000)
    check_token_files(spark, documents(spark), str(tmp_path / "a"))
    check_token_files(spark, odd(spark), str(tmp_path / "b"))
    tokenfiles.encode_documents(odd(spark, []), str(tmp_path / "c"))
    assert tokenfiles.read_documents(spark, str(tmp_path / "c")).count() == 0


def test_words_of_latin_texts_match_the_library():
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in range(1, 256)]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice(list("ab'stremvld l. 9²AÉß\n\t"), rng.integers(0, 60))) for _ in range(1500)]
    texts += ["a" * 300 + "b " + "a" * 300, "x" * 100 + " y"]
    import pyarrow as pa

    for first, _, ids, counts in wordbpe.Encoder.at(wordbpe.default_path()).texts(pa.array(texts)):
        at = 0
        for i, n in enumerate(counts.tolist()):
            assert ids[at : at + n].tolist() == library().encode(texts[first + i], add_special_tokens=False).ids
            at += n


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_matches_brute_force(spark, rule):
    for docs in (documents(spark).limit(60), odd(spark)):
        got = attribution.attribute(docs, attribution.quarters(F.col("text")), rule).collect()
        by_doc = {}
        for r in got:
            by_doc.setdefault(r.doc_id, []).append(r)
        for d in docs.select("doc_id", "text").collect():
            if d.doc_id == 10:
                continue
            text = d.text or ""
            want, cross = [0.0] * 4, [0] * 4
            edge = [len(text) * k // 4 for k in range(5)]
            for a, b in library().encode(text, add_special_tokens=False).offsets:
                part = [max(0, min(edge[k + 1], b) - max(edge[k], a)) for k in range(4)]
                hit = [k for k in range(4) if part[k]]
                if rule == "split":
                    for k in hit:
                        want[k] += part[k] / sum(part)
                        cross[k] += len(hit) > 1
                else:
                    k = hit[0] if rule == "first" else max(hit, key=lambda k: (part[k], -k))
                    want[k] += 1
                    cross[k] += len(hit) > 1
            rows = sorted(by_doc[d.doc_id], key=lambda r: r.section)
            assert [r.tokens for r in rows] == pytest.approx(want) and [r.crossing for r in rows] == cross
    none = attribution.attribute(docs, F.lit(None).cast("array<struct<section:string,from_char:long,to_char:long>>"), rule)
    assert all(r.section is None for r in none.collect())


def test_sections_from_a_table(spark):
    docs = odd(spark, [(1, "alpha beta gamma")])
    spans = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 6, 10)], "doc_id long, section string, from_char long, to_char long")
    got = attribution.attribute(attribution.with_sections(docs, spans), F.col("sections")).collect()
    assert {r.section for r in got} == {"a", "b", None}


def test_top_k_matches_sql(spark):
    con = connect("/root/testdata/sf0.01")
    df = queries.op8(spark, "/root/testdata/sf0.01")
    assert difference(df.columns, df.collect(), con, queries.ORACLES["op8_threshold_top_k"]) is None


def test_top_k_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(topk, "STRIDE", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 1024]) for i in range(300)]
    rows += [(1000 + i, [1 / 1024] * 6) for i in range(60)] + [(300, [0.0] * 6), (400, None), (500, [float("nan")] * 6)]
    rows += [(600, [None] * 6), (700, [float("inf")] + [0.0] * 5), (800, [-1 / 1024] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    v = topk.usable(table)
    whole = {r.vec_id: np.array(r.v) for r in v.collect()}
    assert set(whole) == {i for i, x in rows if i not in (400, 500, 600, 700)}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 100 = 0"), 10).collect()}
    for q in (i for i in whole if i % 100 == 0):
        best = sorted(((-int(whole[q] @ x), i) for i, x in whole.items() if i != q))[:10]
        assert [got[q, n + 1] for n in range(10)] == [(i, -s) for s, i in best]
    assert topk.top_k(v.where("false"), v).count() == 0 and topk.top_k(v, v.where("false")).count() == 0


def brute_repeats(rows, length):
    from collections import Counter

    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [1, 2048])
def test_repeated_strings_match_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    rng = np.random.default_rng(9)
    base = ["".join(rng.choice(list("abcd é"), 400)) for _ in range(4)]
    rows = [(i, base[i % 4][: 150 + 10 * i] + "".join(rng.choice(list("xyz"), 30)) + base[(i + 1) % 4][i * 7 :]) for i in range(20)]
    rows += [(100, "ab" * 500), (101, None), (102, ""), (103, "short"), (104, base[0] * 3), (105, "q" * 40), (None, base[1])]
    rows += [(106, base[2] + "tail"), (106, base[2] + "tail"), (107, "z" * 2000)]
    got = suffixes.remove_repeats(odd(spark, rows), length=50, gram=16).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_repeats(rows, 50)
    assert suffixes.remove_repeats(odd(spark, [])).count() == 0


def test_repeated_strings_of_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10(spark, SF).collect()]
    assert sorted(got, key=str) == brute_repeats(rows, 200)
