"""Extraction, quality, mixing, leaks and toxicity: brute force, held-out accuracy and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm_exact import SF, documents, library, odd
from umbel.llm import kneser_ney, latent, queries, raking, site_templates, toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def labels(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], LABELS)


# ---- pages -------------------------------------------------------------------


def test_main_text_of_odd_markup():
    page = (
        "<html><head><title>no</title></head><body class='with-sidebar'><div id='cookie-notice'>no</div><nav>no</nav><header>no</header>"
        "<div class='content has-sidebar'><article><header><h1>A &amp; B</h1></header><p>one\n  two<p>three <b>bold</b><br>four"
        "<ul><li>x<li>y</ul><script>no('</p>')</script><div class='share'>no</div><form>no</form><pre>k  k</pre>"
        "<section class='comments'><p>no</p></section></article></div><aside>no</aside><footer>no</footer></body></html>"
    )
    assert site_templates.extract(page) == "A & B\n\none two\n\nthree bold four\n\nx\n\ny\n\nk k"
    assert site_templates.extract(None) == site_templates.extract("") == ""
    assert site_templates.extract("<p>cut &lt; off <b") == "cut < off"
    assert site_templates.extract("plain &#233;&nbsp;text &am") == "plain é text &am"
    deep = "<div>" * 5000 + "<p>deep</p>"
    assert site_templates.extract(deep) == "deep"


def test_templates_are_found_per_host(spark):
    def page(i, host, extra=""):
        return (i, f"http://{host}/p{i}", f"<body><div><span>Top of {host}</span></div><p>Own text {i}.</p>{extra}</body>", "x")

    rows = [page(i, "a.com") for i in range(6)] + [page(i, "b.com") for i in range(10, 12)]
    rows += [(20 + i, "http://c.com/", "<body><div>Same page</div></body>", "x") for i in range(9)]
    rows += [(40, None, "<body><div>Top of a.com</div></body>", "x"), (41, "http://a.com", None, "x"), (42, "no address", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in site_templates.main_text(pages).collect()}
    assert all(got[i] == f"Own text {i}." for i in range(6))
    # Two contents are not many; nine copies of one page are one content.
    assert got[10] == "Top of b.com\n\nOwn text 10." and got[20] == "Same page"
    assert got[40] == "Top of a.com" and got[41] == got[42] == ""
    assert site_templates.main_text(pages.where("false")).count() == 0


def test_pages_table(spark):
    got = queries.op1(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(len(r.text) == r.n_chars and "<p>" not in r.text for r in got)


# ---- mixing ------------------------------------------------------------------


def test_raking_of_arrays_and_of_tables_agree(spark):
    rng = np.random.default_rng(21)
    cells = spark.createDataFrame([(f"a{i}", f"b{j}", int(n)) for i in range(5) for j in range(4) if (n := rng.integers(0, 400)) > 60], "a string, b string, tokens long")
    even = {d: raking.even_targets(cells, d, 0.5) for d in "ab"}
    for keep in (None, 0.4):
        (one, gap), (other, away) = (raking.rake(cells, even, keep=keep, collected=n) for n in (1000, 0))
        a, b = ({(r.a, r.b): r.weight for r in t.collect()} for t in (one, other))
        assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9 and abs(gap - away) < 1e-9


def test_raking_matches_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{i}", f"l{j}", int(rng.integers(1, 1000))) for i in range(5) for j in range(3)]
    cells = spark.createDataFrame(rows, "a string, b string, tokens long")
    ta, tb = rng.dirichlet(np.ones(5)), rng.dirichlet(np.ones(3))
    target = lambda p, t: spark.createDataFrame([(f"{p}{i}", float(x)) for i, x in enumerate(t)], "value string, share double")
    got, gap = raking.rake(cells, {"a": target("s", ta), "b": target("l", tb)}, tolerance=1e-8)
    w = np.array([r[2] for r in rows], float).reshape(5, 3)
    w /= w.sum()
    for _ in range(500):
        w *= (ta / w.sum(1))[:, None]
        w *= tb / w.sum(0)
    assert gap < 1e-8
    for r in got.collect():
        assert r.weight == pytest.approx(w[int(r.a[1]), int(r.b[1])], rel=1e-6)
    # A value without a target weighs nothing; a target without tokens is left out.
    some, _ = raking.rake(cells, {"a": target("s", [0.5, 0.5]), "b": target("l", [0.2, 0.3, 0.1, 0.4])})
    assert {r.a for r in some.collect()} == {"s0", "s1"} and some.agg(F.sum("weight")).first()[0] == pytest.approx(1)


def test_mixture_of_documents(spark):
    docs = documents(spark)
    got = raking.by_source_language_topic(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and {r.mix_kept for r in rows} == {True, False}
    for r in rows[:50]:
        assert r.mix_tokens == len((r.text or "").split())
    chances = [r.mix_probability for r in rows if r.mix_tokens]
    assert max(chances) == pytest.approx(1) and min(chances) > 0
    # In expectation the kept tokens have the evened shares.
    sums = {}
    for r in rows:
        a = sums.setdefault(r.lang, [0, 0])
        a[0] += r.mix_tokens
        a[1] += r.mix_tokens * r.mix_probability
    lifted = {k: v[0] ** 0.7 for k, v in sums.items()}
    for k, v in sums.items():
        assert v[1] / sum(x[1] for x in sums.values()) == pytest.approx(lifted[k] / sum(lifted.values()), rel=1e-3)
    odd_rows = raking.by_source_language_topic(odd(spark)).collect()
    assert len(odd_rows) == 13 and all(r.mix_kept for r in odd_rows if not r.mix_tokens)
    assert raking.by_source_language_topic(odd(spark, [])).count() == 0


# ---- quality -----------------------------------------------------------------


def brute_kneser_ney(grams):
    """Log-probability of each gram, orders as dictionaries of tuples."""
    tables = [dict(grams)]
    for _ in range(kneser_ney.ORDER - 1):
        lower = {}
        for g, n in tables[-1].items():
            if n > 0:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
        tables.append(lower)

    def discounts(t):
        n = [sum(v == k for v in t.values()) for k in range(5)]
        if not n[1] or not n[2]:
            return [0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in (1, 2, 3)]
        return [min(max(d, 0.05), c) for c, d in zip((0.95, 1.9, 2.9), raw)]

    ds = [discounts(t) for t in tables]
    cut = lambda o, n: ds[o][min(n, 3) - 1]
    sums = []
    for o, t in enumerate(tables):
        s = {}
        for g, n in t.items():
            if n > 0:
                a = s.setdefault(g[:-1], [0, 0.0])
                a[0] += n
                a[1] += cut(o, n)
        sums.append(s)

    def p(o, g):
        base = 1 / 64 if o == len(tables) - 1 else p(o + 1, g[1:])
        if g[:-1] not in sums[o]:
            return base
        total, held = sums[o][g[:-1]]
        n = tables[o].get(g, 0)
        return ((n - cut(o, n) if n > 0 else 0) + held * base) / total

    return {g: np.log(p(0, g)) for g in grams}


def test_kneser_ney_matches_brute_force(spark):
    rows = [("the cat sat", True), ("the cat ran and the cat sat", True), ("dog ate", False), (None, True), ("", False)]
    docs = spark.createDataFrame(rows, "text string, trusted boolean")
    counts = kneser_ney.count_grams(docs)
    classes = kneser_ney.symbol_classes()
    want = {}
    for text, trusted in rows:
        seq = [0, 0, 0, *[int(classes[b]) for b in (text or "").encode()]]
        for i in range(3, len(seq)):
            g = tuple(seq[i - 3 : i + 1])
            want[g] = want.get(g, 0) + trusted
    unpack = lambda x: tuple(x >> (6 * k) & 63 for k in (3, 2, 1, 0))
    assert {unpack(r.gram): r.n for r in counts.collect()} == want
    brute = brute_kneser_ney(want)
    got = {unpack(r.gram): r.logp for r in kneser_ney.train(counts).collect()}
    assert got.keys() == brute.keys() and all(got[g] == pytest.approx(brute[g]) for g in got)


def test_every_byte_has_its_own_probability(spark):
    rows = [("In 1999 Zoë paid 17 €; in 1998 Åke", True), ("A 1999 and B 1997 ¿sí?", True), ("X 4711 żółw", False), (None, True), ("", False)]
    docs = spark.createDataFrame(rows, "text string, trusted boolean")
    classes, sizes = kneser_ney.symbol_classes(), kneser_ney.class_sizes()
    want = {}
    for text, trusted in rows:
        seq = [255, 255, *(text or "").encode()]
        for i in range(2, len(seq)):
            if sizes[seq[i]] > 1:
                g = tuple(seq[i - 2 : i + 1])
                want[g] = want.get(g, 0) + trusted
    counts = kneser_ney.count_bytes(docs)
    assert {(r.gram >> 16, r.gram >> 8 & 255, r.gram & 255): r.n for r in counts.collect()} == want
    # Over all bytes of a class the probabilities after any two bytes add up to one.
    after = {g[:2] for g in want}
    every = [(a << 16 | b << 8 | c, want.get((a, b, c), 0)) for a, b in after for c in range(256) if sizes[c] > 1]
    got = {r.gram: np.exp(r.logp) for r in kneser_ney.train_bytes(spark.createDataFrame(every, "gram int, n long")).collect()}
    sums = {}
    for gram, p in got.items():
        key = gram >> 8, classes[gram & 255]
        sums[key] = sums.get(key, 0) + p
    assert len(got) == len(every) and all(x == pytest.approx(1) for x in sums.values())
    seen, other = (ord("9") << 16 | ord("9") << 8 | ord(c) for c in "93")
    assert got[seen] != got[other]
    good = "we met in 1998 and in 1999 and again in 1997 as we did in 1996. "
    texts = [(i, good * 3, "en") for i in range(20)] + [(100, good * 3, "en"), (101, (good * 3).replace("199", "702"), "en")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    p = {r.doc_id: r.perplexity for r in kneser_ney.classify(docs, labels(spark, [(i, 1, 0) for i in range(20)])).collect()}
    assert p[101] > p[100] * 1.2


def test_quality_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op6(spark, sf).collect()
    clean = [r.accepted for r in got if known.get(r.doc_id) == 1]
    junk = [r.accepted for r in got if known.get(r.doc_id) == 0]
    assert sum(clean) / len(clean) > 0.98 and sum(junk) / len(junk) < 0.35


def test_quality_of_odd_rows(spark):
    got = {r.doc_id: r for r in kneser_ney.classify(odd(spark), labels(spark, [(5, 1, 0), (5, 1, 0), (None, 1, 0), (6, None, None)])).collect()}
    assert not got[1].accepted and got[1].perplexity is None and not got[2].accepted and got[5].accepted
    untrained = kneser_ney.classify(odd(spark), labels(spark, [])).collect()
    assert len(untrained) == 13 and all(r.accepted == bool(r.n_symbols) for r in untrained)
    assert kneser_ney.classify(odd(spark, []), labels(spark, [])).count() == 0
    assert kneser_ney.accepted(odd(spark), labels(spark, [(5, 1, 0)])).columns == odd(spark).columns


# ---- leaks -------------------------------------------------------------------


def test_randomised_svd_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((40, 6)) @ rng.standard_normal((6, 30))
    rows = spark.createDataFrame([(list(range(30)), r.tolist()) for r in a], "terms array<int>, weights array<double>")
    got = latent.randomised_svd(rows, 30, rank=6)
    exact = np.linalg.svd(a)[2][:6]
    assert np.allclose(got @ got.T, exact.T @ exact, atol=1e-6)


def test_common_subsequence_matches_table():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 6, 20).tolist(), rng.integers(0, 6, 30).tolist()
        t = np.zeros((21, 31), int)
        for i in range(20):
            for j in range(30):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert latent.common_subsequence(latent._masks(a), 20, b) == t[-1, -1]


def brute_leaks(docs, items):
    """Pairs where nearly every word of an item stands in one stretch of a document."""
    from difflib import SequenceMatcher

    split = lambda t: [int(h) for h in latent.word_hashes(t or "")]
    out = set()
    for i, t in items:
        item = split(t)
        for d, text in docs:
            words = split(text)
            blocks = SequenceMatcher(None, words, item, autojunk=False).find_longest_match(0, len(words), 0, len(item))
            if blocks.size >= 0.85 * len(item):
                out.add((d, i))
    return out


def test_leaks_match_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.doc_id < 300]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op7(spark, sf).collect() if r.doc_id < 300}
    assert got == brute_leaks(docs, items) and got


def test_leaks_of_odd_rows(spark):
    item = "What is the capital of the tiny island state of Nauru in the Pacific ocean? It is Yaren district."
    other = "Completely different words about gardening tools, wheelbarrows and compost heaps in early spring. Use gloves."
    bench = spark.createDataFrame([(1, item, "x"), (2, other, "x"), (3, None, "x"), (4, "", "x")], "item_id long, text string, lang string")
    pad = " ".join(f"filler{i}" for i in range(200))
    near = item.replace("tiny island", "small island").replace("Pacific ocean", "southern sea")
    wrong = near.replace("It is Yaren district", "Nobody knows that today")
    rows = [(1, item), (2, f"{pad} {item.upper()} {pad}"), (3, f"{pad} {near}"), (4, wrong), (5, pad), (6, None), (7, ""), (None, item), (8, item), (8, item)]
    got = {(r.doc_id, r.item_id, r.kind) for r in latent.find_leaks(odd(spark, rows), bench).collect()}
    assert {(1, 1, "copy"), (2, 1, "copy"), (None, 1, "copy"), (8, 1, "copy")} <= got
    assert any(d == 3 for d, _, _ in got) and not any(d in (4, 5, 6, 7) for d, _, _ in got)
    assert latent.find_leaks(odd(spark, []), bench).count() == 0 and latent.find_leaks(odd(spark, rows), bench.where("item_id > 2")).count() == 0


# ---- toxicity ----------------------------------------------------------------


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(3)

    def vectors(n):
        dense = np.where(rng.random((n, 60)) < 0.08, rng.uniform(0.5, 5, (n, 60)), 0.0)
        # Repeated vectors and empty ones.
        dense[n // 2 : n // 2 + 20], dense[:3] = dense[-1], 0
        row, place = np.nonzero(dense)
        return row, place, toxicity.unit(row, dense[row, place], n), n

    def whole(row, place, weight, n):
        out = np.zeros((n, 60))
        out[row, place] = weight
        return out

    held, asked = vectors(700), vectors(150)
    index = toxicity.Index(*held[:3], 60, 700)
    for k, work in ((7, toxicity.WORK), (1, 3000), (700, 3000)):
        toxicity.WORK, before = work, toxicity.WORK
        found, cosine = index.nearest(*asked, k)
        toxicity.WORK = before
        exact = np.rint(whole(*asked) @ whole(*held).T * 1e6).astype(int)
        order = np.lexsort((np.broadcast_to(np.arange(700), exact.shape), -exact), axis=1)[:, :k]
        assert (np.abs(np.rint(cosine * 1e6) - np.take_along_axis(exact, order, 1)) <= 1).all()
        assert (found == order).mean() > 0.99
    assert index.nearest(*(x[:0] for x in asked[:3]), 2, 4)[1].sum() == 0
    assert toxicity.Index(*(x[:0] for x in held[:3]), 0, 0).nearest(*(x[:0] for x in asked[:3]), 2, 4)[1].shape == (2, 4)


def test_examples_are_a_bounded_sample_of_distinct_vectors(spark):
    rows = [(i, i % 2, f"one two three w{chr(97 + i % 20)}{'xy'[i % 40 // 20]}") for i in range(200)] + [(900, 1, None), (901, 0, "")]
    known = spark.createDataFrame(rows, "doc_id long, label int, text string")
    learnt = toxicity.learn(known.select("doc_id", "text"), known, examples=10)
    assert len(learnt.keys) == 10 and learnt.size == (101, 101)
    assert all(n == 5 for n in learnt.rows) and set(learnt.names) <= set(range(40))
    # All 40 words are held by five rows, but the space has those of the examples only.
    assert len(learnt.terms) == 13 and learnt.index.cost.sum() > 0


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op9(spark, sf).collect() if r.held_out and r.doc_id in known]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 for r in got)
    hits = sum(r.predicted and known[r.doc_id] for r in got)
    assert hits / sum(r.predicted for r in got) >= 0.95 and hits / sum(known[r.doc_id] for r in got) >= 0.9


def test_equal_texts_have_equal_scores(spark):
    docs = documents(spark).select("doc_id", "text")
    text = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(3).collect()]
    free = [i for i in range(10_000, 10_200) if zlib.crc32(str(i).encode()) % 3 != 1]
    held = [i for i in range(10_000, 10_200) if zlib.crc32(str(i).encode()) % 3 == 1]
    copies = [(i, text[n % 3] + " idiot moron") for n, i in enumerate(free[:9] + held[:9])]
    marks = [(i, 1, (n // 3) % 2) for n, i in enumerate(free[:6])]
    rows = docs.unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    known = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").unionByName(spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: (r.score, r.vote) for r in toxicity.classify(rows, known).collect()}
    for n in range(3):
        assert len({got[i] for i, t in copies if t == text[n] + " idiot moron"}) == 1


def test_toxicity_of_odd_rows(spark):
    got = toxicity.classify(odd(spark), labels(spark, [(5, 1, 1), (3, 1, 0), (3, 1, None), (None, 1, 1)])).collect()
    assert len(got) == 13 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.classify(odd(spark), labels(spark, [])).collect()
    assert all(r.score == 0.5 and not r.predicted for r in none)
    assert toxicity.classify(odd(spark, []), labels(spark, [])).count() == 0


# ---- pipeline ----------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    docs = documents(spark)
    first = {r.doc_id: r for r in docs.collect()}
    quality = {r.doc_id: r.accepted for r in queries.op6(spark, SF).collect()}
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, ok in quality.items() if ok}
    single = corpus_pipeline.near_dedup(spark, kept, SF)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == stand_alone([(r.doc_id, r.text) for r in kept.collect()])
    clean = corpus_pipeline.decontaminate(spark, single, SF)
    assert clean.columns == docs.columns
    mixed = corpus_pipeline.mixture(spark, clean, SF)
    assert mixed.columns == docs.columns
    stream = corpus_pipeline.token_files(spark, mixed, SF).orderBy("start").collect()
    left = sorted(r.doc_id for r in mixed.collect())
    assert [r.doc_id for r in stream] == left
    at = 0
    for r in stream:
        ids = [*library().encode(first[r.doc_id].text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert corpus_pipeline.run(spark, SF).count() == len(left)


def stand_alone(rows):
    """Smallest ids reachable over pairs whose sets of five words have a Jaccard similarity of 0.8 or more."""
    words = [(i, (text or "").lower().split()) for i, text in rows]
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}) for i, w in words]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {find(i) for i in root}


def test_pipeline_of_odd_rows(spark, tmp_path):
    for name, rows in (("labels", labels(spark, [(5, 1, 0)])), ("benchmark", spark.createDataFrame([(1, "some benchmark item text here")], "item_id long, text string"))):
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    for rows in (None, []):
        docs = odd(spark) if rows is None else odd(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.count()
