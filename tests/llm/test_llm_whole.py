"""Cases an operator once left out: planted where a cut would lose them."""

import os
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm_exact import odd
from umbel.llm import latent, minhash, raking, simhash
from umbel.runtime import materialize, scratch_dir


def five(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def jaccard(a, b):
    a, b = five(a), five(b)
    return len(a & b) / len(a | b)


def some_words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_near_copies_of_the_pipeline(spark):
    rng, rows, pairs = np.random.default_rng(5), [], []
    for i in range(300):
        words = some_words(rng, int(rng.integers(60, 400)))
        changed = list(words)
        for at in rng.integers(0, len(words), int(rng.integers(1, max(2, len(words) // 25)))):
            changed[at] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    assert sum(p >= 0.8 for p in pairs) > 100 and sum(p < 0.8 for p in pairs) > 30
    docs = odd(spark, rows)
    want = {2 * i for i in range(300)} | {2 * i + 1 for i, p in enumerate(pairs) if p < 0.8}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
    lost = {r.doc_id for r in simhash.keep_one(docs).collect()} - want
    print(f"pairs {sum(p >= 0.8 for p in pairs)}, left by four words and four bits {len(lost)}")


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(6)
    base, rows = some_words(rng, 200), []
    for i in range(300):
        words = list(base)
        words[int(rng.integers(0, 200))] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(some_words(rng, 100))) for i in range(50)] + [(None, rows[0][1]), (2000, "A b"), (2001, "a  B"), (2002, ""), (2003, None)]
    kept = [r.doc_id for r in minhash.keep_one(odd(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([0, *range(1000, 1050), None, 2000, 2002], key=str)


def test_pairs_of_a_large_bucket_that_are_near_no_leader(spark, monkeypatch):
    for name, value in (("BANDS", 2), ("ROWS", 1), ("BUCKET", 4), ("LEADERS", 1)):
        monkeypatch.setattr(minhash, name, value)
    rng, rows = np.random.default_rng(8), []
    form = some_words(rng, 80)
    for i in range(30):
        words = form + some_words(rng, 40)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    assert jaccard(rows[0][1], rows[1][1]) > 0.9 and jaccard(rows[0][1], rows[2][1]) < 0.8
    kept = sorted(r.doc_id for r in minhash.keep_one(odd(spark, rows)).collect())
    assert kept == [2 * i for i in range(30)]


def test_near_copies_that_meet_in_no_band(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BANDS", 1)
    monkeypatch.setattr(minhash, "ROWS", 12)
    rng, rows, pairs, line = np.random.default_rng(15), [], [], some_words(np.random.default_rng(16), 30)
    for i in range(80):
        words = line + some_words(rng, int(rng.integers(60, 300)))
        changed = list(words)
        for at in rng.integers(30, len(words), max(1, len(words) // 60)):
            changed[at] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    want = {2 * i for i in range(80)} | {2 * i + 1 for i, p in enumerate(pairs) if p < 0.8}
    assert len(want) < 150
    assert {r.doc_id for r in minhash.keep_one(odd(spark, rows)).collect()} == want


def test_stages_leave_no_shuffle_files(spark, tmp_path):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: {p.name for d in folders for p in Path(d.getPath()).glob("*/shuffle_*")}
    rng, setting = np.random.default_rng(12), spark.conf.get(key)
    rows = [(i, " ".join(some_words(rng, 60)), "en", "s") for i in range(40)]
    rows += [(100 + i, x + " more", "en", "s") for i, x, _, _ in rows[:10]]
    spark.createDataFrame([(i, 1) for i in range(0, 40, 2)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark, rows[5][1]).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name, stage in corpus_pipeline.STAGES:
        before = files()
        out = stage(spark, docs, str(tmp_path))
        for _ in range(50):  # they are removed soon after, not at once
            if files() <= before:
                break
            time.sleep(0.1)
        assert files() <= before, name
        assert spark.conf.get(key) == setting
        docs = out if name == "token_files" else materialize(out, name)
    assert docs.count() > 0


def test_texts_of_one_template_are_no_candidates(spark):
    rng, rows, form = np.random.default_rng(9), [], [f"form{i}" for i in range(240)]
    for i in range(60):
        words = list(form)
        for at in range(0, 240, 48):
            words[at + int(rng.integers(0, 40))] = f"own{i}x{at}"
        rows += [(i, " ".join(words))] + [(100 + i, " ".join([*words[:-1], "other"]))] * (i % 10 == 0)
    near = {(b, a) for b, x in rows for a, y in rows if b > a and jaccard(x, y) >= 0.8}
    assert len(near) == 6
    texts = spark.createDataFrame(rows, "key long, text string")
    placed = texts.select("key", F.col("key").alias("cluster"))
    got = {(r.a, r.b) for r in minhash.prefix_pairs(placed, texts, 0.8).collect()}
    assert got >= near and len(got) <= 60
    assert {(r.a, r.b) for r in minhash.similar(spark.createDataFrame(sorted(got), "a long, b long"), texts, 0.8).collect()} == near


def bench(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_dropped_leaks_leave_no_copies_of_the_items(spark, monkeypatch):
    sent, send = [], latent.shipping.send
    monkeypatch.setattr(latent.shipping, "send", lambda *args: sent.append(send(*args)) or sent[-1])
    tables = lambda: set(Path(scratch_dir(spark)).glob("places-*"))
    before, words = tables(), some_words(np.random.default_rng(13), 60)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing of it")], "doc_id long, text string")
    assert [r.doc_id for r in latent.drop_leaks(docs, bench(spark, " ".join(words))).collect()] == [2]
    assert tables() == before
    assert sent and not any(os.path.exists(x._path) for x in sent)


def test_an_item_copied_into_a_third_of_the_documents(spark):
    rng = np.random.default_rng(7)
    words = some_words(rng, 30)
    items = [" ".join(words), *(" ".join(some_words(rng, 40)) for _ in range(40))]
    known = " ".join(items[1:]).split()
    rows, want = [], set()
    for d in range(600):
        pad = [str(w) for w in rng.choice(known, 200)]
        if d % 3 == 0:
            own = list(words)
            if d % 2:
                own[int(rng.integers(0, 30))] = "other"
            at = int(rng.integers(0, 200))
            pad[at:at] = own
            want.add(d)
        rows.append((d, " ".join(pad)))
    got = latent.find_leaks(odd(spark, rows), bench(spark, *items)).collect()
    assert {r.doc_id for r in got if r.item_id == 0} == want and all(r.kind == "copy" for r in got if r.item_id == 0)


def test_documents_that_are_short_items(spark):
    five_words = "Who painted the Mona Lisa"
    fifteen = "Which river flows through Vienna and Budapest on its way east? The Danube does that"
    reworded = "Which river flows across Vienna and then Budapest on its course east? The Danube does that"
    pad = " ".join(f"pad{i}" for i in range(80))
    items = bench(spark, five_words, fifteen, f"{fifteen} {pad} one much longer item")
    rows = [(1, five_words), (2, fifteen), (3, "Danube"), (4, reworded), (5, ""), (6, "five other words stand here")]
    got = {(r.doc_id, r.item_id) for r in latent.find_leaks(odd(spark, rows), items).collect()}
    assert got == {(1, 0), (2, 1), (4, 1)}


def test_one_rare_document_does_not_shrink_the_mixture(spark):
    rng = np.random.default_rng(8)
    rows = []
    for d in range(900):
        s, lang = int(rng.choice(3, p=[0.7, 0.2, 0.1])), int(rng.choice(2, p=[0.8, 0.2]))
        rows.append((d, f"s{s}", f"l{lang}", " ".join(["word"] * int(rng.integers(50, 300)))))
    schema = "doc_id long, source string, lang string, text string"
    shares = []
    for more in ([], [(5000, "rare", "l0", "just five words of text")], [(5000, "rare", "odd", "just five words of text")]):
        got = raking.by_source_language_topic(spark.createDataFrame(rows + more, schema)).collect()
        old = [r for r in got if r.doc_id < 5000]
        kept, total = {}, sum(r.mix_tokens for r in old)
        for r in old:
            kept[r.source] = kept.get(r.source, 0) + r.mix_tokens * r.mix_probability
        shares.append(sum(kept.values()) / total)
        sizes = {s: sum(r.mix_tokens for r in old if r.source == s) ** 0.7 for s in kept}
        print("kept share", shares[-1])
        assert all(r.mix_probability == 1 for r in got if r.doc_id == 5000)
        for s, n in sizes.items():
            assert abs(kept[s] / sum(kept.values()) - n / sum(sizes.values())) < 0.01
    assert min(shares) >= 0.249


def test_queries_run_where_workers_cannot_import_the_package(tmp_path):
    repo = Path(__file__).resolve().parents[2]
    script = tmp_path / "elsewhere.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(repo)!r})
import __spark_entry__ as entry
from umbel.runtime import build_session
spark = build_session("elsewhere", partitions=4)
for name, fn in entry.queries().items():
    if name.startswith("op"):
        fn(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
print("all ran")
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-2000:]


def test_near_duplicates_leave_no_texts_on_the_disk(spark, monkeypatch, tmp_path):
    from umbel import runtime

    for name, value in (("BANDS", 2), ("ROWS", 1), ("BUCKET", 4), ("LEADERS", 1)):
        monkeypatch.setattr(minhash, name, value)
    monkeypatch.setattr(runtime, "scratch_dir", lambda _: str(tmp_path))
    rng, rows = np.random.default_rng(8), []
    form = some_words(rng, 80)
    for i in range(30):
        words = form + some_words(rng, 40)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    assert minhash.keep_one(odd(spark, rows)).count() == 30
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "stay" in left and not left & {"sketches", "texts", "shingles", "prefixes", "candidates", "slots"}
