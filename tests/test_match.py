import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tests.compare import connect, difference
from umbel import plans
from umbel import runtime
from umbel.operators import match, studies, tagging


def norm(s):
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split())


@pytest.fixture(params=["broadcast", "slices"])
def path(request, monkeypatch):
    if request.param == "slices":
        monkeypatch.setattr(runtime, "BROADCAST_BYTES", 200)
    return request.param


def sample(seed=7):
    rnd = random.Random(seed)
    words = ["the", "gene", "rare", "type", "alpha", "beta", "syndrome", "of", "xx", "lung"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 25))) + rnd.choice([".", "", "\n"])) for i in range(120)]
    terms = [(i % 9, " ".join(rnd.choices(words, k=rnd.randint(1, 4)))) for i in range(60)]
    return docs, terms


def test_phrase_match_equals_nested_loop(spark, path):
    docs, terms = sample()
    d = spark.createDataFrame(docs, "id long, text string")
    t = match.normal_terms(spark.createDataFrame(terms, "e long, term string"), "e")
    got = {(r["entity"], r["doc"]) for r in match.phrase_match(match.plain_texts(d, "id", "text"), t).collect()}
    want = {(e, i) for i, x in docs for e, term in terms if len(norm(term)) >= 4 and f" {norm(term)} " in f" {norm(x)} "}
    assert got == want and want


def test_title_minimum_and_labels(spark, path):
    s = spark.createDataFrame(
        [("N1", "Study of alpha", ["Beta disease"]), ("N2", "gamma thing", ["other"]), ("N3", "Alpha beta long", [])],
        "nct_id string, title string, conditions array<string>",
    )
    t = spark.createDataFrame(
        [("e", "phrase", "alpha"), ("e", "mesh", "beta disease"), ("e", "recall", "gamma"), ("e", "phrase", "alpha beta")],
        "entity string, strategy string, term string",
    )
    got = {r["doc"]: r["matched_via"] for r in match.classify_matches(match.phrase_match(match.study_texts(s), t)).collect()}
    # "alpha" is too short for a title under the phrase strategy.
    assert got == {"N1": "mesh", "N2": "recall-expansion", "N3": "phrase"}


def test_hot_token_in_every_document(spark, path):
    d = spark.createDataFrame([(i, "common word here" if i % 3 else "common thing") for i in range(300)], "id long, text string")
    t = match.normal_terms(spark.createDataFrame([("a", "common word"), ("b", "common"), ("c", "common thing")], "e string, term string"), "e")
    got = match.phrase_match(match.plain_texts(d, "id", "text"), t).groupBy("entity").count().collect()
    assert {r["entity"]: r["count"] for r in got} == {"a": 200, "b": 300, "c": 100}


def test_exact_terms(spark):
    e = spark.createDataFrame([(i, ["Shared name"]) for i in range(9)] + [(100, ["Own name", "own-name"])], "code long, terms array<string>")
    owned = match.owned_terms(e, "code", "terms")
    d = spark.createDataFrame(
        [("D1", ["own name"], ["OWN NAME"]), ("D2", ["shared name"], ["Own Name"])], "doc string, c array<string>, k array<string>"
    )
    got = match.exact_term_match(owned, d, "code", "doc", "c", "k").collect()
    assert {(r["code"], r["doc"], r["via"]) for r in got} == {(100, "D1", "condition"), (100, "D2", "keyword")}
    assert [r["owners"] for r in match.ambiguous_terms(owned).collect()] == [9]


def test_count_live_and_parent_tier(spark):
    d = match.plain_texts(spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "none")], "id long, t string"), "id", "t")
    q = spark.createDataFrame([("x", '"Alpha Beta" OR "gamma"'), ("y", '"zzzz"')], "e string, q string")
    assert {r["entity"]: r["live"] for r in match.count_live(q, d, "e", "q").collect()} == {"x": 2, "y": 0}
    wide = spark.createDataFrame([("x", 1), ("x", 9)], "entity string, doc long")
    own = spark.createDataFrame([("x", 1)], "entity string, doc long")
    assert [r["doc"] for r in match.parent_tier(wide, own).collect()] == [9]


def test_umbrella_studies_are_set_apart(spark):
    m = spark.createDataFrame([("e", "nct01793168 "), ("e", "NCT2")], "entity string, doc string")
    counted, umbrella = match.split_by_list(m, match.umbrella_list(m))
    assert counted.count() == 1 and umbrella.count() == 1


def test_fallback_never_gives_partial_counts(spark):
    tier = lambda rows: spark.createDataFrame(rows, "entity string, total long, complete boolean")
    got = studies.fallback_scan([
        tier([("a", 5, True), ("b", 900, False), ("c", 900, False)]),
        tier([("a", 3, True), ("b", 7, True), ("c", 800, False)]),
        tier([("c", 600, False)]),
    ]).collect()
    assert {r["entity"]: (r["total"], r["error"] is None) for r in got} == {"a": (5, True), "b": (7, True), "c": (None, False)}


def greedy(text, terms):
    """Longest term first over the text, left to right, no overlaps."""
    tokens, taken, spans = text.split(), set(), []
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        parts, at = term.split(), 0
        while at <= len(tokens) - len(parts):
            if tokens[at:at + len(parts)] == parts:
                if not taken & set(range(at, at + len(parts))):
                    taken |= set(range(at, at + len(parts)))
                    spans.append((at, len(parts), term))
                at += len(parts)
            else:
                at += 1
    return set(spans)


def test_dictionary_tags(spark, path):
    docs, terms = sample(11)
    d = spark.createDataFrame(docs, "id long, text string")
    got = tagging.dictionary_tags(d, spark.createDataFrame(terms, "e long, term string"), "id", "text").collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc"], set()).add((r["start"], r["size"], r["term"]))
    vocabulary = {norm(t) for _, t in terms}
    for i, text in docs:
        assert by_doc.get(i, set()) == greedy(norm(text), vocabulary)


def test_study_lists_are_capped_but_counts_are_not(spark):
    rows = [("e", f"N{i:03d}", "INTERVENTIONAL", "RECRUITING", "phrase") for i in range(40)] + [("e", "X1", None, "DONE", "mesh")]
    m = spark.createDataFrame(rows, "entity string, doc string, study_type string, status string, matched_via string")
    got = studies.study_signals(m.union(m)).first()
    assert (got["total"], got["recruiting_count"], got["expanded_access_total"], got["registered_total"]) == (40, 40, 1, 41)
    assert [r["doc"] for r in got["recruiting"]] == [f"N{i:03d}" for i in range(15)]
    assert got["strategies_with_hits"] == ["phrase", "mesh"]


@pytest.mark.parametrize("name", ["phrase_match", "phrase_match_texts", "study_signals", "publication_signals", "count_live", "dictionary_tags"])
def test_queries_with_terms_past_the_bound(spark, monkeypatch, name):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 1024 if name == "phrase_match" else 8192)
    sf = "/root/testdata/sf0.001"
    df = entry_points.queries()[name](spark, sf)
    assert difference(df.columns, df.collect(), connect(sf), entry_points.oracle_sql()[name]) is None


def test_text_is_scanned_and_never_moved(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 700)
    docs, terms = sample()
    d = match.plain_texts(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    t = match.normal_terms(spark.createDataFrame(terms, "e long, term string"), "e")
    assert len(match.anchored_slices(d, t)) > 2
    hits = match.term_hits(d, t)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_a_word_of_all_documents_is_no_anchor(spark, monkeypatch):
    d = match.plain_texts(spark.createDataFrame([(i, f"everywhere w{i} thing{i % 7}") for i in range(500)], "id long, text string"), "id", "text")
    # Among the terms alone the word is as rare as the others, and longer.
    t = match.normal_terms(spark.createDataFrame([(i, f"everywhere thing{i}") for i in range(1)] + [(9, "thing0 other")], "e long, term string"), "e")
    sketch = match.frequency_sketch(d)
    counts = {r["token"]: r["n_texts"] for r in match.estimated_frequency(spark.createDataFrame([("everywhere",), ("thing0",), ("nowhere",)], "token string"), sketch).collect()}
    assert counts["everywhere"] >= 500 and 72 <= counts["thing0"] < 100 and counts["nowhere"] < 10
    assert {r["term"]: r["anchor"] for r in match.anchored(t).collect()}["everywhere thing0"] == "everywhere"
    assert {r["term"]: r["anchor"] for r in match.anchored(t, sketch).collect()} == {"everywhere thing0": "thing0", "thing0 other": "other"}


def test_slices_hold_every_row_once(spark):
    df = spark.range(5000).select(F.col("id").alias("term"), F.lit("x" * 50).alias("pad"))
    slices = runtime.broadcast_slices(df, "term", 20_000)
    assert len(slices) > 20 and all(runtime.measured_bytes(s) <= 20_000 for s in slices)
    assert sorted(r["term"] for s in slices for r in s.collect()) == list(range(5000))
    assert len(runtime.broadcast_slices(df, "term")) == 1


def test_queries_that_read_matches_twice_search_the_text_once(spark):
    for name in ("fallback_scan", "split_by_list", "parent_tier"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan, name
