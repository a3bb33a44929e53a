import pytest
from pyspark.sql import functions as F

from umbel.operators import accuracy as acc
from umbel.operators import papers, reconcile

PARENT = "relevant-to-parent-category"


@pytest.mark.parametrize("a,b,want,hinted", [
    ("true", "true", "relevant", "relevant"), ("false", "false", "irrelevant", "irrelevant"), (PARENT, PARENT, "parent-category", "parent-category"),
    ("true", "false", "uncertain", "uncertain"), ("true", "uncertain", "uncertain", "parent-category"), ("false", PARENT, "uncertain", "uncertain"),
    ("uncertain", "uncertain", "uncertain", "parent-category"),
])
def test_consensus(spark, a, b, want, hinted):
    df = spark.createDataFrame([(a, b, True)], "first string, second string, hint boolean")
    got = df.select(acc.consensus().alias("c"), acc.consensus_with_hint("hint").alias("h")).first()
    assert (got["c"], got["h"]) == (want, hinted)


def test_votes(spark):
    rows = [("d", "a", '```json\n{"relevant": true, "reason": " ok "}\n```'), ("d", "b", '{"relevant": "maybe", "reason": "x"}'), ("e", "a", '{"relevant": false}'), ("e", "b", '{"relevant": "uncertain", "reason": "r"}')]
    v = acc.vote_validity(spark.createDataFrame(rows, "doc string, voter string, raw string"))
    assert {(r["doc"], r["voter"]): r["valid"] for r in v.collect()} == {("d", "a"): True, ("d", "b"): False, ("e", "a"): False, ("e", "b"): True}
    got = {r["doc"]: (r["first"], r["second"]) for r in acc.ballots(v, ["doc"], ("a", "b")).collect()}
    assert got == {"d": ("true", "uncertain"), "e": ("uncertain", "uncertain")}


def test_accuracy_nulls_and_empty_means(spark):
    labels = spark.createDataFrame(
        [("e", "1", "hard", "relevant"), ("e", "2", "hard", "relevant"), ("e", "3", "hard", "irrelevant"), ("f", "4", "easy", "uncertain")],
        "entity string, doc string, difficulty string, consensus string",
    )
    found = spark.createDataFrame([("e", "1"), ("e", "3"), ("e", "9")], "entity string, doc string")
    per = acc.entity_accuracy(labels, found)
    rows = {r["entity"]: r for r in per.collect()}
    assert (rows["e"]["recall"], rows["e"]["precision"], rows["f"]["recall"], rows["f"]["precision"]) == (0.5, 0.5, None, None)
    got = {r["difficulty"]: (r["recall"], r["precision"], r["coverage"]) for r in acc.accuracy(per).collect()}
    assert got == {"hard": (0.5, 0.5, 1.0), "easy": (1.0, 1.0, 0.0), "all": (0.5, 0.5, 0.75)}


def test_baseline(spark):
    row = lambda v, r: spark.createDataFrame([(v, r)], "version string, recall double")
    check = lambda *a: tuple(acc.baseline_check(*a).first())
    assert check(row("a", 0.9), row("a", 0.95)) == (True, True, False)
    assert check(row("a", 0.94), row("a", 0.95)) == (True, False, False)
    assert check(row("a", 0.96), row("a", 0.95)) == (True, False, True)
    assert check(row("b", 0.1), row("a", 0.95)) == (False, False, False)


def test_evidence_key_ignores_how_it_was_found(spark):
    df = spark.createDataFrame([("t", None, "broad"), ("t", None, "both"), ("u", None, "both")], "title string, kind string, via string")
    keys = [r[0] for r in df.select(acc.evidence_key(F.lit("v"), F.lit("1"), "title", "kind")).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_parent_hint(spark):
    c = spark.createDataFrame([("e", "1", ["Gaucher Disease, severe"]), ("e", "2", ["Gauchers"])], "entity string, doc string, conditions array<string>")
    e = spark.createDataFrame([("e", "Gaucher disease type 3", "Gaucher disease")], "entity string, name string, parent_label string")
    assert {r["doc"]: r["hint"] for r in acc.parent_hint(c, e).collect()} == {"1": True, "2": False}


def test_candidates_and_diff(spark):
    a = spark.createDataFrame([(1, "a"), (2, None)], "id int, f string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "id int, f string")
    got = {r["id"]: (r["f"], r["source"]) for r in reconcile.merge_candidates(a, b, "id", ["f"]).collect()}
    assert got == {1: ("a", "pipeline"), 2: (None, "both"), 3: ("b", "broad")}
    assert {(r["id"], r["change"], r["field"]) for r in reconcile.snapshot_diff(a, b, "id", ["f"]).collect()} == {(1, "lost", None), (3, "added", None), (2, "changed", "f")}


def test_people(spark):
    df = spark.createDataFrame([("Smith", "J.K.", None), ("X", "A", None), ("ABC Consortium", "A", None), ("Lee", "", "Ann-Mary")], "l string, i string, f string")
    assert [r[0] for r in df.select(papers.author_key("l", "i", "f")).collect()] == ["smith|jk", None, None, "lee|ann"]
    rows = [("e", "a|x", "First", None, 2001, 1), ("e", "a|x", "Second", "Lab 2", 2003, 2), ("e", "a|x", "Third", None, 2004, 3)]
    a = spark.createDataFrame(rows, "e string, author string, display string, affiliation string, year int, paper int")
    counts, top = papers.researchers(a, "e", ["paper"])
    assert counts.first()["people"] == 1
    assert tuple(top.select("display", "affiliation", "latest_year", "papers").first()) == ("First", "Lab 2", 2004, 3)


def test_series_window(spark):
    p = spark.createDataFrame([("e", 2020), ("e", 2020), ("e", 2005)], "k string, year int")
    e = spark.createDataFrame([("e",), ("f",)], "k string")
    series, recent = papers.yearly_series(p, e, "k", "year", 2024, 15)
    assert series.count() == 30 and series.where("k = 'e' and year = 2020").first()["n"] == 2
    assert {r["k"]: r["recent"] for r in recent.collect()} == {"e": 2, "f": 0}
    assert papers.yearly_series(p, e, "k", "year", 2024, 99)[0].count() == 60 and papers.yearly_series(p, e, "k", "year", 2024, 0)[0].count() == 0
