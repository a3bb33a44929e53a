import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import difference
from umbel import plans
from umbel.operators import aggregates as agg
from umbel.operators import confidence as conf
from umbel.operators import aggregates, papers, quality, readiness, selection

SCHEMA = """code string, name string, name_corrected string, synonyms array<string>, definition string, node_ids array<string>,
  prevalence_class string, gene_class string, genes array<string>, papers long, recent long, studies long, registered long, parent_studies long,
  fully_scanned boolean, papers_error string, studies_error string, tried array<string>, hit array<string>, probe_label string, probe_hits long,
  people long, recall_terms array<string>, query string, study_query string, secondary_errors array<string>, secondary_fetched long"""
BASE = dict(
    code="1", name="Distinct alpha condition name", name_corrected=None, synonyms=[], definition="d", node_ids=["M"], prevalence_class="1-9 / 100 000",
    gene_class="None", genes=[], papers=10, recent=5, studies=1, registered=1, parent_studies=None, fully_scanned=True, papers_error=None, studies_error=None,
    tried=["phrase"], hit=["phrase"], probe_label=None, probe_hits=None, people=3, recall_terms=[], query="", study_query="", secondary_errors=[], secondary_fetched=0,
)
FIELDS = list(BASE)


def frame(spark, *changes):
    rows = [{**BASE, "code": str(i + 1), "name": f"Distinct alpha condition {i} name", **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], SCHEMA)


def derived(spark, **change):
    return conf.derive(frame(spark, change)).first()


@pytest.mark.parametrize("change,health", [
    ({}, "ok"),
    ({"papers": 0, "registered": 0, "studies": 0}, "broken"),
    ({"papers": 0, "registered": 0, "studies_error": "x"}, "suspect"),
    ({"papers": None, "registered": 0}, "ok"),
    ({"name_corrected": "x"}, "suspect"),
    ({"tried": ["phrase", "mesh"]}, "suspect"),
    ({"tried": ["phrase", "mesh"], "hit": ["phrase", "mesh"]}, "ok"),
])
def test_health(spark, change, health):
    assert derived(spark, **change)["health"] == health


@pytest.mark.parametrize("change,confidence,excluded", [
    ({}, "high", False),
    ({"name": "Short"}, "medium", False),
    ({"synonyms": ["abc"]}, "medium", False),
    ({"papers": 0, "gene_class": "Strong"}, "low", True),
    ({"papers": 0, "gene_class": "Strong", "papers_error": "x"}, "high", False),
    ({"definition": None, "node_ids": []}, "low", False),
    ({"prevalence_class": "<1 / 1 000 000", "papers": 500}, "low", False),
    ({"prevalence_class": "<1 / 1 000 000", "papers": 200}, "medium", False),
    ({"prevalence_class": None, "papers": 1000}, "low", False),
    ({"prevalence_class": "Unknown", "papers": 999}, "high", False),
    ({"studies": 40, "papers": 15}, "medium", False),
    ({"studies": 80, "papers": 15}, "low", False),
    ({"papers": 0, "probe_hits": 50}, "low", True),
    ({"papers": 0, "probe_hits": 49}, "high", False),
    ({"papers": 0, "registered": 0, "studies": 0}, "low", False),
    ({"name": "Distinct TomÚ condition name"}, "low", False),
])
def test_confidence(spark, change, confidence, excluded):
    got = derived(spark, **change)
    assert (got["confidence"], got["excluded"]) == (confidence, excluded)


def test_collisions_lower_confidence_without_pairs(spark):
    df = frame(spark, *[{"synonyms": ["Shared label here"]} for _ in range(30)])
    got = conf.name_collisions(df).where("code = '2'").collect()
    assert [(r["others"], r["shown_owners"]) for r in got] == [(29, ["1", "3", "4"])]
    assert conf.derive(df).select("confidence").distinct().first()[0] == "medium"


def test_null_is_not_zero_and_gates_are_separate(spark):
    df = conf.derive(frame(
        spark,
        {"studies": 0, "recent": 0}, {"studies": None, "registered": None, "studies_error": "x"}, {"papers": None, "recent": None, "papers_error": "x"},
        {"papers": 0, "registered": 0, "studies": 0, "recent": 0}, {"studies": 0, "parent_studies": 4, "fully_scanned": True}, {"studies": 0, "fully_scanned": False},
    ))
    got = agg.headline_counts(df).first()
    assert got["total"] == 6 and got["broken"] == 1 and got["incomplete"] == 2
    assert (got["papers_denominator"], got["studies_denominator"], got["both_denominator"]) == (4, 3, 2)
    assert (got["no_studies"], got["no_studies_inclusive"], got["no_recent_papers"], got["no_recent_no_studies"]) == (2, 1, 1, 1)
    assert all(r["ok"] for r in quality.aggregate_invariants(agg.headline_counts(df)).collect())
    assert agg.headline_range(agg.headline_counts(df)).first()["high"] == 66.7


def test_defensibility_splits_at_the_median(spark):
    df = conf.derive(frame(spark, {"studies": 0, "recent": 9}, {"studies": 0, "recent": 1}, {"recent": 5}))
    got = agg.defensibility(df).first()
    assert (got["substantial_literature"], got["no_literature"]) == (1, 1)


def test_audit(spark):
    df = conf.derive(frame(
        spark, {"recall_terms": ["KRAS"]}, {"recall_terms": ["some parent label"]}, {"name": "Bad Þ name of alpha"},
        {"studies": 30, "papers": 2}, {"studies": 0, "recall_terms": []}, {"query": "x disease or disorder"},
        {"secondary_errors": ["ctis", "isrctn"]},
    )).withColumn("in_studies_denominator", conf.credible("studies"))
    a = agg.headline_counts(df).select("studies_denominator", (F.col("no_studies") + 1).alias("no_studies"), F.lit(0.9).alias("share_zero"))
    v = spark.createDataFrame([("human review", "two models")], "method string, reviewed_by string")
    got = {(r["issue"], r["code"]) for r in quality.audit_issues(df, a, v).collect()}
    assert got == {
        ("high-frequency-oncogene-in-trial-query", "1"), ("label-encoding-corrupt", "3"), ("trials-exceed-publications", "4"),
        ("no-parent-tier-despite-mondo-ancestry", "5"), ("ontology-speak-divergence", "6"), ("secondary-registries-all-sources-failed", "7"),
        ("notrials-mismatch", None), ("share-does-not-match-counts", None), ("parent-term-contamination", None), ("validation-method-mislabelled", None),
    }
    assert {r["code"] for r in df.where(conf.contaminated()).collect()} == {"1", "2"}


def test_refresh_guards(spark):
    row = lambda n, z, s: spark.createDataFrame([(n, z, s)], "rows long, no_studies long, sources string")
    bad = {r["guard"] for r in quality.refresh_guards(row(10, 100, "a"), row(9, 110, "b")).collect() if not r["ok"]}
    assert bad == {"row-count", "sources-unchanged", "zero-count-drift"}
    assert all(r["ok"] for r in quality.refresh_guards(row(10, 100, "a"), row(10, 110, "a"), accuracy_batch=True).collect())


def test_readiness(spark):
    extra = {"models": "long", "phenotypes": "long", "other_phenotypes": "long", "designations": "long", "approved": "long", "fda_count": "long", "ema_count": "long"}
    def run(change, **more):
        df = conf.derive(frame(spark, change))
        for c, kind in extra.items():
            df = df.withColumn(c, F.lit(more.get(c)).cast(kind))
        return readiness.readiness_summary(readiness.readiness_stages(df)).first()

    got = run({"studies": 0, "gene_class": "Strong", "genes": ["A"]}, models=2, phenotypes=None, other_phenotypes=3, designations=2, approved=0)
    assert [s["status"] for s in got["stages"]] == ["met", "met", "met", "met", "partial", "absent"]
    assert (got["summary"], got["filled"], got["scored"]) == ("gene-and-model-no-study", 5, 6)
    assert run({})["summary"] == "study-matched"
    assert run({"studies": 0, "parent_studies": 2})["summary"] == "broader-study-only"
    assert run({"studies": 0, "genes": ["A"]})["summary"] == "gene-and-papers-no-study"
    assert run({"studies": 0, "papers": 0})["summary"] == "sparse-signals"
    assert run({"studies": 0, "papers": 0, "registered": 0})["summary"] == "query-returned-nothing"
    assert run({"studies": None})["summary"] == "checklist-only"


def test_queue_and_targets(spark):
    q = spark.createDataFrame([("2", "2024-01-02"), ("9", "2024-01-01")], "code string, at string").withColumn("at", F.to_timestamp("at"))
    c = spark.createDataFrame([("1", None), ("2", None), ("3", "2020-01-01")], "code string, last_check string").withColumn("last_check", F.to_timestamp("last_check"))
    known = spark.createDataFrame([("1",), ("2",), ("3",)], "code string")
    got = selection.priority_queue(q, c, known, 3).collect()
    assert [(r["code"], r["origin"]) for r in got] == [("2", "queue"), ("1", "contamination"), ("3", "contamination")]
    rows, missing = selection.select_targets(known, spark.createDataFrame([("3",), ("7",)], "code string"))
    assert [r["code"] for r in rows.collect()] == ["3"] and [r["code"] for r in missing.collect()] == ["7"]
    one = spark.range(1).withColumn("level", F.lit(0))
    assert selection.band_positions(one, "level", ["id"]).first()["position"] == 0.5


def test_bands_hold_zero_negative_and_missing_values(spark, tmp_path):
    rows = [(1, 0.0), (2, -3.0), (3, None), (4, 4.9), (5, 5.0), (6, 600.0), (7, 50.0), (8, float("nan")), (9, 1.0)]
    spark.createDataFrame(rows, "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = plans.QUERIES["band_positions"](spark, str(tmp_path))
    assert difference(got.columns, got.collect(), con, plans.ORACLES["band_positions"]) is None


def test_display_order_puts_accents_beside_their_letters(spark):
    rows = [("1", "Zebra"), ("2", "Äpfel"), ("3", "apple"), ("4", "Apfel"), ("5", "banana")]
    cells = spark.createDataFrame([(c, n, 3, n) for c, n in rows], "code string, name string, papers int, group string")
    names = lambda df, c="name": [r[c] for r in df.collect()]
    assert names(selection.landscape_order(cells, "papers", "papers", "alpha", "UNICODE")) == ["Apfel", "Äpfel", "apple", "banana", "Zebra"]
    assert names(selection.landscape_order(cells, "papers", "papers", "alpha")) == ["Apfel", "Zebra", "apple", "banana", "Äpfel"]
    assert names(selection.landscape_order(cells, "papers", "papers", collation="UNICODE")) == ["Apfel", "Äpfel", "apple", "banana", "Zebra"]
    assert names(aggregates.landscape_groups(cells, collation="UNICODE"), "group") == ["Apfel", "Äpfel", "apple", "banana", "Zebra"]
    scored = cells.selectExpr("*", "0 AS recent", "0 AS studies", "0 AS people", "'None' AS gene_class", "false AS excluded", "'ok' AS health")
    assert names(selection.neglect_ranking(scored, 3, "UNICODE")) == ["Apfel", "Äpfel", "apple"] and names(selection.neglect_ranking(scored, 3)) == ["Apfel", "Zebra", "apple"]
    authors = spark.createDataFrame([("e", n.lower(), n, None, 2000, i) for i, n in rows], "entity string, author string, display string, affiliation string, year int, at string")
    leaders = papers.researchers(authors, "entity", ["at"], 3, "UNICODE")[1].orderBy("rank")
    assert names(leaders, "display") == ["Apfel", "Äpfel", "apple"]


def test_findings_show_the_curated_labels_first(spark):
    base = "code string, name string, papers long, probe_label string, probe_hits long, health string, health_reasons array<string>"
    rows = [(str(c), f"label {c}", 0, "wide parent", 60 + c, "ok", []) for c in range(1, 8)]
    rows += [("20", "AB12-related disorder", 2, None, None, "ok", []), ("21", "CD-related disorder", 9, None, None, "ok", []), ("9", "broken one", 0, None, None, "broken", ["why"]), ("10", "broken two", 0, None, None, "broken", [])]
    rows += [("30", "x" * 50, 0, "wide parent", 70, "ok", []), ("31", "a-b", 0, "disease", 90, "ok", [])]
    df = spark.createDataFrame(rows, base)
    bad = spark.createDataFrame([("5", "name", "form", "upstream"), ("6", "name", "form", "parser")], "code string, name string, form string, origin string")
    shown = lambda curated: {(r["section"], r["rank"]): (r["code"], r["detail"]) for r in aggregates.findings_examples(df, bad, curated).collect()}
    some = shown(["7", "3", "404", "5", "2", "1"])
    assert [some["hyper-specific", i][0] for i in (1, 2, 3, 4)] == ["7", "3", "5", "2"]
    few = shown(["7", "404"])
    assert {k: v for k, v in few.items() if k[0] != "hyper-specific"} == {
        ("broken", 1): ("9", "why"), ("broken", 2): ("10", "every search strategy returned zero"), ("defect", 1): ("5", "form"), ("gene-related", 1): ("20", "gene-related"),
    }
    assert [few["hyper-specific", i][0] for i in (1, 2)] == ["30", "20"] and len(few) == 6
