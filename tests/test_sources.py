import json
import random

import pytest
from pyspark.sql import functions as F

from umbel.operators import defects
from umbel import runtime
from umbel.runtime import scratch_path
from umbel.operators import name_index, reconcile, registries, terms
from umbel.sources import catalogue, ontology, policy, publishing, records, sinks, snapshots, xmlsplit

CATALOGUE = """<?xml version="1.0" encoding="UTF-8"?>
<JDBOR date="2024"><DisorderList count="3">
<Disorder id="1"><OrphaCode>58</OrphaCode><ExpertLink lang="en">http://www.orpha.net/58</ExpertLink><Name lang="en">Sj&#246;gren &amp; co</Name>
 <SynonymList count="1"><Synonym lang="en">SS</Synonym></SynonymList>
 <ExternalReferenceList count="2"><ExternalReference id="1"><Source>MONDO</Source><Reference>12</Reference></ExternalReference>
 <ExternalReference id="2"><Source>OMIM</Source><Reference>9</Reference></ExternalReference></ExternalReferenceList>
 <SummaryInformationList count="1"><SummaryInformation id="1" lang="en"><TextSectionList count="2">
 <TextSection id="1" lang="en"><TextSectionType id="1"><Name lang="en">Definition</Name></TextSectionType><Contents>A &lt;i&gt;rare&lt;/i&gt; thing</Contents></TextSection>
 <TextSection id="2" lang="en"><TextSectionType id="2"><Name lang="en">Other</Name></TextSectionType><Contents>no</Contents></TextSection>
 </TextSectionList></SummaryInformation></SummaryInformationList>
 <DisorderGroup id="1"><Name lang="en">Disorder</Name></DisorderGroup><DisorderType id="2"><Name lang="en">Disease</Name></DisorderType></Disorder>
<Disorder id="2"><OrphaCode>60</OrphaCode><Name lang="en">OBSOLETE: Old</Name><DisorderGroup id="1"><Name lang="en">Disorder</Name></DisorderGroup></Disorder>
<Disorder id="3"><OrphaCode>61</OrphaCode><Name lang="en">A group</Name><DisorderGroup id="3"><Name lang="en">Group of disorders</Name></DisorderGroup></Disorder>
<Disorder id="4"><Name lang="en">No code</Name></Disorder>
</DisorderList></JDBOR>"""


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf8")
    return str(path)


def lines(tmp_path, name, rows):
    return put(tmp_path, name, "\n".join(json.dumps(r) for r in rows))


def test_catalogue(spark, tmp_path):
    df = catalogue.read_catalogue(spark, put(tmp_path, "c.xml", CATALOGUE))
    rows = {r["code"]: r for r in df.collect()}
    assert set(rows) == {"58", "60", "61"}
    r = rows["58"]
    assert (r["name"], r["synonyms"], r["definition"], r["node_ids"]) == ("Sjögren & co", ["SS"], "A rare thing", ["MONDO:0000012"])
    assert (r["link"], r["group"], r["type"]) == ("https://www.orpha.net/58", "Disorder", "Disease")
    assert rows["60"]["synonyms"] == [] and rows["60"]["definition"] is None and rows["60"]["link"].endswith("/60")
    usable, excluded, nodes = catalogue.usable_entities(df)
    assert [x["code"] for x in usable.collect()] == ["58"] and excluded.first()[0] == 1
    assert [(x["code"], x["node"]) for x in nodes.collect()] == [("58", "MONDO:0000012")]


def test_catalogue_without_its_list_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="shape"):
        catalogue.read_catalogue(spark, put(tmp_path, "c.xml", "<JDBOR><Other/></JDBOR>"))


def test_prevalence(spark, tmp_path):
    def p(kind, geo, cls):
        return f"<Prevalence><PrevalenceType><Name>{kind}</Name></PrevalenceType><PrevalenceGeographic><Name>{geo}</Name></PrevalenceGeographic><PrevalenceClass><Name>{cls}</Name></PrevalenceClass></Prevalence>"

    body = "".join(
        f"<Disorder><OrphaCode>{c}</OrphaCode><PrevalenceList>{''.join(ps)}</PrevalenceList></Disorder>"
        for c, ps in {"1": [p("A", "Europe", "x"), p("Point prevalence", "Worldwide", "1-9 / 100 000")], "2": [p("A", "B", ""), p("A", "B", "first"), p("A", "B", "second")], "3": []}.items()
    )
    df = catalogue.read_prevalence(spark, put(tmp_path, "p.xml", f"<JDBOR><DisorderList>{body}</DisorderList></JDBOR>"))
    assert {r["code"]: r["prevalence_class"] for r in df.collect()} == {"1": "1-9 / 100 000", "2": "first"}


def test_ontology(spark, tmp_path):
    iri = "http://purl.obolibrary.org/obo/MONDO_"
    doc = {"graphs": [{"meta": {"version": "v1"}, "nodes": [
        {"id": iri + "1", "lbl": "one", "type": "CLASS", "meta": {"xrefs": [{"val": "OMIM:1"}, {"val": "OMIM:1"}], "synonyms": [{"pred": "hasExactSynonym", "val": "uno"}, {"pred": "hasBroadSynonym", "val": "no"}]}},
        {"id": iri + "2", "lbl": "prop", "type": "PROPERTY"}, {"id": "http://x/HP_3", "lbl": "hp", "type": "CLASS"}, {"id": iri + "4", "type": "CLASS"}],
        "edges": [{"sub": iri + "1", "pred": "is_a", "obj": iri + "4"}, {"sub": iri + "1", "pred": "is_a", "obj": iri + "4"}, {"sub": iri + "1", "pred": "part_of", "obj": iri + "5"}]}]}
    nodes, edges, version = ontology.read_ontology(spark, put(tmp_path, "o.json", json.dumps(doc, indent=1)))
    got = {r["id"]: r for r in nodes.collect()}
    assert set(got) == {"MONDO:0000001", "MONDO:0000004"}
    assert (got["MONDO:0000001"]["xrefs"], got["MONDO:0000001"]["exact_synonyms"]) == (["OMIM:1"], ["uno"])
    assert [(r["child"], r["parent"]) for r in edges.collect()] == [("MONDO:0000001", "MONDO:0000004")] and version.first()[0] == "v1"


def test_evidence_with_a_shifted_row(spark, tmp_path):
    head = "disease_curie\tclassification_title\tgene_symbol\tdisease_original_curie\tsubmitted_run_date\n"
    body = "MONDO:0000001\tStrong\tA\tOrpha:7\t2021-02-03\nMONDO:0000001\tdefinitive!\t\tOMIM:1\tuuid-not-date\n\tLimited\tC\tORPHA:8\t2030-01-01\nMONDO:2\todd\tD\t\t2020-01-01\n"
    rows, version = ontology.read_evidence(spark, put(tmp_path, "e.tsv", head + body))
    assert {(r["key"], r["class"], r["gene"]) for r in rows.collect()} == {("MONDO:0000001", "Strong", "A"), ("ORPHA:7", "Strong", "A"), ("MONDO:0000001", "Definitive", "")}
    assert version.first()[0] == "2030-01-01"
    with pytest.raises(ValueError, match="gene_symbol"):
        ontology.read_evidence(spark, put(tmp_path, "bad.tsv", "disease_curie\tclassification_title\nx\ty\n"))


def test_studies_and_papers(spark, tmp_path):
    s = [{"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "", "officialTitle": "Official"}}}, {"protocolSection": {"identificationModule": {"briefTitle": "no id"}}}]
    got = records.read_studies(spark, lines(tmp_path, "s.json", s)).collect()
    assert [(r["nct_id"], r["title"], r["status"], r["conditions"]) for r in got] == [("N1", "Official", "UNKNOWN", [])]
    paged = records.read_studies(spark, lines(tmp_path, "pages.json", [{"studies": s}]), pages=True)
    assert paged.count() == 1
    p = [{"id": "p1", "pubYear": "2020", "authorString": "X Y", "authorList": {"author": {"lastName": "Solo", "initials": "A", "authorAffiliationDetailsList": {"authorAffiliation": {"affiliation": " Lab "}}}}},
         {"id": "p2", "pubYear": "n/a", "authorList": {"author": [{"lastName": "One"}, {"lastName": "Two", "authorAffiliationDetailsList": {"authorAffiliation": [{"affiliation": ""}, {"affiliation": "B"}]}}]}}, {"id": "p3"}]
    papers, authors = records.read_papers(spark, lines(tmp_path, "p.json", p))
    assert papers.count() == 3
    assert {(r["paper"], r["year"], r["last"], r["affiliation"]) for r in authors.collect()} == {("p1", 2020, "Solo", "Lab"), ("p2", None, "One", None), ("p2", None, "Two", "B")}


def test_designations_in_all_forms(spark, tmp_path):
    d = [{"_id": "1", "fda_orphan_drug": [
        {"generic_name": " G ", "orphan_designation": "Treatment of Alpha Disease", "designated_date": "2020-01-01"},
        {"generic_name": "H", "orphan_designation": {"original_text": "treatment of Beta", "umls": "C1"}},
        {"generic_name": "", "orphan_designation": {"parsed_text": ["Gamma", "x"], "original_text": "no", "umls": ["C2", " ", "C3"]}},
        {"generic_name": "J", "orphan_designation": "abc"}, {"generic_name": "K"}]}]
    got = records.read_fda_designations(spark, lines(tmp_path, "f.json", d)).collect()
    assert [(r["ids"], r["key"], r["row"]["generic"], r["row"]["text"]) for r in got] == [
        ([], "alpha disease", "G", "Treatment of Alpha Disease"), (["C1"], "beta", "H", "treatment of Beta"), (["C2", "C3"], "gamma x", "unknown", "Gamma x"),
        ([], None, "J", "abc"), ([], None, "K", "")]
    e = {"data": [{"medicine_name": "M", "active_substance": "", "intended_use": "Diagnosis of Delta syndrome", "status": "Positive"}, {"medicine_name": "", "intended_use": "abc"}]}
    got = records.read_ema_designations(spark, put(tmp_path, "e.json", json.dumps(e))).collect()
    assert [(r["key"], r["row"]["generic"]) for r in got] == [("delta syndrome", "M"), (None, "unknown")]


def test_registries(spark, tmp_path):
    c = lines(tmp_path, "ctis.json", [{"ctNumber": "2022-500001-12-00", "ctTitle": "T nct01234567", "conditions": "a, b;c", "ctStatus": 3, "trialPhase": "II"}, {"ctTitle": "no id"}])
    got = records.read_registry_trials(spark, c, "ctis").collect()
    assert [(r["nct_id"], r["status"], r["conditions"], r["study_type"]) for r in got] == [("NCT01234567", "Authorised, recruiting", ["a", "b", "c"], "CTIS II")]
    x = put(tmp_path, "t.xml", "<trials><trial><trial_id>12345678</trial_id><public_title>P</public_title><condition>x|y; z</condition></trial><trial><scientific_title>Only title</scientific_title></trial></trials>")
    who = {r["title"]: r for r in records.read_registry_trials(spark, x, "ictrp").collect()}
    assert who["P"]["registry"] == "ictrp" and who["P"]["conditions"] == ["x", "y", "z"] and who["Only title"]["id"].startswith("ictrp-")
    isr = records.read_registry_trials(spark, x, "isrctn").collect()
    assert [r["id"] for r in isr] == ["ISRCTN12345678"]
    f = put(tmp_path, "f.xml", '<all><fullTrial><isrctn>isrctn00000007</isrctn><title>F</title><externalRef>NCT00000009</externalRef></fullTrial></all>')
    full = records.read_registry_trials(spark, f, "isrctn-full").first()
    assert (full["id"], full["nct_id"], full["url"]) == ("ISRCTN00000007", "NCT00000009", "https://www.isrctn.com/ISRCTN00000007")
    with pytest.raises(ValueError):
        records.read_registry_trials(spark, f, "nowhere")


def test_policy_rules(spark, tmp_path):
    doc = {"crowdfundingPortal": "", "officialDiseaseCounts": ["a"], "diseases": [{"orphaCode": "1", "name": "A", "group": 1, "source": "s", "mappingConfidence": "exact"}, {"name": "B", "group": 2, "source": ""}],
           "groupEntitlements": {"1": {"label": "l", "mechanism": "m", "caveat": ""}}, "centresOfExcellence": [{"name": "C1"}]}
    entries, ent, centres, problems = policy.read_policy(spark, put(tmp_path, "p.json", json.dumps(doc)))
    assert entries.count() == 2 and ent.first()["group"] == 1 and centres.count() == 1
    assert {(r["level"], r["rule"]) for r in problems.collect()} == {("ASSERT", "portal-missing"), ("WARN", "centre-count"), ("ASSERT", "centre-source-missing"), ("ASSERT", "entitlement-incomplete"), ("ASSERT", "entry-incomplete")}


def test_refresh_log_skips_bad_lines_keeps_undated(spark, tmp_path):
    path = put(tmp_path, "l.jsonl", '{"kind":"live-check","orphaCode":"1","ranAt":"2024-01-01T00:00:00Z"}\nnot json\n{"kind":"refresh-queue","orphaCode":"2"}\n')
    got = policy.read_refresh_log(spark, path).orderBy("seq").collect()
    assert [(r["code"], r["at"] is None) for r in got] == [("1", False), ("2", True)]


def test_upgrade_never_invents_signals(spark):
    df = spark.createDataFrame([("1", 0, 0, ["recall-expansion"]), ("2", 5, 3, None), ("3", None, None, None)], "code string, papers long, studies long, hit array<string>")
    got = {r["code"]: r for r in policy.upgrade_schema(df).collect()}
    assert got["1"]["matched_via"] == ["recall-expansion"] and got["2"]["matched_via"] == ["phrase"]
    assert got["3"]["hit"] == [] and got["3"]["registered"] is None and got["2"]["registered"] == 3


def test_snapshots_and_gates(spark):
    path = scratch_path(spark, "snap")
    df = spark.range(3)
    snapshots.write_snapshot(df, path, "2024-01-01")
    snapshots.write_snapshot(df.limit(1), path, "2024-02-01")
    with pytest.raises(FileExistsError):
        snapshots.write_snapshot(df, path, "2024-02-01")
    snapshots.write_snapshot(df.limit(0), path, "2023-02-01")
    listed = [tuple(r) for r in snapshots.list_snapshots(spark, path).collect()]
    assert listed == [("2024-02-01", 1), ("2024-01-01", 3), ("2023-02-01", 0)]
    assert snapshots.latest_snapshot(spark, path).count() == 1
    old = snapshots.read_snapshot(spark, path, "2023-02-01")
    assert old.columns == ["id"] and old.isEmpty()
    rows = spark.createDataFrame([("1", 1, True), ("2", None, False)], "code string, studies long, fully_scanned boolean")
    assert sinks.publish_gate(rows, 2) is rows
    for bad in (lambda: sinks.publish_gate(rows, 3), lambda: sinks.publish_gate(rows, 2, 1), lambda: sinks.publish_gate(rows.withColumn("studies", F.lit(1)), 2)):
        with pytest.raises(ValueError, match="not published"):
            bad()
    run = lambda seed: spark.createDataFrame([("sample", 300, seed)], "mode string, n int, seed int")
    assert sinks.compatible_resume(run(42), run(42)) is not None
    with pytest.raises(ValueError, match="resume refused"):
        sinks.compatible_resume(run(42), run(43))
    assert sinks.progress(df, 8).first()["percent"] == 37.5 and sinks.progress(df, 2).first()["percent"] == 100.0
    prov = spark.createDataFrame([("2024-01-01T00:00:00Z", None, "2024-03-01T00:00:00Z")], "last_full_ingest string, last_refresh string, generated_at string")
    assert str(sinks.artifact_date(prov).first()[0]) == "2024-03-01 00:00:00"


def test_defect_origin(spark):
    suspects = spark.createDataFrame([(c, "k", "glader") for c in "abcde"], "code string, kind string, form string")
    raw = spark.createDataFrame([("a", "Glader x", []), ("b", "ok", []), ("c", "ok", ["GLADER"]), ("d", "ok", [])], "code string, name string, synonyms array<string>")
    parsed = spark.createDataFrame([("a", "Glader x"), ("b", "glader"), ("d", "ok")], "code string, parsed string")
    got = {r["code"]: r["origin"] for r in defects.classify_defects(suspects, raw, parsed).collect()}
    assert got == {"a": "upstream", "b": "parser", "c": "upstream", "d": "not-reproduced", "e": "not-reproduced"}
    hits = defects.label_hits(spark.createDataFrame([("1", "microcephalicdwarfism", []), ("2", "x", ["gallblader stone"])], "code string, name string, s array<string>"), "code", "name", "s", defects.PATTERNS)
    assert {(r["pattern"], r["in_name"], r["in_any"]) for r in defects.label_defect_scan(hits).collect()} == {("joined-words", 1, 1), ("gallblader", 0, 1)}


def test_a_comparison_reads_the_buckets_that_differ(spark):
    path = scratch_path(spark, "snap")
    row = F.struct(F.col("id").alias("k"), (F.col("id") * 3).alias("n"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("s"))
    before = spark.range(4000).select(row.alias("r")).select("r.*")
    after = before.where("k != 17").withColumn("s", F.when(F.col("k") == 99, None).otherwise(F.col("s"))).unionByName(spark.sql("SELECT 9000L AS k, 1L AS n, 'x' AS s"))
    snapshots.write_snapshot(before, path, "2024-01-01", "k")
    snapshots.write_snapshot(after.repartition(7), path, "2024-02-01", "k")
    snapshots.write_snapshot(before.repartition(5).select("s", "n", "k"), path, "2024-03-01", "k")
    assert snapshots.changed_buckets(spark, path, "2024-01-01", "2024-03-01") == []
    changed = snapshots.changed_buckets(spark, path, "2024-01-01", "2024-02-01")
    of = spark.createDataFrame([(17,), (99,), (9000,)], "k long").select(snapshots._bucket("k", snapshots.BUCKETS).alias("b"))
    assert changed == sorted({r["b"] for r in of.collect()})
    plan = snapshots.read_snapshot(spark, path, "2024-01-01", changed)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    got = {(r["k"], r["change"], r["field"]) for r in snapshots.diff_snapshots(spark, path, "2024-01-01", "2024-02-01", "k", ["n", "s"]).collect()}
    assert got == {(17, "lost", None), (9000, "added", None), (99, "changed", "s")}
    assert got == {(r["k"], r["change"], r["field"]) for r in reconcile.snapshot_diff(before, after, "k", ["n", "s"]).collect()}
    snapshots.write_snapshot(before, path, "2024-04-01", "k", buckets=8)
    with pytest.raises(ValueError, match="not laid out alike"):
        snapshots.changed_buckets(spark, path, "2024-01-01", "2024-04-01")


def test_one_writer_of_a_date_wins(spark, monkeypatch):
    path, df = scratch_path(spark, "snap"), spark.range(5)
    # Both saw no claim; the second comes to it after the first.
    monkeypatch.setattr(snapshots, "path_exists", lambda *a: False)
    snapshots.write_snapshot(df, path, "2024-01-01")
    with pytest.raises(FileExistsError):
        snapshots.write_snapshot(df.limit(2), path, "2024-01-01")
    assert snapshots.latest_snapshot(spark, path).count() == 5
    assert runtime.claim_file(spark, f"{path}/one") and not runtime.claim_file(spark, f"{path}/one")


def test_one_root_is_read_by_many_tasks(spark, tmp_path):
    record = '<Disorder id="{0}">\n <OrphaCode>{0}</OrphaCode><Name lang="en">Name &amp; {0}</Name>\n <DisorderGroup id="1"><Name>Disorder</Name></DisorderGroup>\n</Disorder>\n'
    file = tmp_path / "one.xml"
    file.write_text('<?xml version="1.0" encoding="UTF-8"?>\n<JDBOR date="x"><DisorderList count="3">' + "".join(record.format(i) for i in range(20000)) + "</DisorderList></JDBOR>\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        rows = xmlsplit.read_records(spark, str(file), "Disorder", catalogue.CATALOGUE)
        sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 15 and max(sizes) < 20000 / 8
        whole = spark.read.format("xml").option("rowTag", "Disorder").option("multiLine", True).schema(catalogue.CATALOGUE).load(str(file))
        assert rows.exceptAll(whole).isEmpty() and whole.exceptAll(rows).isEmpty() and rows.count() == 20000
        assert catalogue.read_catalogue(spark, str(file)).where("name = 'Name & 7'").count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_publishing_by_the_figures_of_the_write(spark):
    rows = spark.createDataFrame([("1", 1, True), ("2", None, False), ("3", 4, True)], "code string, studies long, fully_scanned boolean")
    path = scratch_path(spark, "published")
    with pytest.raises(Exception):
        publishing.read_published(spark, path)
    assert publishing.publish(rows, path, 3).first()["published"]
    bad = publishing.publish(rows.withColumn("fully_scanned", F.lit(None).cast("boolean")), path, 4, failed=1).first()
    assert (bad["published"], bad["rows"], bad["incomplete"]) == (False, 3, 2)
    assert bad["reasons"] == ["entities-failed", "wrong-number-of-rows", "not-fully-scanned"]
    assert publishing.read_published(spark, path).where("fully_scanned").count() == 2
    assert publishing.publish(rows.limit(0), path, 0).first()["published"] and publishing.read_published(spark, path).isEmpty()
    log = scratch_path(spark, "done")
    assert tuple(publishing.append_done(rows, log, 8).first()) == (3, 3, 8, 37.5)
    assert tuple(publishing.append_done(rows.limit(0), log, 8).first()) == (0, 3, 8, 37.5)
    assert tuple(publishing.append_done(rows, log, 5).first()) == (3, 6, 5, 100.0)
    assert tuple(publishing.write_sample(rows, scratch_path(spark, "s"), "x", ["code"], 2).first()) == (2, 2, True)
    assert tuple(publishing.write_sample(rows, scratch_path(spark, "s"), "x", ["code"], 4).first()) == (4, 3, False)


def test_name_index_gives_what_a_scan_gives(spark):
    rnd, parts = random.Random(11), ["alpha", "beta", "gamma", "syn", "drome", "é", " of ", "-", "type", "X"]
    label = lambda: "".join(rnd.choices(parts, k=rnd.randint(1, 4)))
    rows = [(str(i * 7), label(), [label() for _ in range(rnd.randint(0, 3))]) for i in range(300)] + [("9999", None, None), ("12", "ab", [])]
    entities = spark.createDataFrame(rows, "code string, name string, synonyms array<string>")
    path = scratch_path(spark, "names")
    name_index.build_index(entities, path)
    asked = {label()[rnd.randint(0, 3) :][: rnd.randint(1, 9)] for _ in range(1100)} | {"ORPHA:14", "orpha7", "orpha", "12", " Beta ", "ab", "%_", "orpha:1", "zz", "a"}
    needles = spark.createDataFrame([(q,) for q in asked] + [(None,)], "q string")
    got = {}
    for r in name_index.search(spark, path, needles).collect():
        got.setdefault(r["q"], set()).add(r["code"])
    low = [(c, [x.lower() for x in [n, *(s or [])] if x is not None]) for c, n, s in rows]
    for q in asked:
        typed = q.strip(" ").lower()
        bare = typed.removeprefix("orpha").removeprefix(":") if typed.startswith("orpha") else typed
        want = {c for c, labels in low if bare in c or any(typed in x for x in labels)} if len(typed) >= 2 else set()
        assert got.get(q, set()) == want, q
    first = name_index.first_found(name_index.search(spark, path, spark.createDataFrame([("beta",)], "q string"))).orderBy("rank").collect()
    assert [r["code"] for r in first] == [r["code"] for r in terms.search_entities(entities, "beta").collect()]
    plan = name_index.search(spark, path, needles)._jdf.queryExecution().executedPlan().toString()
    assert "/names-" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_attached_clusters_equal_one_run(spark):
    rnd = random.Random(5)
    keys = [(i, f"c{i // 2}") for i in range(60)] + [(i, f"c{(i + 1) // 2}") for i in range(60)]  # one long chain
    keys += [(1000 + i, f"k{rnd.randrange(150)}") for i in range(300)] + [(5000, "alone")]
    whole = {(r["rid"], r["cluster"]) for r in registries.components(spark.createDataFrame(keys, "rid long, key string")).collect()}
    batches = [[k for k in keys if k[0] % 4 == b] for b in (2, 0, 3, 1)]
    table = lambda rows: spark.createDataFrame(rows, "rid long, key string")
    clusters = registries.components(table(batches[0])).select("rid", "cluster")
    kept = registries.kept_keys(table(batches[0]), clusters)
    for rows in batches[1:]:
        clusters, kept = registries.attach(clusters, kept, table(rows))
    assert {(r["rid"], r["cluster"]) for r in clusters.collect()} == whole and kept.count() == len({k for _, k in keys})
    again, _ = registries.attach(clusters, kept, table([]))
    assert again.count() == len(whole)


def test_a_folder_of_the_name_index_has_as_many_files_as_its_rows_ask_for(spark, monkeypatch):
    entities = spark.createDataFrame([(str(i), f"alpha beta {i}", ["gamma"]) for i in range(400)], "code string, name string, synonyms array<string>")
    needles = spark.createDataFrame([("alpha",), ("39",), ("ta 7",), ("orpha:1",)], "q string")
    found = []
    for rows in (1_000_000, 100):
        for module in (runtime, name_index):
            monkeypatch.setattr(module, "TASK_ROWS", rows)
        path = scratch_path(spark, "names")
        name_index.build_index(entities, path, buckets=2)
        found.append(sorted(name_index.search(spark, path, needles, buckets=2).collect()))
    assert found[0] == found[1] and len(found[0]) > 400
    assert len(spark.read.parquet(f"{path}/postings").inputFiles()) > 2 * 8
