import random
import time
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from umbel.operators import designations, evidence, graph, identifiers, reconcile, registries

EDGE = "child string, parent string, pos int"


def closure(spark, edges, **kw):
    return {(r["node"], r["ancestor"]): r["depth"] for r in graph.ancestors(spark.createDataFrame(edges, EDGE), **kw).collect()}


def walked(rows):
    return {(r["node"], r["ancestor"]): (r["depth"], tuple(r["path"])) for r in rows.collect()}


def test_walks_from_starts_equal_the_closure_and_write_no_more(spark, monkeypatch):
    rng = random.Random(3)
    edges = spark.createDataFrame([(f"n{i}", f"n{rng.randrange(i + 1, i + 9)}", k) for i in range(90) for k in range(2)] + [("n95", "n90", 0), ("n96", "n90", 0)], EDGE)
    whole = walked(graph.ancestors(edges))
    assert walked(graph.small_ancestors(edges.where("child >= 'n7'"), 20)) == walked(graph.ancestors(edges.where("child >= 'n7'")))
    written = []
    real = graph.materialize

    def counted(df, label="stage", by=None):
        table = real(df, label, by)
        if label == graph.CLOSURE:
            written.append(table.count())
        return table

    monkeypatch.setattr(graph, "materialize", counted)
    kept = graph.KeptClosure(edges)
    some = kept.of(spark.createDataFrame([("n60",), ("n61",), (None,), ("gone",)], "node string"))
    want = {k: v for k, v in whole.items() if k[0] in ("n60", "n61")}
    assert walked(some) == want and sum(written) == len(want) < len(whole) / 4
    more = kept.of(spark.createDataFrame([("n61",), ("n80",)], "node string"))
    new = {k: v for k, v in whole.items() if k[0] == "n80"}
    assert walked(more) == {k: v for k, v in whole.items() if k[0] in ("n61", "n80")} and sum(written) == len(want) + len(new)
    for depth in (1, 2, 3):
        cut = graph.ancestors(edges, spark.createDataFrame([("n5",)], "node string"), max_depth=depth)
        assert walked(cut) == {k: v for k, v in whole.items() if k[0] == "n5" and v[0] <= depth}
    assert graph.ancestors(edges, spark.createDataFrame([], "node string")).isEmpty()


def test_ancestors_diamond_cycle_and_depth(spark):
    got = closure(spark, [("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("d", "a", 0)])
    assert got[("a", "d")] == 2 and ("a", "a") not in got and got[("d", "c")] == 2 and got[("b", "c")] == 3
    chain = [(f"n{i}", f"n{i + 1}", 0) for i in range(20)]
    assert max(d for (n, _), d in closure(spark, chain).items() if n == "n0") == 20
    assert max(d for (n, _), d in closure(spark, chain, max_depth=12).items() if n == "n0") == 12
    assert {a for (n, a) in closure(spark, chain, max_depth=3) if n == "n0"} == {"n1", "n2", "n3"}


def test_ancestor_order_is_walk_order(spark):
    edges = [("a", "z", 0), ("a", "b", 1), ("z", "y", 1), ("z", "x", 0), ("b", "w", 0)]
    rows = graph.ancestors(spark.createDataFrame(edges, EDGE)).where("node = 'a'").orderBy("depth", "path").collect()
    assert [r["ancestor"] for r in rows] == ["z", "b", "x", "y", "w"]


def test_rounds_of_the_closure_in_slices_leave_no_shuffle_files(spark, monkeypatch):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {p.name for d in folders for p in Path(d.getPath()).glob("*/shuffle_*")}
    rng = random.Random(7)
    rows = [(f"n{i}", f"n{rng.randrange(i + 1, i + 9)}", k) for i in range(60) for k in range(2)] + [("n64", "n50", 0), ("n63", "n63", 0)]
    edges = spark.createDataFrame(rows, EDGE)
    before, tables, real = files(), [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda *args: tables.append(real(*args)) or tables[-1])
    whole = walked(graph.ancestors(edges))
    for _ in range(50):  # they are removed soon after, not at once
        if files() <= before:
            break
        time.sleep(0.1)
    assert len(files() - before) < 20  # a stage that was cancelled may leave its own
    rounds = len(tables)
    tables.clear()
    monkeypatch.setattr(graph, "ROUND_ROWS", len(whole) // 2)
    assert walked(graph.ancestors(edges)) == whole
    assert len(tables) > rounds and sum(t.count() for t in tables) == len(whole)
    assert walked(graph.ancestors(edges, max_depth=5)) == {k: v for k, v in whole.items() if v[0] <= 5}


def test_nearest_and_probe_of_edges_equal_the_closure_and_write_no_more(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"n{i}", f"n{rng.randrange(i + 1, i + 9)}", k) for i in range(90) for k in range(2)]
    edges = spark.createDataFrame([*rows, ("n95", "n90", 0), ("n96", "n40", 0), ("n90", "n50", 1), ("n7", "n7", 3)], EDGE)  # cycles too
    whole = graph.ancestors(edges)
    pairs = walked(whole)
    marked = spark.createDataFrame([(f"n{i}",) for i in (20, 44, 45, 70, 96)] + [(None,)], "node string")
    starts = spark.createDataFrame([(f"n{i}",) for i in range(80)] + [(None,), ("gone",)], "node string")
    want = {}
    for (n, a), (d, p) in pairs.items():
        if int(n[1:]) < 80 and a in ("n20", "n44", "n45", "n70", "n96"):
            want[n] = min(want.get(n, (d, p, a)), (d, p, a))
    assert walked(graph.nearest(edges, starts, marked)) == {(n, a): (d, p) for n, (d, p, a) in want.items()}
    assert graph.nearest(edges, starts, marked.where("node is null")).isEmpty()

    labels = spark.createDataFrame([(f"n{i}", f"Label {i % 23}" if i % 7 else None) for i in range(100)], "id string, label string")
    hits = spark.createDataFrame([(f"label {i}", (i * 37) % 55) for i in range(20)], "label_key string, hits long")
    ids = spark.createDataFrame([(f"e{i}", f"n{j}", k) for i in range(80) for k, j in enumerate((i, i + 1))], "entity string, node string, pos int")
    written = []
    real = graph.materialize

    def counted(df, label="stage", by=None):
        table = real(df, label, by)
        if label == graph.CLOSURE:
            written.append(table.count())
        return table

    monkeypatch.setattr(graph, "materialize", counted)
    got = {r["entity"]: tuple(r) for r in graph.probe_edges(ids, edges, labels, hits).collect()}
    assert got == {r["entity"]: tuple(r) for r in graph.parent_probe(ids, whole, labels, hits).collect()}
    assert sum(written) < len(pairs) / 3


def test_probe_stops_at_first_well_covered_label(spark):
    ids = spark.createDataFrame([("e", "n0", 0)], "entity string, node string, pos int")
    c = graph.ancestors(spark.createDataFrame([(f"n{i}", f"n{i + 1}", 0) for i in range(12)], EDGE))
    labels = spark.createDataFrame([(f"n{i}", f"label {i}") for i in range(13)], "id string, label string")
    hits = spark.createDataFrame([("label 2", 10), ("label 3", 60), ("label 4", 999), ("label 9", 5000)], "label_key string, hits long")
    got = graph.parent_probe(ids, c, labels, hits).first()
    assert (got["label"], got["hits"]) == ("label 3", 60)
    got = graph.parent_probe(ids, c, labels, hits.where("hits not in (60, 999)")).first()
    assert (got["label"], got["hits"]) == ("label 2", 10)  # the ninth label is never read


def test_components_bridge_chain_and_hub(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (3, "b"), (9, "z")]  # 3 bridges two clusters
    rows += [(100 + i, f"k{i}") for i in range(64)] + [(100 + i, f"k{i + 1}") for i in range(64)]  # a chain
    rows += [(1000 + i, "hub") for i in range(500)]
    got = registries.components(spark.createDataFrame(rows, "rid long, key string")).collect()
    cluster = {r["rid"]: r["cluster"] for r in got}
    assert cluster[1] == cluster[2] == cluster[3] == 1 and cluster[9] == 9
    assert {cluster[100 + i] for i in range(64)} == {100} and {cluster[1000 + i] for i in range(500)} == {1000}


def test_registry_dedupe_fills_blanks(spark):
    schema = """rid long, id string, nct_id string, secondary_ids array<string>, title string, status string, registry string,
      url string, conditions array<string>, study_type string"""
    rows = [
        (1, "ISRCTN1", None, ["DRKS9"], "Short", None, "isrctn", "u1", [], None),
        (2, "X2", "NCT00000001", ["drks9"], "Other", "Open", "other", "u2", ["c"], "T"),
        (3, "Y3", None, [], "Lone record", None, "other", "u3", [], None),
    ]
    df = spark.createDataFrame(rows, schema)
    merged = {r["cluster"]: r for r in registries.registry_dedupe(df).collect()}
    first = merged[1]
    assert (first["id"], first["nct_id"], first["status"], first["conditions"], first["study_type"]) == ("ISRCTN1", "NCT00000001", "Open", ["c"], "T")
    assert merged[3]["records"] == 1
    comps = registries.components(registries.record_keys(df))
    ids = registries.cluster_ids(df, comps, registries.registry_dedupe(df)).collect()
    assert {r["other_id"] for r in ids} == {"DRKS9", "drks9"}


def test_dedupe_by_ids_in_texts_unites_them(spark, tmp_path):
    from tests.compare import difference
    from umbel.plans.registry import ORACLES, QUERIES

    texts = ["see NCT00000001 and drks00000009", "about DRKS00000009 too", "another one", None, "nct00000001, ISRCTN12345678, ISRCTN12345678"]
    rows = [(i, t, "en", f"s{i}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["registry_dedupe"](spark, str(tmp_path))
    data = [tuple(r) for r in got.collect()]
    ids = {r[0]: (r[1], r[3], r[-1]) for r in data}
    assert ids[0] == (3, "NCT00000001", "DRKS00000009|ISRCTN12345678|s0-32|s1-22|s4-43") and ids[2][0] == ids[3][0] == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(got.columns, data, con, ORACLES["registry_dedupe"]) is None


def test_routes_keep_everything_beyond_the_cap(spark):
    df = spark.createDataFrame([("e", i, "relevant") for i in range(45)], "entity string, k int, verdict string")
    got = registries.route_counts(registries.route_by_verdict(df, "entity", ["k"]), "entity").first()
    assert (got["kept"], got["uncertain"]) == (40, 5)


def test_routes_of_equal_records_lose_none(spark):
    rows = [("e", 1, "relevant")] * 3 + [("f", None, "irrelevant")]
    df = spark.createDataFrame(rows, "entity string, k int, verdict string")
    got = {r["entity"]: r.asDict() for r in registries.route_counts(registries.route_by_verdict(df, "entity", [F.desc("k")], cap=2), "entity").collect()}
    assert (got["e"]["kept"], got["e"]["uncertain"], got["f"]["dropped"]) == (2, 1, 1)
    assert registries.route_by_verdict(df, "entity", ["k"], cap=None).where("route = 'uncertain'").count() == 0


def test_best_evidence_unites_only_tied_keys(spark):
    keys = spark.createDataFrame([("e", "m1"), ("e", "m2"), ("e", "m3"), ("f", "none")], "entity string, key string")
    ev = spark.createDataFrame([("m1", 6, "A"), ("m1", 2, "B"), ("m2", 6, "C"), ("m3", 5, "D")], "key string, rank int, gene string")
    got = {r["entity"]: (r["rank"], r["symbols"]) for r in evidence.best_evidence(keys, ev, "entity", "key", "rank", "gene").collect()}
    assert got == {"e": (6, ["A", "B", "C"]), "f": (None, [])}


def test_policy_direct_then_nearest_ancestor_never_self(spark):
    policy = spark.createDataFrame([(1, "10", "Direct one", 1), (2, None, "Organic acidemia (any)", 2), (3, "20", "Own node", 3)], "policy_id int, code string, name string, group int")
    code_nodes = spark.createDataFrame([("10", "M10"), ("20", "M20")], "code string, node string")
    labels = spark.createDataFrame([("M5", "inborn organic aciduria"), ("M6", "obsolete organic acidemia (any)")], "id string, label string")
    nodes = evidence.policy_nodes(policy, code_nodes, labels)
    assert {(r["policy_id"], r["node"]) for r in nodes.collect()} == {(1, "M10"), (3, "M20"), (2, "M5")}
    ents = spark.createDataFrame([("a", "10"), ("b", "99"), ("c", "98")], "entity string, code string")
    ids = spark.createDataFrame([("a", "M10", 0), ("b", "M7", 0), ("c", "M20", 0)], "entity string, node string, pos int")
    c = graph.ancestors(spark.createDataFrame([("M7", "M5", 0), ("M5", "M10", 0)], EDGE))
    ent = spark.createDataFrame([(1, "one"), (2, "two")], "group int, entitlement string")
    got = {r["entity"]: r for r in evidence.policy_match(ents, ids, policy, nodes, c, ent).collect()}
    assert (got["a"]["via"], got["a"]["groups"], got["a"]["entitlements"]) == ("direct", [1], ["one"])
    assert (got["b"]["via"], got["b"]["ancestor"], got["b"]["label"], got["b"]["groups"]) == ("parent", "M5", "Organic acidemia (any)", [2])
    assert got["c"]["listed"] is False


def test_designations_by_id_then_by_name(spark):
    row = "struct<generic:string,text:string,date:string,status:string,number:string>"
    data = [(["C1"], "alpha disease", (f"g{i}", "alpha disease", f"2020-01-{i % 28 + 1:02d}", "FDA approved for orphan indication" if i == 3 else "d", str(i))) for i in range(20)]
    data += [([], "beta disease", ("g", "beta disease", "2019-01-01", "d", "x"))] * 2
    rows = spark.createDataFrame(data, f"ids array<string>, key string, row {row}")
    ids = spark.createDataFrame([("e", "c1")], "entity string, id string")
    names = spark.createDataFrame([("e", 0, "Beta disease"), ("f", 0, "Alpha-disease"), ("f", 1, "Beta disease"), ("g", 0, "beta disease")], "entity string, pos int, name string")
    got = {r["entity"]: r for r in designations.fda_match(ids, names, rows).collect()}
    assert (got["e"]["matched_via"], got["e"]["designations"], got["e"]["approved"], len(got["e"]["listed"])) == ("umls", 20, 1, 15)
    assert got["e"]["listed"][0]["generic"] == "g3" and got["e"]["listed"][1]["date"] == "2020-01-20"
    assert (got["f"]["matched_via"], got["f"]["designations"]) == ("name", 21)
    few = {r["entity"]: r["designations"] for r in designations.fda_match(ids, names, rows, name_stop=20).collect()}
    assert few["f"] == 20  # twenty found, second name unread
    assert got["g"]["designations"] == 1
    assert [x["generic"] for x in got["f"]["listed"]] == [x["generic"] for x in got["e"]["listed"]]
    ema = designations.ema_match(names, rows)
    merged = {r["entity"]: r for r in designations.merge_designations(designations.fda_match(ids, names, rows), ema).collect()}
    assert (merged["e"]["source"], merged["e"]["designations"]) == ("fda-oopd+ema", 21)
    assert len(merged["f"]["listed"]) == 20 and merged["f"]["designations"] == 42


def test_backfill_outcomes(spark):
    rows = [(["D1", "D2"], ["a"], ["A"]), (["D1", "D2"], ["a"], []), (["D1", "D2"], ["a"], ["a", "b"]), (["D1"], ["a"], ["z"])]
    df = spark.createDataFrame(rows, "ids array<string>, labels array<string>, fresh array<string>")
    got = identifiers.backfill(df, "ids", "labels", "fresh").collect()
    assert [r["outcome"] for r in got] == ["unchanged", "still-empty", "filled", "complete"]


def test_label_alignment_folds_accents(spark):
    df = spark.createDataFrame([("Sjogren syndrome / SS (x)", ["Primary Sjögren syndrome"]), ("Other", ["Nothing"])], "g string, l array<string>")
    assert [r[0] for r in df.select(reconcile.labels_align("g", "l")).collect()] == [True, False]


def tallied(df):
    """``df`` and an accumulator of the rows that were made of it."""
    rows = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), rows


def test_keys_of_components_are_made_once(spark):
    keys, rows = tallied(spark.createDataFrame([(i, f"k{i // 2}") for i in range(20)], "rid long, key string"))
    assert {r["cluster"] for r in registries.components(keys).collect()} == set(range(0, 20, 2))
    assert rows.value == 20


def test_dedupe_takes_the_first_record_and_moves_no_titles_in_aggregates(spark):
    schema = """rid long, id string, nct_id string, secondary_ids array<string>, title string, status string, registry string,
      url string, conditions array<string>, study_type string"""
    df = spark.createDataFrame([(i, f"R{i}", None, ["S1"], f"t{i}", None, "other", f"u{i}", [], None) for i in (5, 3, 9)], schema)
    got = registries.registry_dedupe(df)
    assert [(r["cluster"], r["records"], r["id"], r["title"], r["url"]) for r in got.collect()] == [(3, 3, "R3", "t3", "u3")]
    plan = got.select("cluster", "records", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "title" not in "".join(line for line in plan.splitlines() if "Aggregate" in line)


def test_keys_of_records_are_computed_once_a_row(spark):
    df = spark.createDataFrame([(1, "A", None, ["b"], "some title")], "rid long, id string, nct_id string, secondary_ids array<string>, title string")
    plan = registries.record_keys(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan


def test_designation_keys_are_made_once_a_part(spark):
    from umbel.plans import join_queries

    plan = join_queries._designation_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("regexp_replace")


def test_designations_of_both_agencies_as_merged_from_their_lists(spark):
    row = "struct<generic:string,text:string,date:string,status:string,number:string>"
    status = ["FDA approved for orphan indication", "Positive", "d", None]
    data = [
        (["C1"] if i % 5 == 0 else [], f"name {i % 3}", (f"g{i % 4}", f"name {i % 3}", None if i % 7 == 0 else f"2020-01-{i % 9 + 1:02d}", status[i % 4], str(i % 6)))
        for i in range(120)
    ]
    rows = spark.createDataFrame(data, f"ids array<string>, key string, row {row}")
    ids = spark.createDataFrame([("e", "c1")], "entity string, id string")
    names = spark.createDataFrame([(e, k, f"Name {k}") for e in "efg" for k in range(3)], "entity string, pos int, name string")
    apart = designations.merge_designations(designations.fda_match(ids, names, rows, cap=20), designations.ema_match(names, rows, cap=20))
    shown = lambda d: {r["entity"]: (r["designations"], r["fda_count"], r["approved"], [(x["date"], x["generic"], x["text"]) for x in r["listed"]]) for r in d.collect()}
    assert shown(designations.all_designations(ids, names, rows)) == shown(apart)
    folder = designations.designation_facts(rows, {"fda-name": ("key", designations.FDA_IDENTITY)})
    assert {f.name for f in folder.schema["rest"].dataType} == {"generic", "text", "date", "status"}  # the number is listed nowhere


def test_matches_of_study_signals_are_found_once(spark):
    m = spark.createDataFrame([("e", i, "INTERVENTIONAL", "RECRUITING", "phrase") for i in range(9)], "entity string, doc long, study_type string, status string, matched_via string")
    matches, rows = tallied(m)
    from umbel.operators import studies

    got = studies.study_signals(matches).first()
    assert (got["total"], len(got["recruiting"])) == (9, 9) and rows.value == 9


def test_rounds_of_a_closure_are_dealt_by_their_rows(spark, monkeypatch):
    from umbel import runtime

    edges = spark.createDataFrame([(str(k), str(k // d), d) for k in range(2, 600) for d in (2, 3) if k // d], EDGE)
    whole = walked(graph.ancestors(edges))
    monkeypatch.setattr(runtime, "TASK_ROWS", 100)
    found = graph.ancestors(edges)
    assert walked(found) == whole
    assert len(found.inputFiles()) > 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_identifiers_are_dealt_by_their_rows(spark, monkeypatch):
    from umbel import runtime

    ids = spark.createDataFrame([(e, p, f"n{(e * 7 + p) % 50}") for e in range(200) for p in range(2)], "entity long, pos int, node string")
    nodes = spark.createDataFrame([(f"n{i}", [f"MESH:D{i}", f"UMLS:C{i}"]) for i in range(50)], "id string, xrefs array<string>")
    whole = sorted(identifiers.collect_identifiers(ids, nodes).collect())
    monkeypatch.setattr(runtime, "TASK_ROWS", 20)
    dealt = identifiers.collect_identifiers(ids, nodes)
    assert sorted(dealt.collect()) == whole
    assert dealt.rdd.getNumPartitions() == 40
