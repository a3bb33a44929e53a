import pytest
from pyspark.sql import functions as F

from umbel.functions import ids as I
from umbel.functions import signals as S
from umbel.functions import text as T
from umbel.operators import terms


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,plain,folded", [
    ("Sjögren-Larsson  Syndrome!", "sj gren larsson syndrome", "sjogren larsson syndrome"),
    ("  A--b ", "a b", "a b"),
    ("ÉCLAIR", "clair", "eclair"),
    ("---", "", ""),
])
def test_normal_forms(spark, raw, plain, folded):
    assert one(spark, T.normalize_term("s"), s=raw) == plain
    assert one(spark, T.fold_label("s"), s=raw) == folded


@pytest.mark.parametrize("term,start", [
    ("abcd", "too-short"), ("A-B-C", "bare-acronym"), ("Disease", "common-word"), ("poly X", "numeric-letter"),
    ("Tetra-A", "numeric-letter"), ("Gaucher disease", None), ("ABC12", None), ("CANCER", "common-word"),
])
def test_stop_reason(spark, term, start):
    got = one(spark, T.stop_reason("t"), t=term)
    assert (got is None) if start is None else got.startswith(start)


def test_unique_terms_keep_first_spelling(spark):
    assert one(spark, T.unique_terms("a"), a=["Foo bar", "foo-BAR", " ", "Baz"]) == ["Foo bar", "Baz"]


def test_label_stays_even_when_weak(spark):
    got = one(spark, T.kept_terms("n", "s"), n="ABC", s=["Long synonym", "abc", "xx"])
    assert got["kept"] == ["ABC", "Long synonym"]
    assert [d["term"] for d in got["dropped"]] == ["ABC", "xx"]


def test_phrase_terms_cap_lists_the_rest(spark):
    names = [f"name number {i}" for i in range(50)]
    got = one(spark, T.phrase_terms("n", "s"), n=["first name"], s=names)
    assert got["terms"][0] == "first name" and len(got["terms"]) == 40
    assert len(got["dropped"]) == 11
    assert all(d["reason"].startswith("over-cap") for d in got["dropped"])


def test_article_variants(spark):
    assert one(spark, T.article_variants("t"), t="cancer of the lung") == ["cancer of the lung", "cancer of lung"]
    assert one(spark, T.article_variants("t"), t="cancer of lung") == ["cancer of lung", "cancer of the lung"]
    assert one(spark, T.article_variants("t"), t="plain") == ["plain"]


@pytest.mark.parametrize("label,generic", [
    ("heart disease", True), ("Marfan syndrome", False), ("disease", True), ("Gaucher disease type 3", False),
    ("autosomal dominant disease", True), ("multiple congenital anomalies of x", True),
    ("syndromic intellectual disability", True), ("muscular dystrophy", True), ("type", True),
])
def test_generic_label(spark, label, generic):
    assert one(spark, T.is_generic_label("x"), x=label) is generic


@pytest.mark.parametrize("term,genes,safe", [
    ("KRAS", ["KRAS"], False), ("ZMYND11", ["zmynd11"], True), ("heart disease", [], False),
    ("Fabry disease", [], True), ("short name here", [], False), ("cerebrotendinous xanthomatosis", [], True),
    ("hypertension", [], False), ("arachnodactyly", [], False), ("abetalipoproteinemia", [], True), ("smallword", [], False),
])
def test_safe_recall(spark, term, genes, safe):
    df = spark.createDataFrame([(term, genes)], "t string, g array<string>")
    assert df.select(T.is_safe_recall("t", "g").alias("x")).first()["x"] is safe


def test_name_parent_needs_token_boundaries(spark):
    df = spark.createDataFrame([("cephalopolysyndactyly", "syndactyly"), ("Gaucher disease type 3", "gaucher disease")], ["n", "c"])
    assert [r["x"] for r in df.select(T.is_name_parent("n", "c").alias("x")).collect()] == [False, True]


def test_genes(spark):
    assert one(spark, T.cap_genes("g"), g=["KRAS", "a", "GLA", "gla", "GBA1", "HEXA", "FBN1"]) == ["GLA", "GBA1", "HEXA"]
    assert one(spark, T.infer_genes("n"), n="ZMYND11-related syndromic disability") == ["ZMYND11"]
    assert one(spark, T.infer_genes("n"), n="OMIM 1234") == []
    df = spark.createDataFrame([("x", ["GLA"])], "n string, g array<string>")
    assert df.select(T.publication_terms("n", "g").alias("x")).first()["x"] == ["GLA syndrome", "GLA-related"]


def test_pack_chunks(spark):
    got = one(spark, T.pack_chunks("a", 19), a=["aaaaaa", "bbbbbb", 'c"c', " ", "d" * 30])
    assert got == [["aaaaaa"], ["bbbbbb", "cc"], ["d" * 30]]


def test_queries(spark):
    assert one(spark, T.or_query("a"), a=["x y", 'q"q']) == '"x y" OR "qq"'
    assert one(spark, T.label_query("a"), a=["Ab", "ab", "C"]) == 'MESH:"Ab" OR MESH:"C"'
    assert one(spark, T.split_query("q"), q='"Alpha Beta" OR "xy" or "Gamma"') == ["alpha beta", "gamma"]


def test_ids(spark):
    text = "NCT01234567, isrctn12345678; 2020-123456-12-00, CTRI/2020/01/123456 jRCTs031180001 ChiCTR-IPR-15007 ACTRN12345678901234"
    got = one(spark, I.secondary_ids("t"), t=text)
    assert got == [
        "NCT01234567", "ISRCTN12345678", "2020-123456-12-00", "2020-123456-12", "CTRI/2020/01/123456",
        "JRCTS031180001", "CHICTR-IPR-15007", "ACTRN12345678901234",
    ]
    beside = "编号ChiCTR-IPR-15007登记NCT01234567号, éDRKS12345678, xNCT11111111"
    assert one(spark, I.secondary_ids("t"), t=beside) == ["NCT01234567", "DRKS12345678", "CHICTR-IPR-15007"]
    assert one(spark, I.first_nct("t"), t="no id") is None
    assert one(spark, I.normalize_curie("t"), t="http://x/MONDO_12") == "MONDO:0000012"
    assert [one(spark, I.infer_registry("t"), t=i) for i in ("nct1", "DRKS1", "2020-123456-12", "zz")] == ["ctgov", "drks", "euctr", "other"]


@pytest.mark.parametrize("raw,want", [
    (None, []), ("null", []), ('{"a":"1"}', ["1"]), ('[{"a":"1"},{"a":"2"}]', ["1", "2"]), ("", []),
])
def test_as_array(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "r string")
    got = df.select(S.as_array("r", "struct<a:string>").alias("x")).first()["x"]
    assert [g["a"] for g in got] == want


def test_levels_and_percent(spark):
    df = spark.createDataFrame([(None,), (0,), (1,), (4,), (5,), (49,), (50,), (499,), (500,)], "c long")
    assert [r[0] for r in df.select(S.signal_level("c", "papers")).collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
    assert one(spark, S.percent_1("a", "b"), a=1, b=16) == 6.3
    assert one(spark, S.percent_1("a", "b"), a=1, b=0) == 0.0


def test_search(spark):
    df = spark.createDataFrame([("12", "Alpha", ["x"]), ("3", "Beta", ["alphabet"])], "code string, name string, synonyms array<string>")
    assert [r["code"] for r in terms.search_entities(df, "ALPHA").collect()] == ["3", "12"]
    assert terms.search_entities(df, "a").count() == 0
    assert [r["code"] for r in terms.search_entities(df, "orpha:12").collect()] == ["12"]


def test_costly_arrays_are_computed_once_a_row(spark):
    from umbel.plans import text_queries  # noqa: F401
    from umbel.plans.registry import QUERIES

    for name in ("recall_terms", "token_frequency"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter (size(" not in plan and "Filter ((size(" not in plan, name


def test_terms_and_frequencies_are_made_once(spark):
    from tests.test_structures import tallied
    from umbel.operators import terms, vocabulary

    e, rows = tallied(spark.createDataFrame([("a", ["Name of one"], ["Synonym of two", "x"])], "code string, names array<string>, synonyms array<string>"))
    kept, dropped = terms.phrase_term_rows(e, "code", "names", "synonyms")
    assert kept.count() == 4 and dropped.count() == 1 and rows.value == 1
    words = [("abcdefgh", 100, 8), ("abcdefgi", 1, 8)]
    freq, rows = tallied(spark.createDataFrame(words, "token string, freq long, len int"))
    assert [r["neighbour"] for r in vocabulary.misspelling_candidates(freq, freq).collect()] == ["abcdefgh"]
    assert rows.value == 2
