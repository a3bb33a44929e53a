"""Terms matched to documents, and the counts that follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import match, papers, studies as st
from ..runtime import materialize
from . import sqltext as S
from .registry import query
from .tables import SENTENCES_SQL, STRATEGIES_SQL, STUDIES_SQL, load, sentences, strategies, studies

_WITH = f"WITH {STRATEGIES_SQL}, {STUDIES_SQL}"


def _matches(spark, sf):
    terms = match.normal_terms(strategies(spark, sf), "item_id", strategy=F.col("strategy"))
    return match.phrase_match(match.study_texts(studies(spark, sf)), terms)


def _classified(spark, sf):
    """Every match with the type and status of its study."""
    docs = studies(spark, sf).select(F.col("nct_id").alias("doc"), "study_type", "status")
    return match.classify_matches(_matches(spark, sf)).join(docs, "doc")


@query("phrase_match", f"{_WITH} SELECT entity, strategy, doc, via_condition, via_title FROM hits")
def _(spark, sf):
    return _matches(spark, sf)


@query("phrase_match_texts", f"""
WITH {SENTENCES_SQL}, d AS MATERIALIZED (SELECT doc_id AS doc, {S.norm('text')} AS n FROM documents)
SELECT item_id AS entity, doc FROM phr JOIN d ON {S.contains('n', 'term')} GROUP BY ALL""")
def _(spark, sf):
    terms = match.normal_terms(sentences(spark, sf), "item_id")
    texts = match.plain_texts(load(spark, sf, "documents"), "doc_id", "text")
    return match.phrase_match(texts, terms).select("entity", "doc")


@query("classify_matches", f"{_WITH} SELECT entity, doc, phrase, mesh, recall, matched_via FROM classified")
def _(spark, sf):
    return match.classify_matches(_matches(spark, sf))


def _umbrella(spark, sf):
    return studies(spark, sf).where("source in ('src5', 'src6')").select(F.col("nct_id").cast("string").alias("id"))


@query("split_by_list", f"""{_WITH}
SELECT entity, doc, CASE WHEN source IN ('src5', 'src6') THEN 'umbrella' ELSE 'counted' END AS list
FROM classified JOIN studies USING (doc)""")
def _(spark, sf):
    # Both lists read the matches, so they are found once.
    m = materialize(match.classify_matches(_matches(spark, sf)), "matches").withColumn("id", F.col("doc").cast("string"))
    counted, umbrella = match.split_by_list(m, _umbrella(spark, sf), "id")
    rows = counted.withColumn("list", F.lit("counted")).unionByName(umbrella.withColumn("list", F.lit("umbrella")))
    return rows.select("entity", "doc", "list")


@query("study_signals", f"""{_WITH}
SELECT entity, count(*) FILTER (WHERE study_type = 'INTERVENTIONAL') AS total,
  count(*) FILTER (WHERE study_type = 'INTERVENTIONAL' AND status = 'RECRUITING') AS recruiting_count,
  count(*) FILTER (WHERE study_type = 'OBSERVATIONAL') AS observational_total,
  count(*) FILTER (WHERE study_type = 'OBSERVATIONAL' AND status = 'RECRUITING') AS observational_recruiting,
  count(*) FILTER (WHERE study_type = 'EXPANDED_ACCESS') AS expanded_access_total,
  count(*) AS registered_total,
  coalesce(string_agg(DISTINCT CASE WHEN study_type = 'INTERVENTIONAL' THEN matched_via END, ',' ORDER BY CASE WHEN study_type = 'INTERVENTIONAL' THEN matched_via END), '') AS via,
  concat_ws(',', CASE WHEN bool_or(matched_via IN ('phrase', 'both')) THEN 'phrase' END,
    CASE WHEN bool_or(matched_via IN ('mesh', 'both')) THEN 'mesh' END,
    CASE WHEN bool_or(matched_via = 'recall-expansion') THEN 'recall-expansion' END) AS strategies,
  coalesce(array_to_string(list_sort(list(doc) FILTER (WHERE study_type = 'INTERVENTIONAL' AND status = 'RECRUITING'))[1:15], ','), '') AS first_recruiting
FROM classified JOIN studies USING (doc) GROUP BY entity""")
def _(spark, sf):
    s = st.study_signals(_classified(spark, sf))
    return s.select(
        "entity", "total", "recruiting_count", "observational_total", "observational_recruiting",
        "expanded_access_total", "registered_total", F.array_join("matched_via", ",").alias("via"),
        F.array_join("strategies_with_hits", ",").alias("strategies"),
        F.coalesce(F.array_join(F.transform("recruiting", lambda r: r["doc"].cast("string")), ","), F.lit("")).alias("first_recruiting"),
    )


# Terms of parts are name plus type; items are line items described by their part.
_OWNED_SQL = f"""
own AS (SELECT p_partkey AS code, {S.norm("p_name || ' ' || p_type")} AS term FROM part
  UNION SELECT p_partkey, {S.norm("p_name || ' ' || p_brand")} FROM part),
owned AS (SELECT *, count(*) OVER (PARTITION BY term) AS owners FROM own),
li AS (SELECT l_orderkey * 8 + l_linenumber AS doc, p_name || ' ' || p_type AS c, p_name || ' ' || p_brand AS k,
    CASE WHEN l_returnflag = 'R' THEN 'INTERVENTIONAL' ELSE 'OBSERVATIONAL' END AS study_type, l_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey),
docs AS (SELECT doc, max(study_type) AS study_type, list(c ORDER BY l_partkey, c) AS cs, list(k ORDER BY l_partkey, k) AS ks FROM li GROUP BY doc),
f AS (SELECT doc, study_type, 0 AS r, 'condition' AS via, {S.norm('unnest(cs)')} AS term FROM docs
  UNION ALL SELECT doc, study_type, 1, 'keyword', {S.norm('unnest(ks)')} FROM docs),
m AS (SELECT code, doc, any_value(study_type) AS study_type, arg_min(via, r) AS via FROM f JOIN owned USING (term) WHERE owners <= 8 GROUP BY code, doc)
"""


def _part_terms(spark, sf):
    p = load(spark, sf, "part")
    names = p.select(
        F.col("p_partkey").alias("code"),
        F.array(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_name", "p_brand")).alias("terms"), "p_size",
    )
    return names, match.owned_terms(names, "code", "terms")


def _item_docs(spark, sf):
    """Line items described by their part; one document per order line number."""
    p = load(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    rows = li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("doc"),
        F.concat_ws(" ", "p_name", "p_type").alias("c"), F.concat_ws(" ", "p_name", "p_brand").alias("k"),
        F.when(F.col("l_returnflag") == "R", "INTERVENTIONAL").otherwise("OBSERVATIONAL").alias("study_type"), "l_partkey",
    )
    # Few lines share an order and line number, so these lists stay short.
    ordered = lambda c: F.array_sort(F.collect_list(F.struct("l_partkey", c)))[c]
    return rows.groupBy("doc").agg(
        F.max("study_type").alias("study_type"), ordered("c").alias("conditions"), ordered("k").alias("keywords")
    )


def _exact(spark, sf):
    _, owned = _part_terms(spark, sf)
    return match.exact_term_match(owned, _item_docs(spark, sf), "code", "doc", "conditions", "keywords", carry=("study_type",))


@query("exact_term_match", f"WITH {_OWNED_SQL} SELECT code, doc, study_type, via FROM m")
def _(spark, sf):
    return _exact(spark, sf).select("code", "doc", "study_type", "via")


@query("ambiguous_terms", f"WITH {_OWNED_SQL} SELECT DISTINCT term, owners FROM owned WHERE owners > 8")
def _(spark, sf):
    return match.ambiguous_terms(_part_terms(spark, sf)[1])


_SUMMARY_SQL = f"""WITH {_OWNED_SQL},
c AS (SELECT code, count(*) AS matches, count(*) FILTER (WHERE study_type = 'INTERVENTIONAL') AS interventional,
  array_to_string((list(doc ORDER BY study_type <> 'INTERVENTIONAL', doc))[1:50], ',') AS first_docs FROM m GROUP BY code),
e AS (SELECT p_partkey AS code, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 3 END AS existing,
  coalesce(matches, 0) AS matches, coalesce(interventional, 0) AS interventional, coalesce(first_docs, '') AS first_docs
  FROM part LEFT JOIN c ON code = p_partkey)"""


def _summary(spark, sf):
    names, _ = _part_terms(spark, sf)
    names = names.withColumn("existing", F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 3))
    hits = materialize(_exact(spark, sf), "hits")
    return st.offline_match_summary(names, hits, "code", "existing", "doc"), hits


@query("offline_match_summary", f"""{_SUMMARY_SQL}
SELECT code, existing, matches, interventional, interventional - existing AS delta, first_docs, matches > 50 AS truncated FROM e""")
def _(spark, sf):
    per, _ = _summary(spark, sf)
    docs = F.coalesce(F.array_join(F.transform("first_matches", lambda r: r["doc"].cast("string")), ","), F.lit(""))
    return per.select("code", "existing", "matches", "interventional", "delta", docs.alias("first_docs"), "truncated")


@query("offline_match_totals", f"""{_SUMMARY_SQL}
SELECT count(*) FILTER (WHERE matches > 0) AS entities_with_hit, count(*) FILTER (WHERE interventional > 0) AS entities_with_interventional,
  count(*) FILTER (WHERE coalesce(existing, 0) = 0 AND interventional > 0) AS stored_zero_matched_some,
  count(*) FILTER (WHERE coalesce(existing, 0) > 0 AND interventional = 0) AS stored_some_matched_zero,
  (SELECT count(DISTINCT doc) FROM m) AS docs_matched,
  (SELECT count(DISTINCT doc) FROM m WHERE study_type = 'INTERVENTIONAL') AS interventional_docs FROM e""")
def _(spark, sf):
    return st.offline_match_totals(*_summary(spark, sf), "doc")


@query("offline_disagreements", f"""{_SUMMARY_SQL}
SELECT 'stored-zero' AS list, code, coalesce(existing, 0) AS stored, interventional FROM e WHERE coalesce(existing, 0) = 0 AND interventional > 0
UNION ALL SELECT 'matched-zero', code, existing, interventional FROM e WHERE existing > 0 AND interventional = 0""")
def _(spark, sf):
    zero, some = st.disagreements(_summary(spark, sf)[0])
    both = zero.withColumn("list", F.lit("stored-zero")).unionByName(some.withColumn("list", F.lit("matched-zero")))
    return both.select("list", "code", F.coalesce("existing", F.lit(0)).alias("stored"), "interventional")


@query("parent_tier", f"""{_WITH}
SELECT entity, count(*) AS wider, count(*) FILTER (WHERE status = 'RECRUITING') AS wider_recruiting FROM (
  SELECT entity, doc FROM hits WHERE strategy = 'recall' EXCEPT SELECT entity, doc FROM hits WHERE strategy = 'phrase')
JOIN studies USING (doc) GROUP BY entity""")
def _(spark, sf):
    # Each filter would make a plan of its own, and every plan a search over all text.
    m = materialize(_matches(spark, sf).where("strategy in ('recall', 'phrase')").select("entity", "strategy", "doc"), "matches")
    wide = match.parent_tier(m.where("strategy = 'recall'"), m.where("strategy = 'phrase'"))
    docs = studies(spark, sf).select(F.col("nct_id").alias("doc"), "status")
    return wide.join(docs, "doc").groupBy("entity").agg(
        F.count("*").alias("wider"), F.count_if(F.col("status") == "RECRUITING").alias("wider_recruiting")
    )


@query("count_live", f"""
WITH {SENTENCES_SQL}, d AS MATERIALIZED (SELECT doc_id, {S.norm('text')} AS t FROM documents),
n AS (SELECT item_id, count(DISTINCT doc_id) AS live FROM phr JOIN d ON {S.contains('t', 'term')} GROUP BY item_id)
SELECT item_id AS entity, coalesce(live, 0) AS live FROM benchmark LEFT JOIN n USING (item_id)""")
def _(spark, sf):
    b = load(spark, sf, "benchmark").select("item_id", T.or_query(F.split("text", r"[.\n]")).alias("query"))
    return match.count_live(b, match.plain_texts(load(spark, sf, "documents"), "doc_id", "text"), "item_id", "query")


@query("fallback_scan", f"""{_WITH},
t AS (SELECT item_id AS entity, strategy, count(DISTINCT doc) AS n FROM benchmark LEFT JOIN hits ON entity = item_id GROUP BY ALL),
p AS (SELECT item_id AS entity, coalesce(max(n) FILTER (WHERE strategy = 'recall'), 0) AS r, coalesce(max(n) FILTER (WHERE strategy = 'mesh'), 0) AS m,
  coalesce(max(n) FILTER (WHERE strategy = 'phrase'), 0) AS f FROM benchmark LEFT JOIN t ON entity = item_id GROUP BY item_id)
SELECT entity, CASE WHEN r <= 60 THEN r WHEN f <= 20 THEN f WHEN m <= 5 THEN m END AS total,
  CASE WHEN r <= 60 THEN 0 WHEN f <= 20 THEN 1 WHEN m <= 5 THEN 2 END AS tier FROM p""")
def _(spark, sf):
    items = load(spark, sf, "benchmark").select(F.col("item_id").alias("entity"))
    # The three tiers are counted from one search over all text.
    m = materialize(_matches(spark, sf).groupBy("entity", "strategy").agg(F.count("*").alias("n")), "tiers")
    tiers = []
    for strategy, ceiling in (("recall", 60), ("phrase", 20), ("mesh", 5)):
        n = m.where(F.col("strategy") == strategy).select("entity", "n")
        tiers.append(
            items.join(n, "entity", "left").select(
                "entity", F.coalesce("n", F.lit(0)).alias("total"), (F.coalesce("n", F.lit(0)) <= ceiling).alias("complete")
            )
        )
    return st.fallback_scan(tiers).select("entity", "total", "tier")


@query("publication_signals", f"""{_WITH},
d AS (SELECT entity, doc, bool_or(strategy = 'phrase') AS p, bool_or(strategy = 'mesh') AS m FROM hits GROUP BY ALL)
SELECT entity, count(*) AS total, count(*) FILTER (WHERE p) AS phrase_count, count(*) FILTER (WHERE m) AS mesh_count,
  concat_ws(',', CASE WHEN bool_or(p) THEN 'phrase' END, CASE WHEN bool_or(m) THEN 'mesh' END) AS strategies FROM d GROUP BY entity""")
def _(spark, sf):
    p = papers.publication_signals(_matches(spark, sf))
    return p.withColumn("strategies", F.array_join("strategies_with_hits", ",")).drop("strategies_with_hits")


@query("yearly_series", """
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY ALL),
g AS (SELECT c_custkey, CAST(unnest(range(1988, 2003)) AS INT) AS year FROM customer)
SELECT c_custkey, g.year, coalesce(n, 0) AS n FROM g LEFT JOIN y ON o_custkey = c_custkey AND y.year = g.year""")
def _(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
    return papers.yearly_series(rows, load(spark, sf, "customer"), "c_custkey", "year", 2002)[0]


@query("recent_papers", """
SELECT c_custkey, count(o_orderkey) AS recent FROM customer
LEFT JOIN orders ON o_custkey = c_custkey AND year(o_orderdate) BETWEEN 1989 AND 1998 GROUP BY c_custkey""")
def _(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
    return papers.yearly_series(rows, load(spark, sf, "customer"), "c_custkey", "year", 1998, 5)[1]


# Suppliers are the authors of the line items of a part; letters of the key make a name.
_AUTHOR_SQL = """
a AS (SELECT l_partkey AS code, l_orderkey AS paper, l_linenumber AS line, year(l_shipdate) AS yr,
    translate(s_name, '#0123456789', 'xabcdefghij') AS last, CASE WHEN s_suppkey % 5 = 0 THEN 'A.B.c.d' ELSE 'Q' END AS ini,
    CASE WHEN l_tax > 0.04 THEN l_shipmode_ END AS aff
  FROM (SELECT *, 'dept ' || l_quantity::INT AS l_shipmode_ FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey),
k AS (SELECT *, lower(last) || '|' || CASE WHEN ini = 'Q' THEN 'q' ELSE 'abc' END AS author FROM a),
people AS (SELECT code, author, count(*) AS papers, max(yr) AS latest_year,
    arg_max(aff, (yr, paper, line, aff)) FILTER (WHERE aff IS NOT NULL) AS affiliation FROM k GROUP BY code, author)
"""


def _authors(spark, sf):
    li = load(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_tax", "l_quantity")
    s = load(spark, sf, "supplier").select(
        "s_suppkey", F.translate("s_name", "#0123456789", "xabcdefghij").alias("last"),
        F.when(F.col("s_suppkey") % 5 == 0, "A.B.c.d").otherwise("Q").alias("initials"),
    )
    rows = li.join(s, li["l_suppkey"] == s["s_suppkey"])
    return rows.select(
        F.col("l_partkey").alias("code"), F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("line"),
        F.year("l_shipdate").alias("year"), papers.author_key("last", "initials").alias("author"),
        F.col("last").alias("display"),
        F.when(F.col("l_tax") > 0.04, F.concat(F.lit("dept "), F.col("l_quantity").cast("int").cast("string"))).alias("affiliation"),
    )


@query("researchers", f"WITH {_AUTHOR_SQL} SELECT code, count(*) AS people FROM people GROUP BY code")
def _(spark, sf):
    return papers.researchers(_authors(spark, sf), "code", ["year", "paper", "line", "affiliation"])[0]


@query("top_researchers", f"""WITH {_AUTHOR_SQL}
SELECT code, author, papers, latest_year, affiliation, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY papers DESC, author) AS rank FROM people) WHERE rank <= 10""")
def _(spark, sf):
    top = papers.researchers(_authors(spark, sf), "code", ["year", "paper", "line", "affiliation"])[1]
    return top.select("code", "author", "papers", "latest_year", "affiliation", "rank")


@query("sample_papers", """
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 5""")
def _(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return papers.sample_papers(o, "o_custkey", ["o_orderdate", "o_orderkey"], 5).select("o_custkey", "o_orderkey")
