"""Votes, consensus and accuracy over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accuracy as acc
from . import sqltext as S
from .registry import query
from .tables import load

# Two voters judge a document: quality, and the absence of toxicity. Documents
# without a label got no vote. A few votes are malformed, too long or hedged.

_A = "CASE WHEN doc_id % 11 = 0 THEN 'uncertain' WHEN doc_id % 13 = 0 THEN 'relevant-to-parent-category' WHEN quality = 1 THEN 'true' ELSE 'false' END"
_B = "CASE WHEN doc_id % 13 = 0 THEN 'relevant-to-parent-category' WHEN toxic = 0 THEN 'true' ELSE 'false' END"
VOTES_SQL = f"""
v AS (SELECT doc_id, {_A} AS a0, {_B} AS b0, doc_id % 17 <> 0 AS a_ok, doc_id % 19 <> 0 AS b_ok FROM labels),
bal AS MATERIALIZED (SELECT d.doc_id, d.lang, d.source, coalesce(CASE WHEN a_ok THEN a0 END, 'uncertain') AS first, coalesce(CASE WHEN b_ok THEN b0 END, 'uncertain') AS second
  FROM documents d LEFT JOIN v USING (doc_id)),
con AS MATERIALIZED (SELECT *, CASE WHEN first = 'true' AND second = 'true' THEN 'relevant' WHEN first = 'false' AND second = 'false' THEN 'irrelevant'
  WHEN first = second AND first = 'relevant-to-parent-category' THEN 'parent-category' ELSE 'uncertain' END AS consensus FROM bal)
"""


def _raw_votes(spark, sf):
    """Vote texts as a model would return them: JSON, sometimes fenced or broken."""
    lab = load(spark, sf, "labels")
    k = F.col("doc_id")
    parent = F.lit('"relevant-to-parent-category"')
    a = F.when(k % 11 == 0, F.lit('"uncertain"')).when(k % 13 == 0, parent).when(F.col("quality") == 1, "true").otherwise("false")
    b = F.when(k % 13 == 0, parent).when(F.col("toxic") == 0, "true").otherwise("false")

    def body(verdict, reason):
        return F.concat(F.lit('{"relevant": '), verdict, F.lit(', "reason": "'), reason, F.lit('"}'))

    a_text = F.when(k % 17 == 0, "no json here").when(k % 2 == 0, F.concat(F.lit("```json\n"), body(a, F.lit("fits")), F.lit("\n```"))).otherwise(body(a, F.lit("fits")))
    b_text = F.when(k % 19 == 0, body(b, F.repeat(F.lit("x"), 501))).otherwise(body(b, F.lit("fits")))
    votes = F.array(
        F.struct(F.lit("a").alias("voter"), a_text.alias("raw")), F.struct(F.lit("b").alias("voter"), b_text.alias("raw"))
    )
    return lab.select("doc_id", F.explode(votes).alias("v")).select("doc_id", "v.voter", "v.raw")


def _ballots(spark, sf):
    votes = acc.vote_validity(_raw_votes(spark, sf))
    cast = acc.ballots(votes, ["doc_id"], ("a", "b"))
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source")
    return docs.join(cast, "doc_id", "left").select(
        "doc_id", "lang", "source", F.coalesce("first", F.lit("uncertain")).alias("first"),
        F.coalesce("second", F.lit("uncertain")).alias("second"),
    )


def _labelled(spark, sf):
    return _ballots(spark, sf).select(
        F.concat_ws("-", "source", "lang").alias("entity"), F.col("doc_id").alias("doc"), F.col("lang").alias("difficulty"), acc.consensus().alias("consensus")
    )


@query("vote_validity", f"""WITH {VOTES_SQL}
SELECT doc_id, 'a' AS voter, a_ok AS valid, CASE WHEN a_ok THEN a0 END AS verdict FROM v UNION ALL SELECT doc_id, 'b', b_ok, CASE WHEN b_ok THEN b0 END FROM v""")
def _(spark, sf):
    d = acc.vote_validity(_raw_votes(spark, sf))
    return d.select("doc_id", "voter", "valid", F.when(F.col("valid"), F.col("verdict")).alias("verdict"))


@query("consensus", f"""WITH {VOTES_SQL} SELECT doc_id, consensus, CASE WHEN first = second AND first <> 'uncertain' THEN 'agreed'
  WHEN first IN ('uncertain', 'relevant-to-parent-category') OR second IN ('uncertain', 'relevant-to-parent-category') THEN 'unsure' ELSE 'disagreed' END AS reason FROM con""")
def _(spark, sf):
    return _ballots(spark, sf).select("doc_id", acc.consensus().alias("consensus"), acc.consensus_reason().alias("reason"))


@query("consensus_with_hint", f"""WITH {VOTES_SQL} SELECT doc_id, CASE WHEN consensus = 'uncertain' AND doc_id % 2 = 0 AND first <> 'false' AND second <> 'false'
  AND (first IN ('uncertain', 'relevant-to-parent-category') OR second IN ('uncertain', 'relevant-to-parent-category')) THEN 'parent-category' ELSE consensus END AS consensus FROM con""")
def _(spark, sf):
    d = _ballots(spark, sf).withColumn("hint", F.col("doc_id") % 2 == 0)
    return d.select("doc_id", acc.consensus_with_hint("hint").alias("consensus"))


@query("parent_hint", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {S.contains(S.norm('p_brand'), S.norm("p_name"))} OR {S.contains(S.norm("p_name || ' ' || p_type"), S.norm("p_name"))} AS hint
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 2 = 0
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, false FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 2 = 1""")
def _(spark, sf):
    p = load(spark, sf, "part").withColumn("entity", F.col("p_partkey"))
    # Odd sizes offer conditions that never hold the parent label.
    conditions = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", F.concat_ws(" ", "p_name", "p_type"))).otherwise(F.array("p_brand"))
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("entity"))
    cands = li.join(p.select("entity", conditions.alias("conditions")), "entity")
    names = p.select("entity", F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.col("p_name").alias("parent_label"))
    d = acc.parent_hint(cands, names)
    return d.select("l_orderkey", "l_linenumber", F.col("entity").alias("l_partkey"), "hint")


# Found documents are those over 1,500 characters.
_ACC_SQL = f"""{VOTES_SQL},
f AS (SELECT c.*, n_chars > 1500 AS found FROM con c JOIN documents USING (doc_id)),
e AS MATERIALIZED (SELECT source || '-' || f.lang AS source, f.lang AS lang, count(*) AS candidates, count(*) FILTER (WHERE consensus = 'relevant') AS rel, count(*) FILTER (WHERE consensus = 'irrelevant') AS irr,
  count(*) FILTER (WHERE consensus IN ('uncertain', 'parent-category')) AS unc,
  count(*) FILTER (WHERE consensus = 'relevant' AND found) AS frel, count(*) FILTER (WHERE consensus = 'irrelevant' AND found) AS firr FROM f GROUP BY f.source, f.lang),
s AS MATERIALIZED (SELECT *, CASE WHEN rel > 0 THEN frel / rel END AS recall, CASE WHEN frel + firr > 0 THEN frel / (frel + firr) END AS prec, (rel + irr) / candidates AS cov FROM e)
"""


def _per_entity(spark, sf):
    found = load(spark, sf, "documents").where("n_chars > 1500").select(F.concat_ws("-", "source", "lang").alias("entity"), F.col("doc_id").alias("doc"))
    return acc.entity_accuracy(_labelled(spark, sf), found)


@query("entity_accuracy", f"WITH {_ACC_SQL} SELECT source AS entity, lang AS difficulty, candidates, round(recall, 6) AS recall, round(prec, 6) AS precision, round(cov, 6) AS coverage FROM s")
def _(spark, sf):
    d = _per_entity(spark, sf)
    return d.select("entity", "difficulty", "candidates", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "coverage")])


@query("accuracy", f"""WITH {_ACC_SQL} SELECT lang AS difficulty, count(*) AS entities, round(coalesce(avg(recall), 1), 6) AS recall, round(coalesce(avg(prec), 1), 6) AS precision, round(avg(cov), 6) AS coverage FROM s GROUP BY lang
UNION ALL SELECT 'all', count(*), round(coalesce(avg(recall), 1), 6), round(coalesce(avg(prec), 1), 6), round(sum(rel + irr) / sum(rel + irr + unc), 6) FROM s""")
def _(spark, sf):
    d = acc.accuracy(_per_entity(spark, sf))
    return d.select("difficulty", "entities", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "coverage")])


@query("regressions", """
WITH b AS (SELECT source AS entity, count(*) AS found FROM documents WHERE lang <> 'de' GROUP BY 1), c AS (SELECT source AS entity, count(*) AS found FROM documents WHERE lang <> 'fr' GROUP BY 1)
SELECT entity, c.found, b.found AS baseline FROM c JOIN b USING (entity) WHERE c.found < b.found""")
def _(spark, sf):
    d = load(spark, sf, "documents")
    n = lambda lang: d.where(F.col("lang") != lang).groupBy(F.col("source").alias("entity")).agg(F.count("*").alias("found"))
    return acc.regressions(n("fr"), n("de"))


@query("baseline_check", f"WITH {_ACC_SQL}, r AS (SELECT avg(recall) AS now, max(recall) AS best FROM s) SELECT true AS comparable, now < best - 0.02 AS regressed, now >= best AND now >= best - 0.02 AS advance FROM r")
def _(spark, sf):
    per = _per_entity(spark, sf)
    row = lambda e: per.agg(e.alias("recall"), F.lit("v1").alias("version"))
    return acc.baseline_check(row(F.avg("recall")), row(F.max("recall")))


def _packet_rows(spark, sf):
    b = _ballots(spark, sf)
    k = F.col("doc_id")
    cands = b.select(
        F.col("source").alias("entity"), F.concat(F.lit("nct"), F.lpad(k.cast("string"), 8, "0")).alias("doc"),
        F.when(F.col("lang") == "en", "INTERVENTIONAL").otherwise("OBSERVATIONAL").alias("study_type"),
        F.array("lang", F.concat(F.lit("condition "), "source")).alias("conditions"),
        F.when(k % 23 != 0, F.col("first")).alias("verdict"), F.when(k % 29 != 0, "fits").otherwise("").alias("reason"),
        (k % 3 == 0).alias("disagreement_reviewed"), F.when(k % 4 == 0, "broad").otherwise("pipeline").alias("discovered_via"),
    )
    packets = b.groupBy(F.col("source").alias("entity")).agg(F.min("doc_id").alias("m")).select(
        "entity", F.when(F.col("m") % 2 == 0, "timeout").otherwise("").alias("fetch_error"), (F.col("m") % 3 != 0).alias("fully_scanned"),
        F.array(F.concat(F.lit("Condition "), "entity")).alias("labels"), (F.col("m") % 5 != 0).alias("range_reviewed"),
        F.when(F.col("m") % 7 != 0, "someone").alias("reviewed_by"), F.lit("2024-01-01").alias("reviewed_on"),
    )
    return packets, cands


@query("review_gate", f"""WITH {VOTES_SQL}, m AS (SELECT source AS entity, min(doc_id) AS m FROM con GROUP BY 1),
c AS (SELECT *, CASE WHEN doc_id % 23 <> 0 THEN first END AS verdict FROM con)
SELECT entity, 'fetch-failed' AS problem FROM m WHERE m % 2 = 0 UNION ALL SELECT entity, 'not-fully-scanned' FROM m WHERE m % 3 = 0
UNION ALL SELECT entity, 'range-not-reviewed' FROM m WHERE m % 5 = 0 UNION ALL SELECT entity, 'reviewer-missing' FROM m WHERE m % 7 = 0
UNION ALL SELECT DISTINCT source, 'unreviewed-disagreement' FROM c WHERE lang = 'en' AND verdict IN ('false', 'uncertain') AND doc_id % 3 <> 0
UNION ALL SELECT DISTINCT source, 'verdict-missing' FROM c WHERE verdict IS NULL OR doc_id % 29 = 0
UNION ALL SELECT NULL, CASE WHEN n < 10 THEN 'too-few-checks' ELSE 'checks-missed' END FROM (SELECT count(*) AS n, count(*) FILTER (WHERE verdict = 'false') AS k FROM c WHERE lang <> 'en') WHERE n < 10 OR k < 8""")
def _(spark, sf):
    return acc.review_gate(*_packet_rows(spark, sf))


@query("label_sets", f"""WITH {VOTES_SQL}, c AS (SELECT source AS entity, 'NCT' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS doc, CASE WHEN doc_id % 23 <> 0 THEN first END AS v, doc_id % 4 = 0 AS broad FROM con WHERE lang = 'en'),
l AS (SELECT entity, doc, CASE WHEN v = 'true' THEN 'relevant' WHEN v = 'false' AND NOT broad THEN 'irrelevant' WHEN v = 'uncertain' THEN 'uncertain' WHEN v = 'relevant-to-parent-category' THEN 'parent' END AS label FROM c)
SELECT entity, label, doc FROM l WHERE label IS NOT NULL""")
def _(spark, sf):
    return acc.label_sets(_packet_rows(spark, sf)[1])


def _long_votes(spark, sf):
    v = acc.vote_validity(_raw_votes(spark, sf)).where("valid")
    docs = load(spark, sf, "documents").select("doc_id", F.col("source").alias("entity"))
    return v.join(docs, "doc_id").select("entity", F.col("doc_id").alias("doc"), "voter", "verdict")


@query("control_score", f"""WITH {VOTES_SQL}, k AS (SELECT doc_id FROM documents WHERE lang <> 'en'),
l AS (SELECT 'a' AS voter, a0 AS verdict FROM v JOIN k USING (doc_id) WHERE a_ok UNION ALL SELECT 'b', b0 FROM v JOIN k USING (doc_id) WHERE b_ok)
SELECT voter, count(*) AS n, count(*) FILTER (WHERE verdict = 'false') AS "right", count(*) >= 10 AND count(*) FILTER (WHERE verdict = 'false') >= 8 AS passed FROM l GROUP BY voter""")
def _(spark, sf):
    controls = load(spark, sf, "documents").where("lang != 'en'").select(F.col("source").alias("entity"), F.col("doc_id").alias("doc"))
    return acc.control_score(_long_votes(spark, sf), controls)


def _candidates(spark, sf):
    """Labelled documents as candidates of their source and language, with their votes."""
    labelled = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left_semi")
    docs = labelled.select(F.concat_ws("-", "source", "lang").alias("entity"), F.col("doc_id").alias("doc"))
    votes = acc.vote_validity(_raw_votes(spark, sf)).where("valid").withColumnRenamed("doc_id", "doc")
    votes = votes.join(docs, "doc").select("entity", "doc", "voter")
    noisy = docs.where("entity like 'src1-%'").select("entity").distinct()
    return docs, votes, noisy


@query("adjudication_ready", f"""WITH {VOTES_SQL}, c AS (SELECT d.source || '-' || d.lang AS entity, d.doc_id, a_ok AND b_ok AS both_ok FROM documents d JOIN v USING (doc_id))
SELECT entity, count(*) AS candidates FROM c WHERE entity NOT LIKE 'src1-%' GROUP BY entity HAVING bool_and(both_ok) AND count(*) <= 220""")
def _(spark, sf):
    docs, votes, noisy = _candidates(spark, sf)
    return acc.adjudication_ready(docs, votes, ("a", "b"), noisy).select("entity", "candidates")


@query("adjudication_status", f"""WITH {VOTES_SQL}, c AS (SELECT d.source || '-' || d.lang AS entity, d.doc_id, a_ok AND b_ok AS both_ok FROM documents d JOIN v USING (doc_id)),
s AS (SELECT entity, count(*) AS candidates, count(*) FILTER (WHERE both_ok) AS voted FROM c GROUP BY entity)
SELECT *, CASE WHEN entity LIKE 'src1-%' THEN 'listed-as-noisy' WHEN candidates > 8 THEN 'too-many-candidates' WHEN voted < candidates THEN 'votes-missing' ELSE 'ready' END AS status FROM s""")
def _(spark, sf):
    docs, votes, noisy = _candidates(spark, sf)
    return acc.adjudication_status(docs, votes, ("a", "b"), noisy, most=8)


@query("evidence_key", """
SELECT doc_id, sha256('{"voter":"a","version":"v2","f0":"' || source || '","f1":' || CASE WHEN lang = 'en' THEN 'null' ELSE '"' || lang || '"' END || '}') AS key FROM documents""")
def _(spark, sf):
    d = load(spark, sf, "documents").withColumn("kind", F.when(F.col("lang") != "en", F.col("lang")))
    return d.select("doc_id", acc.evidence_key(F.lit("a"), F.lit("v2"), "source", "kind").alias("key"))
