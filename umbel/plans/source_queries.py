"""Readers and sinks over files that Spark derives from the driver tables.

Every query writes its table in a source's own format to the shared folder,
reads it back through the reader, and must agree with the table itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signals import data_as_of
from ..runtime import scratch_path
from ..sources import catalogue, ontology, policy, publishing, records, sinks, snapshots
from . import sqltext as S
from .derive_queries import CATALOGUE_SQL, DERIVED_SQL, _catalogue, derived_table
from .registry import query
from .tables import entities, load



def _lines(df, label: str) -> str:
    """Write one text column as lines; returns the folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.text(path)
    return path


def _records(df, label: str) -> str:
    """Write XML records one after the other, several to a line; returns the folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("lineSep", " ").text(path)
    return path


def _tag(name: str, value, attrs: str = "") -> F.Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"<{name}{attrs}>"), value, F.lit(f"</{name}>"))


def _catalogue_xml(spark, sf) -> str:
    size, n, key = F.col("p_size"), F.col("p_name"), F.col("p_partkey").cast("string")
    section = lambda kind, body: _tag("TextSection", F.concat(_tag("TextSectionType", _tag("Name", kind)), _tag("Contents", body)))
    ref = lambda s, v: _tag("ExternalReference", F.concat(_tag("Source", s), _tag("Reference", v)))
    row = F.concat(
        F.lit('<Disorder id="'), key, F.lit('">'),
        F.when(size % 20 == 0, F.lit("")).otherwise(_tag("OrphaCode", key)),
        _tag("ExpertLink", F.concat(F.lit("http://x.org/"), key), ' lang="en"'),
        _tag("Name", n, ' lang="en"'),
        _tag("SynonymList", F.concat(_tag("Synonym", F.col("p_brand"), ' lang="en"'), F.when(size % 2 == 0, _tag("Synonym", F.col("p_type"))).otherwise("")), ' count="2"'),
        _tag("ExternalReferenceList", F.concat(ref("OMIM", key), ref("MONDO", key))),
        _tag("SummaryInformationList", _tag("SummaryInformation", _tag("TextSectionList", F.concat(
            section("Definition", F.concat(F.lit("first "), n)), section("Other", "no"),
            F.when(size % 3 == 0, section("Definition", F.concat(F.lit("A &lt;i&gt;"), n, F.lit("&lt;/i&gt; of &amp;amp; more")))).otherwise(""),
        )))),
        _tag("DisorderGroup", _tag("Name", F.when(size % 5 == 0, "Group of disorders").otherwise("Disorder"), ' lang="en"'), ' id="1"'),
        _tag("DisorderType", _tag("Name", F.col("p_type"))),
        F.lit("</Disorder>"),
    )
    return _records(load(spark, sf, "part").select(row.alias("value")), "catalogue")


@query("read_catalogue", """
SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_brand || CASE WHEN p_size % 2 = 0 THEN '|' || p_type ELSE '' END AS synonyms,
  CASE WHEN p_size % 3 = 0 THEN 'A ' || p_name || ' of & more' ELSE 'first ' || p_name END AS definition, 'MONDO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS nodes,
  'https://x.org/' || p_partkey AS link, CASE WHEN p_size % 5 = 0 THEN 'Group of disorders' ELSE 'Disorder' END AS "group", p_type AS type FROM part WHERE p_size % 20 <> 0""")
def _(spark, sf):
    d = catalogue.read_catalogue(spark, _catalogue_xml(spark, sf))
    return d.select(
        "code", "name", F.array_join("synonyms", "|").alias("synonyms"), "definition", F.array_join("node_ids", "|").alias("nodes"), "link", "group", "type"
    )


@query("read_prevalence", """
SELECT CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_size % 3 = 0 THEN '1-9 / ' || p_size ELSE 'class ' || p_type END AS prevalence_class FROM part""")
def _(spark, sf):
    def item(kind, geo, cls):
        return _tag("Prevalence", F.concat(_tag("PrevalenceType", _tag("Name", kind)), _tag("PrevalenceGeographic", _tag("Name", geo)), _tag("PrevalenceClass", _tag("Name", cls))))

    size = F.col("p_size")
    row = F.concat(
        F.lit('<Disorder id="1">'), _tag("OrphaCode", F.col("p_partkey").cast("string")),
        _tag("PrevalenceList", F.concat(
            item("Annual incidence", "Worldwide", F.lit("")), item("Cases", "Europe", F.concat(F.lit("class "), "p_type")),
            F.when(size % 3 == 0, item("Point prevalence", "Worldwide", F.concat(F.lit("&lt;i&gt;1-9 / "), size.cast("string"), F.lit("&lt;/i&gt;")))).otherwise(item("Point prevalence", "Europe", "other")),
        )), F.lit("</Disorder>"),
    )
    return catalogue.read_prevalence(spark, _records(load(spark, sf, "part").select(row.alias("value")), "prevalence"))


@query("usable_entities", f"WITH {CATALOGUE_SQL} SELECT code, name FROM cat WHERE coalesce(grp, '') <> 'Group of disorders' AND p_size % 7 > 1")
def _(spark, sf):
    return catalogue.usable_entities(_catalogue(spark, sf))[0].select("code", "name")


@query("excluded_entities", f"WITH {CATALOGUE_SQL} SELECT count(*) FILTER (WHERE p_size % 7 < 2) AS excluded FROM cat WHERE coalesce(grp, '') <> 'Group of disorders'")
def _(spark, sf):
    return catalogue.usable_entities(_catalogue(spark, sf))[1]


@query("catalogue_nodes", "SELECT CAST(p_partkey AS VARCHAR) AS code, 0 AS pos, 'MONDO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS node FROM part")
def _(spark, sf):
    return catalogue.usable_entities(_catalogue(spark, sf))[2]


def _ontology(spark, sf):
    """One small graph document per customer: its node and its two parents."""
    iri = lambda c: F.concat(F.lit("http://purl.obolibrary.org/obo/MONDO_"), F.lpad(c.cast("string"), 7, "0"))
    k = F.col("c_custkey")
    edge = lambda p, o: F.struct(iri(k).alias("sub"), F.lit(p).alias("pred"), iri(o).alias("obj"))
    graph = F.struct(
        F.struct(F.concat(F.lit("2024-05-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("version")).alias("meta"),
        F.array(
            F.struct(
                iri(k).alias("id"), F.col("c_name").alias("lbl"), F.when(k % 10 == 0, "PROPERTY").otherwise("CLASS").alias("type"),
                F.struct(
                    F.array(*[F.struct(x.alias("val")) for x in (F.concat(F.lit("OMIM:"), k.cast("string")), F.lit(" "), F.concat(F.lit("OMIM:"), k.cast("string")))]).alias("xrefs"),
                    F.array(
                        F.struct(F.lit("hasExactSynonym").alias("pred"), F.col("c_mktsegment").alias("val")),
                        F.struct(F.lit("hasRelatedSynonym").alias("pred"), F.lit("no").alias("val")),
                    ).alias("synonyms"),
                ).alias("meta"),
            )
        ).alias("nodes"),
        F.array(edge("is_a", F.floor(k / 2)), edge("part_of", k), edge("is_a", F.floor(k / 2)), edge("is_a", F.floor(k / 3))).alias("edges"),
    )
    path = scratch_path(spark, "ontology")
    load(spark, sf, "customer").select(F.array(graph).alias("graphs")).write.json(path)
    return ontology.read_ontology(spark, path, one_document_per_line=True)


@query("read_ontology_nodes", """SELECT 'MONDO:' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS id, c_name AS label, 'OMIM:' || c_custkey AS xrefs, c_mktsegment AS synonyms FROM customer WHERE c_custkey % 10 <> 0""")
def _(spark, sf):
    n = _ontology(spark, sf)[0]
    return n.select("id", "label", F.array_join("xrefs", "|").alias("xrefs"), F.array_join("exact_synonyms", "|").alias("synonyms"))


@query("read_ontology_version", "SELECT '2024-05-' || lpad(CAST(max(c_custkey % 28 + 1) AS VARCHAR), 2, '0') AS version FROM customer")
def _(spark, sf):
    return _ontology(spark, sf)[2]


@query("read_ontology_edges", """
SELECT 'MONDO:' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS child, 'MONDO:' || lpad(CAST(p AS VARCHAR), 7, '0') AS parent, min(pos) AS pos FROM (
  SELECT c_custkey, c_custkey // 2 AS p, 0 AS pos FROM customer UNION ALL SELECT c_custkey, c_custkey // 3, 3 FROM customer) GROUP BY ALL""")
def _(spark, sf):
    return _ontology(spark, sf)[1]


def _evidence(spark, sf):
    size = F.col("p_size")
    title = F.when(size % 7 == 0, "Strong").when(size % 7 == 1, " definitive (curated)").when(size % 7 == 2, "Moderate evidence").when(size % 7 == 3, "animal model only").when(size % 7 == 4, "No Known Disease Relationship").otherwise("unrated")
    p = load(spark, sf, "part").select(
        F.when(size % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("MONDO:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))).alias("disease_curie"),
        F.lit("x").alias("other"), title.alias("classification_title"), F.col("p_type").alias("gene_symbol"),
        F.when(size % 2 == 0, F.concat(F.lit("orpha:"), F.col("p_partkey").cast("string"))).alias("disease_original_curie"),
        F.when(size % 9 == 0, "b7c1-uuid").otherwise(F.concat(F.lit("2020-01-"), F.lpad((size % 28 + 1).cast("string"), 2, "0"))).alias("submitted_run_date"),
    )
    path = scratch_path(spark, "evidence")
    p.write.option("sep", "\t").option("header", True).csv(path)
    return ontology.read_evidence(spark, path)


@query("read_evidence", """
WITH e AS (SELECT *, CASE p_size % 7 WHEN 0 THEN 'Strong' WHEN 1 THEN 'Definitive' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Animal Model Only' WHEN 4 THEN 'No Known Disease Relationship' END AS c,
  CASE p_size % 7 WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 2 THEN 5 WHEN 3 THEN 3 WHEN 4 THEN 0 END AS r FROM part WHERE p_size % 4 <> 0 AND p_size % 7 < 5)
SELECT 'MONDO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS key, c AS class, r AS rank, p_type AS gene FROM e
UNION ALL SELECT 'ORPHA:' || p_partkey, c, r, p_type FROM e WHERE p_size % 2 = 0""")
def _(spark, sf):
    return _evidence(spark, sf)[0].select("key", "class", "rank", "gene")


@query("evidence_version", "SELECT max('2020-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0')) AS version FROM part WHERE p_size % 9 <> 0")
def _(spark, sf):
    return _evidence(spark, sf)[1]


def _study_files(spark, sf) -> str:
    k = F.col("doc_id")
    d = load(spark, sf, "documents").select(
        F.struct(
            F.struct(
                F.when(k % 50 != 0, F.concat(F.lit("NCT"), F.lpad(k.cast("string"), 8, "0"))).alias("nctId"),
                F.when(k % 3 == 0, F.col("text")).otherwise("").alias("briefTitle"), F.when(k % 3 == 1, F.col("text")).alias("officialTitle"),
            ).alias("identificationModule"),
            F.struct(F.when(k % 4 != 0, F.upper("source")).alias("overallStatus")).alias("statusModule"),
            F.struct(F.split("text", "\n").alias("conditions")).alias("conditionsModule"),
            F.struct(F.col("lang").alias("studyType")).alias("designModule"),
        ).alias("protocolSection")
    )
    path = scratch_path(spark, "studies")
    d.write.json(path)
    return path


@query("read_studies", """
SELECT 'NCT' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS nct_id, CASE WHEN doc_id % 3 = 2 THEN md5('Untitled study') ELSE md5(trim(text, ' ' || chr(10) || chr(9) || chr(13))) END AS title,
  CASE WHEN doc_id % 4 = 0 THEN 'UNKNOWN' ELSE upper(source) END AS status, len(string_split(text, chr(10))) AS conditions, lang AS study_type FROM documents WHERE doc_id % 50 <> 0""")
def _(spark, sf):
    d = records.read_studies(spark, _study_files(spark, sf))
    return d.select("nct_id", F.md5("title").alias("title"), "status", F.size("conditions").alias("conditions"), "study_type")


@query("read_slim_studies", """
SELECT 'NCT' || doc_id AS nct_id, md5(text) AS title, lang AS study_type, len(string_split(text, chr(10))) AS conditions, 0 AS keywords FROM documents""")
def _(spark, sf):
    d = load(spark, sf, "documents").select(
        F.concat(F.lit("NCT"), F.col("doc_id").cast("string")).alias("nctId"), F.col("text").alias("officialTitle"),
        F.col("lang").alias("studyType"), F.split("text", "\n").alias("conditions"),
    )
    path = scratch_path(spark, "slim")
    d.write.json(path)
    r = records.read_slim_studies(spark, path)
    return r.select("nct_id", F.md5("title").alias("title"), "study_type", F.size("conditions").alias("conditions"), F.size("keywords").alias("keywords"))


def _paper_files(spark, sf) -> str:
    """Orders as papers; one or two authors, in both JSON forms."""
    k = F.col("o_orderkey")
    author = lambda last, aff: F.concat(
        F.lit('{"fullName":"'), last, F.lit(' X","lastName":"'), last, F.lit('","initials":"X","authorAffiliationDetailsList":{"authorAffiliation":'), aff, F.lit("}}")
    )
    a = author(F.concat(F.lit("Name"), F.col("o_custkey").cast("string")), F.concat(F.lit('{"affiliation":"'), "o_orderpriority", F.lit('"}')))
    b = author(F.lit("Second"), F.concat(F.lit('[{"affiliation":" "},{"affiliation":"'), "o_orderstatus", F.lit('"}]')))
    line = F.concat(
        F.lit('{"id":"'), k.cast("string"), F.lit('","title":"t","pubYear":"'), F.year("o_orderdate").cast("string"), F.lit('","authorString":"ignored A, ignored B","authorList":{"author":'),
        F.when(k % 2 == 0, a).otherwise(F.concat(F.lit("["), a, F.lit(","), b, F.lit("]"))), F.lit("}}"),
    )
    return _lines(load(spark, sf, "orders").select(line.alias("value")), "papers")


@query("read_papers", """
SELECT CAST(o_orderkey AS VARCHAR) AS paper, year(o_orderdate) AS year, 0 AS pos, 'Name' || o_custkey AS last, o_orderpriority AS affiliation FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), year(o_orderdate), 1, 'Second', o_orderstatus FROM orders WHERE o_orderkey % 2 = 1""")
def _(spark, sf):
    return records.read_papers(spark, _paper_files(spark, sf))[1].select("paper", "year", "pos", "last", "affiliation")


@query("read_fda_designations", f"""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'C' || p_partkey ELSE 'C1|C' || p_partkey END AS ids,
  CASE WHEN length({S.norm('p_name')}) >= 4 THEN {S.norm('p_name')} END AS key, 'Treatment of ' || p_name AS text, p_brand AS generic FROM part""")
def _(spark, sf):
    size, k = F.col("p_size"), F.col("p_partkey").cast("string")
    text = F.concat(F.lit("Treatment of "), "p_name")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    umls = F.when(size % 3 == 1, quoted(F.concat(F.lit("C"), k))).otherwise(F.concat(F.lit('["C1"," C'), k, F.lit('"]')))
    nested = F.concat(F.lit('{"original_text":'), quoted(text), F.lit(',"umls":'), umls, F.lit("}"))
    line = F.concat(
        F.lit('{"_id":"'), k, F.lit('","fda_orphan_drug":[{"generic_name":'), quoted(F.col("p_brand")), F.lit(',"trade_name":'), quoted(k),
        F.lit(',"orphan_designation":'), F.when(size % 3 == 0, quoted(text)).otherwise(nested), F.lit("}]}"),
    )
    d = records.read_fda_designations(spark, _lines(load(spark, sf, "part").select(line.alias("value")), "fda"))
    return d.select(F.col("row.trade").cast("bigint").alias("p_partkey"), F.array_join("ids", "|").alias("ids"), "key", "row.text", "row.generic")


@query("read_ema_designations", f"""SELECT CAST(p_partkey AS VARCHAR) AS number, {S.norm('p_name')} AS key, 'Prevention of ' || p_name AS text, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS generic FROM part""")
def _(spark, sf):
    size = F.col("p_size")
    d = load(spark, sf, "part").select(
        F.array(
            F.struct(
                F.col("p_type").alias("medicine_name"), F.when(size % 2 == 0, F.col("p_brand")).otherwise(" ").alias("active_substance"),
                F.concat(F.lit("Prevention of "), "p_name").alias("intended_use"), F.col("p_partkey").cast("string").alias("eu_designation_number"),
            )
        ).alias("data")
    )
    path = scratch_path(spark, "ema")
    d.write.json(path)
    return records.read_ema_designations(spark, path, multi_line=False).select("row.number", "key", "row.text", "row.generic")


@query("read_registry_ctis", """
SELECT strftime(o_orderdate, '%Y') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '-11' AS id, 'NCT' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS nct_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'Ended' WHEN 1 THEN 'Authorised' ELSE '77' END AS status, 'a|b' AS conditions, 'CTIS ' || o_orderstatus AS study_type FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    d = load(spark, sf, "orders").select(
        F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-"), F.lpad(k.cast("string"), 6, "0"), F.lit("-11")).alias("ctNumber"),
        F.concat(F.lit("trial nct"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit(" here")).alias("shortTitle"),
        F.lit("a; b,").alias("conditions"), F.when(k % 3 == 0, 10).when(k % 3 == 1, 2).otherwise(77).alias("ctStatus"), F.col("o_orderstatus").alias("trialPhase"),
    )
    path = scratch_path(spark, "ctis")
    d.write.json(path)
    r = records.read_registry_trials(spark, path, "ctis")
    return r.select("id", "nct_id", "status", F.array_join("conditions", "|").alias("conditions"), "study_type")


def _trial_xml(spark, sf) -> str:
    k = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    row = F.concat(
        F.lit("<trial>"), _tag("trial_id", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "ISRCTN").otherwise("DRKS"), k)),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(_tag("public_title", F.concat(F.lit("Title "), k))),
        _tag("scientific_title", F.concat(F.lit("Science "), k)), _tag("secondary_id", F.concat(F.lit("NCT"), k)),
        _tag("condition", "one; two|three"), _tag("recruitment_status", F.col("o_orderstatus")), F.lit("</trial>"),
    )
    return _records(load(spark, sf, "orders").select(row.alias("value")), "trials")


_TRIAL_SQL = """SELECT {id} AS id, 'NCT' || k AS nct_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Science ' ELSE 'Title ' END || k AS title, o_orderstatus AS status, {reg} AS registry, 'one|two|three' AS conditions
FROM (SELECT *, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS k FROM orders)"""


@query("read_registry_ictrp", _TRIAL_SQL.format(id="CASE WHEN o_orderkey % 2 = 0 THEN 'ISRCTN' ELSE 'DRKS' END || k", reg="CASE WHEN o_orderkey % 2 = 0 THEN 'isrctn' ELSE 'drks' END"))
def _(spark, sf):
    r = records.read_registry_trials(spark, _trial_xml(spark, sf), "ictrp")
    return r.select("id", "nct_id", "title", "status", "registry", F.array_join("conditions", "|").alias("conditions"))


@query("read_registry_isrctn", _TRIAL_SQL.format(id="'ISRCTN' || k", reg="'isrctn'"))
def _(spark, sf):
    r = records.read_registry_trials(spark, _trial_xml(spark, sf), "isrctn")
    return r.select("id", "nct_id", "title", "status", "registry", F.array_join("conditions", "|").alias("conditions"))


@query("read_registry_isrctn_full", """
SELECT 'ISRCTN' || k AS id, 'NCT' || k AS nct_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Science ' ELSE 'Title ' END || k AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'Ongoing' ELSE o_orderstatus END AS status,
  'isrctn' AS registry, CASE WHEN o_orderkey % 2 = 0 THEN 'one|two' ELSE 'three' END AS conditions, CASE WHEN o_orderkey % 5 = 0 THEN 'Treatment' ELSE 'Interventional' END AS study_type
FROM (SELECT *, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS k FROM orders)""")
def _(spark, sf):
    n, k = F.col("o_orderkey"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    no = F.lit("")
    row = F.concat(
        F.lit('<fullTrial publicIdentifierCanonical="isrctn'), k, F.lit('">'), F.when(n % 4 == 0, _tag("isrctn", F.concat(F.lit(" isrctn"), k))).otherwise(no),
        F.when(n % 3 == 0, no).otherwise(_tag("title", F.concat(F.lit("Title "), k))), _tag("scientificTitle", F.concat(F.lit("Science "), k)),
        _tag("externalRef", F.concat(F.lit("nct"), k)), F.when(n % 2 == 0, _tag("overallStatus", "Ongoing")).otherwise(_tag("recruitmentStatus", F.col("o_orderstatus"))),
        F.when(n % 2 == 0, _tag("condition", "one; two")).otherwise(_tag("conditions", "three")),
        F.when(n % 5 == 0, _tag("primaryStudyDesign", "Treatment")).otherwise(_tag("studyType", "Interventional")), F.lit("</fullTrial>"),
    )
    r = records.read_registry_trials(spark, _records(load(spark, sf, "orders").select(row.alias("value")), "trials"), "isrctn-full")
    return r.select("id", "nct_id", "title", "status", "registry", F.array_join("conditions", "|").alias("conditions"), "study_type")


@query("read_associations", "SELECT 'MONDO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS subject, p_name AS object_label FROM part")
def _(spark, sf):
    d = load(spark, sf, "part").select(F.concat(F.lit("MONDO:"), F.col("p_partkey").cast("string")).alias("subject"), F.col("p_name").alias("object_label"))
    path = scratch_path(spark, "assoc")
    d.write.json(path)
    return records.read_associations(spark, path).select("subject", "object_label")


def _annotation_files(spark, sf) -> str:
    """Parts as annotation documents; fields come once or as lists."""
    odd = F.col("p_size") % 2 == 1
    chem = F.concat(F.lit('{"chemical_name":"'), "p_brand", F.lit('","direct_evidence":"therapeutic","pubmed":12}'))
    pheno = F.concat(F.lit('{"hpo_id":"HP:'), F.col("p_size").cast("string"), F.lit('","hpo_name":"'), "p_name", F.lit('","numeric_freq":0.5}'))
    block = F.concat(F.lit('{"phenotype_related_to_disease":'), F.when(odd, pheno).otherwise(F.concat(F.lit("["), pheno, F.lit(","), pheno, F.lit("]"))), F.lit("}"))
    line = F.concat(
        F.lit('{"_id":"MONDO:'), F.col("p_partkey").cast("string"), F.when(F.col("p_size") == 50, F.lit('","notfound":true,"x":"')).otherwise(""),
        F.lit('","ctd":{"chemical_related_to_disease":'), F.when(odd, chem).otherwise(F.concat(F.lit("["), chem, F.lit("]"))),
        F.lit(',"pathway_related_to_disease":[{"pathway_name":"'), "p_type", F.lit('"}]},"hpo":'), F.when(odd, F.concat(F.lit("["), block, F.lit("]"))).otherwise(block), F.lit("}"),
    )
    return _lines(load(spark, sf, "part").select(line.alias("value")), "annotations")


@query("read_annotations", """
WITH p AS (SELECT 'MONDO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS node, * FROM part WHERE p_size <> 50)
SELECT node, 'chemical' AS kind, p_brand AS name, 1 AS n FROM p UNION ALL SELECT node, 'pathway', p_type, 1 FROM p UNION ALL SELECT node, 'phenotype', p_name, 2 - p_size % 2 FROM p""")
def _(spark, sf):
    chem, path, pheno = records.read_annotations(spark, _annotation_files(spark, sf))
    tag = lambda d, kind: d.groupBy("node", F.lit(kind).alias("kind"), "name").agg(F.count("*").alias("n"))
    return tag(chem, "chemical").unionByName(tag(path, "pathway")).unionByName(tag(pheno, "phenotype"))


@query("read_drugs", "SELECT 'MONDO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS node, p_brand AS drug, p_name AS name, 'PHASE_2' AS stage, p_size AS source_count FROM part")
def _(spark, sf):
    d = load(spark, sf, "part").select(
        F.concat(F.lit("MONDO_"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_size").cast("bigint").alias("count"),
        F.array(F.struct(F.lit("r").alias("id"), F.lit("PHASE_2").alias("maxClinicalStage"), F.struct(F.col("p_brand").alias("id"), F.col("p_name").alias("name")).alias("drug"))).alias("rows"),
    )
    path = scratch_path(spark, "drugs")
    d.write.json(path)
    return records.read_drugs(spark, path)


def _log_lines(spark, sf):
    k = F.col("event_id")
    line = F.concat(
        F.lit('{"kind":"'), F.when(F.col("event_type") == "view", "live-check").otherwise("refresh-queue"), F.lit('","orphaCode":"'), F.col("user_id").cast("string"),
        F.lit('","ranAt":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","liveTotal":'), k.cast("string"), F.when(k % 40 == 0, F.lit("")).otherwise("}"),
    )
    return load(spark, sf, "events").select(line.alias("value"))


@query("read_refresh_log", """SELECT CASE WHEN event_type = 'view' THEN 'live-check' ELSE 'refresh-queue' END AS kind, CAST(user_id AS VARCHAR) AS code, date_trunc('second', ts) AS spot, event_id AS live_total FROM events WHERE event_id % 40 <> 0""")
def _(spark, sf):
    d = policy.read_refresh_log(spark, _lines(_log_lines(spark, sf), "log"))
    return d.select("kind", "code", F.col("at").alias("spot"), "live_total")


@query("upgrade_schema", """
WITH e AS (SELECT p_partkey, count(l_orderkey) FILTER (WHERE l_quantity >= 49) AS papers, count(l_orderkey) FILTER (WHERE l_quantity >= 50) AS studies FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)
SELECT p_partkey AS code, papers AS phrase_count, 0 AS mesh_count, studies AS registered, CASE WHEN papers > 0 OR studies > 0 THEN 'phrase' ELSE '' END AS hit, CASE WHEN papers > 0 OR studies > 0 THEN 'phrase' ELSE '' END AS matched_via, 'phrase' AS tried FROM e""")
def _(spark, sf):
    li = load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("code")).agg(
        F.count_if(F.col("l_quantity") >= 49).alias("papers"), F.count_if(F.col("l_quantity") >= 50).alias("studies")
    )
    old = load(spark, sf, "part").select(F.col("p_partkey").alias("code")).join(li, "code", "left").select(
        "code", F.coalesce("papers", F.lit(0)).alias("papers"), F.coalesce("studies", F.lit(0)).alias("studies")
    )
    d = policy.upgrade_schema(old)
    joined = [F.array_join(c, ",").alias(c) for c in ("hit", "matched_via", "tried")]
    return d.select("code", "phrase_count", "mesh_count", "registered", *joined)


# ---- sinks -------------------------------------------------------------------


@query("write_artifact", f"WITH {DERIVED_SQL} SELECT code, confidence, papers FROM derived")
def _(spark, sf):
    path = scratch_path(spark, "artifact")
    sinks.write_artifact(derived_table(spark, sf), path)
    return sinks.read_artifact(spark, path).select("code", "confidence", "papers")


def _policies(spark, sf):
    """A policy document per customer: its orders are the entries."""
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(
        F.col("o_orderkey").cast("string").alias("orphaCode"), F.concat(F.lit("entry "), F.col("o_orderkey").cast("string")).alias("name"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("group"), F.when(F.col("o_orderkey") % 11 > 0, "list").otherwise(" ").alias("source"),
        F.when(F.col("o_orderkey") % 13 > 0, "exact").alias("mappingConfidence"),
    )).alias("diseases"))
    k = F.col("o_custkey")
    own = lambda g: F.struct(F.concat(F.lit("label "), F.lit(str(g))).alias("label"), F.lit("fund").alias("mechanism"), F.when(k % 5 > 0, "read").otherwise("").alias("caveat"))
    centre = F.transform(F.sequence(F.lit(1), F.when(k % 4 == 0, 14).otherwise(15)), lambda i: F.struct(F.concat(F.lit("centre "), i.cast("string")).alias("name"), F.when(i < 15, "src").otherwise(F.when(k % 3 > 0, "src")).alias("source")))
    docs = o.select(
        "diseases", F.lit("2024-01-01").alias("lastVerified"), F.when(k % 7 > 0, "https://portal").alias("crowdfundingPortal"),
        F.when(k % 6 > 0, F.array(F.lit("63"))).otherwise(F.array().cast("array<string>")).alias("officialDiseaseCounts"),
        F.create_map(F.lit("1"), own(1), F.lit("2"), own(2)).alias("groupEntitlements"), centre.alias("centresOfExcellence"),
    )
    path = scratch_path(spark, "policies")
    docs.write.json(path)
    return policy.read_policy(spark, path, one_document_per_line=True)


@query("read_policy", "SELECT CAST(o_orderkey AS VARCHAR) AS code, 'entry ' || o_orderkey AS name, CAST(o_orderkey % 3 + 1 AS INT) AS \"group\" FROM orders")
def _(spark, sf):
    return _policies(spark, sf)[0].select("code", "name", "group")


@query("policy_problems", """
WITH d AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT 'ASSERT' AS level, 'portal-missing' AS rule, count(*) FILTER (WHERE k % 7 = 0) AS n FROM d UNION ALL SELECT 'ASSERT', 'official-counts-missing', count(*) FILTER (WHERE k % 6 = 0) FROM d
UNION ALL SELECT 'WARN', 'centre-count', count(*) FILTER (WHERE k % 4 = 0) FROM d UNION ALL SELECT 'ASSERT', 'centre-source-missing', count(*) FILTER (WHERE k % 4 > 0 AND k % 3 = 0) FROM d
UNION ALL SELECT 'ASSERT', 'entitlement-incomplete', 2 * count(*) FILTER (WHERE k % 5 = 0) FROM d
UNION ALL SELECT 'ASSERT', 'entry-incomplete', count(*) FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""")
def _(spark, sf):
    return _policies(spark, sf)[3].groupBy("level", "rule").agg(F.count("*").alias("n"))


@query("latest_snapshot", "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey <> 4")
def _(spark, sf):
    path, c = scratch_path(spark, "snapshots"), load(spark, sf, "customer")
    snapshots.write_snapshot(c, path, "2024-01-01")
    snapshots.write_snapshot(c.where("c_nationkey != 4"), path, "2024-03-01")
    return snapshots.latest_snapshot(spark, path).select("c_custkey", "c_acctbal")


@query("list_snapshots", """SELECT CAST(y AS VARCHAR) || '-01-01' AS snapshot_date, (SELECT count(*) FROM orders WHERE year(o_orderdate) <= y) AS rows
FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) % 3 = 0)""")
def _(spark, sf):
    # Every third year a snapshot of all orders so far.
    path, o = scratch_path(spark, "snapshots"), load(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    for y in sorted(r["year"] for r in o.where("year % 3 = 0").select("year").distinct().collect()):
        snapshots.write_snapshot(o.where(F.col("year") <= y), path, f"{y}-01-01", "o_orderkey")
    return snapshots.list_snapshots(spark, path)


@query("refused_snapshot", "SELECT true AS refused, count(*) AS rows FROM customer")
def _(spark, sf):
    path, c = scratch_path(spark, "snapshots"), load(spark, sf, "customer")
    snapshots.write_snapshot(c, path, "2024-01-01")
    try:
        snapshots.write_snapshot(c.limit(1), path, "2024-01-01")
        refused = False
    except FileExistsError:
        refused = True
    return snapshots.latest_snapshot(spark, path).agg(F.lit(refused).alias("refused"), F.count("*").alias("rows"))


@query("publish_outcomes", """
WITH s AS (SELECT o_custkey, count(*) AS n, max(o_orderstatus) = 'P' AS whole FROM orders GROUP BY ALL),
t AS (SELECT count(*) AS rows, count(*) FILTER (WHERE NOT whole) AS incomplete FROM s), u AS (SELECT count(*) AS rows FROM s WHERE whole)
SELECT rows, incomplete, false AS published, 'not-fully-scanned' AS reasons FROM t UNION ALL SELECT rows, incomplete, false, 'entities-failed,wrong-number-of-rows,not-fully-scanned' FROM t
UNION ALL SELECT rows, 0, true, '' FROM u UNION ALL SELECT rows, 0, false, 'wrong-number-of-rows' FROM u""")
def _(spark, sf):
    scanned = load(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("studies"), (F.max("o_orderstatus") == "P").alias("fully_scanned")
    )
    everyone = load(spark, sf, "orders").select("o_custkey").distinct().count()
    whole = scanned.where("fully_scanned")
    n = whole.count()
    made = [
        publishing.publish(df, scratch_path(spark, "published"), target, failed)
        for df, target, failed in ((scanned, everyone, 0), (scanned, everyone + 1, 2), (whole, n, 0), (whole, n + 1, 0))
    ]
    return reduce(DataFrame.unionByName, made).select("rows", "incomplete", "published", F.array_join("reasons", ",").alias("reasons"))


@query("read_published", "SELECT o_custkey, count(*) AS studies FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def _(spark, sf):
    # The second version is refused, so the first one stands.
    path = scratch_path(spark, "published")
    rows = load(spark, sf, "orders").where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.count("*").alias("studies")).withColumn("fully_scanned", F.lit(True))
    publishing.publish(rows, path, rows.count())
    publishing.publish(rows.withColumn("studies", F.lit(0)), path, -1)
    return publishing.read_published(spark, path).select("o_custkey", "studies")


@query("append_progress", """
WITH n AS (SELECT count(*) AS t FROM orders), d AS (SELECT count(*) AS d FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS added, d AS done, t AS target, least(100, floor(d * 1000.0 / t + 0.5) / 10) AS percent FROM n, d""")
def _(spark, sf):
    path, o = scratch_path(spark, "progress"), load(spark, sf, "orders")
    target = o.count()
    publishing.append_done(o.where("o_orderstatus = 'F'"), path, target)
    return publishing.append_done(o.where("o_orderstatus = 'O'"), path, target)


@query("sample_outcomes", """
SELECT 10 AS wanted, least(10, count(*)) AS drawn, count(*) >= 10 AS enough FROM documents UNION ALL
SELECT 30, least(30, count(*)), count(*) >= 30 FROM nation""")
def _(spark, sf):
    d, n = load(spark, sf, "documents").select("source", "doc_id"), load(spark, sf, "nation").select("n_name", "n_nationkey")
    many = publishing.write_sample(d, scratch_path(spark, "sample"), "control", ["source", "doc_id"])
    return many.unionByName(publishing.write_sample(n, scratch_path(spark, "sample"), "control", ["n_name", "n_nationkey"], 30))


@query("pending", "SELECT c_custkey AS code FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("code"))
    return sinks.pending(c, load(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("code")))


@query("publish_counts", f"WITH {DERIVED_SQL} SELECT count(*) AS rows, count(*) FILTER (WHERE studies IS NOT NULL AND NOT fully_scanned) AS incomplete FROM derived")
def _(spark, sf):
    return sinks.publish_counts(entities(spark, sf))


@query("progress", "SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS done, count(*) AS target, least(100, floor((SELECT count(DISTINCT o_custkey) FROM orders) * 1000.0 / count(*) + 0.5) / 10) AS percent FROM customer")
def _(spark, sf):
    done = load(spark, sf, "orders").select("o_custkey").distinct()
    return sinks.progress(done, usable=load(spark, sf, "customer"))


@query("data_as_of", "SELECT o_orderkey, greatest(o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '1998-01-01' END) AS spot FROM orders")
def _(spark, sf):
    o = load(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("a"),
        F.when(F.col("o_orderkey") % 2 == 0, "1998-01-01T00:00:00Z").alias("b"), F.lit("not a date").alias("c"),
    )
    return o.select("o_orderkey", data_as_of("a", "b", "c").alias("spot"))


@query("append_log", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    path, e = scratch_path(spark, "log"), load(spark, sf, "events").select("event_id", "event_type")
    sinks.append_log(e, path)
    sinks.append_log(e, path)
    return spark.read.schema("event_id bigint, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))
