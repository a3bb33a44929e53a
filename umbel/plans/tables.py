"""The driver tables in the roles the operators expect, in Spark and in SQL.

Parts stand for catalogue entities and line items for the evidence about them;
documents stand for studies and papers, benchmark sentences for search terms.
Every input is a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import spread


# Tables whose rows are costly to process; small files of them are spread out.
TEXT_TABLES = {"documents", "part", "pages", "conversations"}


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf}/{table}.parquet")
    return spread(scan) if table in TEXT_TABLES else scan


# ---- entities ----------------------------------------------------------------

_EVIDENCE = {
    "papers": "sum(if(l_quantity >= 45, cast(l_quantity as bigint), 0))",
    "recent": "sum(if(l_quantity >= 45 and l_shipdate >= timestamp '2000-01-01', cast(l_quantity as bigint), 0))",
    "studies": "sum(if(l_returnflag = 'R' and l_discount >= 0.075 and l_quantity >= 30, cast(l_linenumber as bigint), 0))",
    "other_studies": "sum(if(l_returnflag = 'A' and l_discount >= 0.075 and l_quantity >= 40, 1, 0))",
    "wider_studies": "sum(if(l_linestatus = 'O' and l_tax >= 0.075 and l_quantity >= 40, 1, 0))",
    "paper_fail": "sum(if(l_returnflag = 'N' and l_tax >= 0.075 and l_quantity >= 49, 1, 0))",
    "study_fail": "sum(if(l_returnflag = 'N' and l_tax <= 0.005 and l_quantity >= 49, 1, 0))",
    "cut_scans": "sum(if(l_discount <= 0.005 and l_quantity >= 50, 1, 0))",
    "phrase_hits": "sum(if(l_quantity >= 47, 1, 0))",
    "mesh_hits": "sum(if(l_quantity >= 45 and l_returnflag = 'R', 1, 0))",
    "models": "sum(if(l_quantity <= 1, 1, 0))",
    "designations": "sum(if(l_quantity >= 50, 1, 0))",
    "approved": "sum(if(l_quantity >= 50 and l_returnflag = 'R', 1, 0))",
    "last_check": "max(l_shipdate)",
}


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """One row per part: names from the part, counts from its line items.

    Line items are reduced per part before the join, so a part that holds very
    many of them costs one partial row per task.
    """
    li = load(spark, sf, "lineitem")
    counts = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        *[F.expr(e).alias(n) for n, e in _EVIDENCE.items()]
    )
    people = (
        li.where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
        .groupBy("p_partkey").agg(F.count("*").alias("people"))
    )
    j = load(spark, sf, "part").join(counts, "p_partkey", "left").join(people, "p_partkey", "left")
    filled = j.withColumns(
        {n: F.coalesce(n, F.lit(0)) for n in [*_EVIDENCE, "people"] if n != "last_check"}
    )
    size = F.col("p_size")
    none = F.array().cast("array<string>")
    pick = lambda test, arr: F.when(test, arr).otherwise(none)
    ok_p, ok_s = F.col("paper_fail") == 0, F.col("study_fail") == 0
    name = F.concat(
        "p_name", F.lit(" "), "p_type", F.when(size == 50, F.lit(" Þ")).otherwise(F.lit(""))
    )
    return filled.select(
        F.col("p_partkey").cast("string").alias("code"),
        name.alias("name"),
        F.when(size % 13 == 0, F.concat("p_name", F.lit(" fixed"))).alias("name_corrected"),
        F.concat(
            F.array("p_brand", "p_type", "p_name"),
            pick(size % 3 == 0, F.array(F.substring_index("p_brand", "#", -1))),
        ).alias("synonyms"),
        F.when(size > 10, F.col("p_name")).alias("definition"),
        pick(size % 7 != 0, F.array(F.concat(F.lit("MONDO:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")))).alias("node_ids"),
        F.when(size % 4 == 0, "<1 / 1 000 000").when(size % 4 == 1, "Unknown").when(size % 4 == 2, "1-9 / 100 000").alias("prevalence_class"),
        F.when(size % 6 == 0, "Definitive").when(size % 6 == 1, "Strong").when(size % 6 == 2, "Limited").when(size % 6 == 3, "Disputed").otherwise("None").alias("gene_class"),
        pick(size % 5 < 3, F.array("p_type")).alias("genes"),
        F.when(ok_p, F.col("papers")).alias("papers"),
        F.when(ok_p, F.col("recent")).alias("recent"),
        F.when(ok_s, F.col("studies")).alias("studies"),
        F.when(ok_s, F.col("studies") + F.col("other_studies")).alias("registered"),
        F.when(F.col("wider_studies") > 0, F.col("wider_studies")).alias("parent_studies"),
        (F.col("cut_scans") == 0).alias("fully_scanned"),
        F.when(~ok_p, "read failed").alias("papers_error"),
        F.when(~ok_s, "read failed").alias("studies_error"),
        F.when(size % 2 == 0, F.array(F.lit("phrase"), F.lit("mesh"))).otherwise(F.array(F.lit("phrase"))).alias("tried"),
        F.array_compact(
            F.array(F.when(F.col("phrase_hits") > 0, "phrase"), F.when(F.col("mesh_hits") > 0, "mesh"))
        ).alias("hit"),
        F.col("p_name").alias("probe_label"),
        (size * 3).cast("bigint").alias("probe_hits"),
        "people",
        F.array_compact(F.array(F.col("p_type"), F.when(size % 9 == 0, F.col("p_name")))).alias("recall_terms"),
        F.concat(F.lit('"'), "p_name", F.lit('"')).alias("query"),
        F.concat(F.lit('"'), "p_name", F.when(size % 11 == 0, F.lit(" disease or disorder")).otherwise(F.lit("")), F.lit('"')).alias("study_query"),
        pick(size % 17 == 0, F.array(F.lit("ctis"), F.lit("isrctn"))).alias("secondary_errors"),
        (size % 2).cast("bigint").alias("secondary_fetched"),
        F.when(size % 8 != 0, F.col("models")).alias("models"),
        F.when(size % 10 != 0, F.col("models") + F.col("designations")).alias("phenotypes"),
        F.col("mesh_hits").alias("other_phenotypes"),
        F.when(size % 12 != 0, F.col("designations")).alias("designations"),
        "approved",
        F.col("designations").alias("fda_count"),
        F.lit(0).cast("bigint").alias("ema_count"),
        F.col("p_type").alias("group"),
        F.when(size % 14 != 0, F.col("last_check")).alias("last_check"),
    )



ENTITIES_SQL = """
ev AS (SELECT l_partkey AS p_partkey, %s,
         count(DISTINCT l_suppkey) FILTER (WHERE l_quantity >= 45) AS people
       FROM lineitem GROUP BY l_partkey),
pe AS (SELECT p.*, %s, coalesce(people, 0) AS people, last_check
       FROM part p LEFT JOIN ev USING (p_partkey)),
entities AS (SELECT
  CAST(p_partkey AS VARCHAR) AS code,
  p_name || ' ' || p_type || CASE WHEN p_size = 50 THEN ' Þ' ELSE '' END AS name,
  CASE WHEN p_size %% 13 = 0 THEN p_name || ' fixed' END AS name_corrected,
  list_concat([p_brand, p_type, p_name], CASE WHEN p_size %% 3 = 0 THEN [split_part(p_brand, '#', 2)] ELSE [] END) AS synonyms,
  CASE WHEN p_size > 10 THEN p_name END AS definition,
  CASE WHEN p_size %% 7 <> 0 THEN ['MONDO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0')] ELSE [] END AS node_ids,
  CASE p_size %% 4 WHEN 0 THEN '<1 / 1 000 000' WHEN 1 THEN 'Unknown' WHEN 2 THEN '1-9 / 100 000' END AS prevalence_class,
  CASE p_size %% 6 WHEN 0 THEN 'Definitive' WHEN 1 THEN 'Strong' WHEN 2 THEN 'Limited' WHEN 3 THEN 'Disputed' ELSE 'None' END AS gene_class,
  CASE WHEN p_size %% 5 < 3 THEN [p_type] ELSE [] END AS genes,
  CASE WHEN paper_fail = 0 THEN papers END AS papers,
  CASE WHEN paper_fail = 0 THEN recent END AS recent,
  CASE WHEN study_fail = 0 THEN studies END AS studies,
  CASE WHEN study_fail = 0 THEN studies + other_studies END AS registered,
  nullif(wider_studies, 0) AS parent_studies,
  cut_scans = 0 AS fully_scanned,
  CASE WHEN paper_fail > 0 THEN 'read failed' END AS papers_error,
  CASE WHEN study_fail > 0 THEN 'read failed' END AS studies_error,
  CASE WHEN p_size %% 2 = 0 THEN ['phrase', 'mesh'] ELSE ['phrase'] END AS tried,
  CAST(phrase_hits > 0 AS INT) + CAST(mesh_hits > 0 AS INT) AS n_hit,
  p_name AS probe_label, p_size * 3 AS probe_hits, people,
  p_size, p_type, p_brand, p_name,
  p_size %% 9 = 0 AS dirty_recall,
  p_size %% 11 = 0 AS scaffold_query,
  p_size %% 17 = 0 AS sources_failed, p_size %% 2 AS secondary_fetched,
  CASE WHEN p_size %% 8 <> 0 THEN models END AS models,
  CASE WHEN p_size %% 10 <> 0 THEN models + designations END AS phenotypes,
  mesh_hits AS other_phenotypes,
  CASE WHEN p_size %% 12 <> 0 THEN designations END AS designations,
  approved, p_type AS "group",
  CASE WHEN p_size %% 14 <> 0 THEN last_check END AS last_check
  FROM pe)
""" % (
    ",\n  ".join(f"{e} AS {n}" for n, e in _EVIDENCE.items()),
    ", ".join(f"coalesce({n}, 0) AS {n}" for n in _EVIDENCE if n != "last_check"),
)

# Normalised term and token-boundary containment, as SQL.
NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def norm_sql(x: str) -> str:
    return NORM.format(x)


# ---- search terms and documents ----------------------------------------------


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence of every benchmark item: ``item_id, term``."""
    b = load(spark, sf, "benchmark")
    return b.select("item_id", F.explode(F.split("text", r"[.\n]")).alias("term"))


SENTENCES_SQL = f"""
phr AS MATERIALIZED (SELECT DISTINCT item_id, {norm_sql('s')} AS term
        FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[.\\n]')) AS s FROM benchmark)
        WHERE length({norm_sql('s')}) >= 4)
"""


def strategies(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark pieces as terms: sentences, lines, comma pieces."""
    b = load(spark, sf, "benchmark")
    parts = {"phrase": r"[.\n]", "mesh": r"\n", "recall": r"[,.\n]"}
    tagged = F.array(
        *[F.struct(F.lit(s).alias("strategy"), F.split("text", rx).alias("terms")) for s, rx in parts.items()]
    )
    wide = b.select("item_id", F.explode(tagged).alias("s"))
    return wide.select("item_id", "s.strategy", F.explode("s.terms").alias("term"))


STRATEGIES_SQL = "strat AS MATERIALIZED (" + " UNION ALL ".join(
    f"""SELECT DISTINCT item_id, '{s}' AS strategy, {m} AS least, {norm_sql('s')} AS term
        FROM (SELECT item_id, unnest(regexp_split_to_array(text, '{rx}')) AS s FROM benchmark)
        WHERE length({norm_sql('s')}) >= 4"""
    for s, m, rx in (("phrase", 8, "[.\\n]"), ("mesh", 6, "\\n"), ("recall", 4, "[,.\\n]"))
) + ")"


def studies(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as studies: the text is the title, its lines the conditions."""
    return load(spark, sf, "documents").select(
        F.col("doc_id").alias("nct_id"),
        F.col("text").alias("title"),
        F.split("text", "\n").alias("conditions"),
        F.when(F.col("lang") == "en", "INTERVENTIONAL").when(F.col("lang") == "fr", "OBSERVATIONAL").otherwise("EXPANDED_ACCESS").alias("study_type"),
        F.when(F.col("source").isin("src0", "src1", "src2", "src3"), "RECRUITING").otherwise("COMPLETED").alias("status"),
        "source",
    )


STUDIES_SQL = f"""
studies AS MATERIALIZED (SELECT doc_id AS doc, {norm_sql('text')} AS title, string_split(text, chr(10)) AS raw_lines,
  CASE lang WHEN 'en' THEN 'INTERVENTIONAL' WHEN 'fr' THEN 'OBSERVATIONAL' ELSE 'EXPANDED_ACCESS' END AS study_type,
  CASE WHEN source IN ('src0','src1','src2','src3') THEN 'RECRUITING' ELSE 'COMPLETED' END AS status, source
  FROM documents),
cond AS MATERIALIZED (SELECT doc, {norm_sql('l')} AS line FROM (SELECT doc, unnest(raw_lines) AS l FROM studies)),
hits AS (SELECT item_id AS entity, strategy, doc, bool_or(via_c) AS via_condition, bool_or(NOT via_c) AS via_title FROM (
    SELECT item_id, strategy, doc, true AS via_c FROM strat JOIN cond ON contains(' ' || line || ' ', ' ' || term || ' ')
    UNION ALL
    SELECT item_id, strategy, doc, false FROM strat JOIN studies ON length(term) >= least AND contains(' ' || title || ' ', ' ' || term || ' ')
  ) GROUP BY ALL),
classified AS (SELECT entity, doc, bool_or(strategy = 'phrase') AS phrase, bool_or(strategy = 'mesh') AS mesh,
    bool_or(strategy = 'recall') AS recall,
    CASE WHEN bool_or(strategy = 'phrase') AND bool_or(strategy = 'mesh') THEN 'both'
         WHEN bool_or(strategy = 'phrase') THEN 'phrase' WHEN bool_or(strategy = 'mesh') THEN 'mesh'
         ELSE 'recall-expansion' END AS matched_via
  FROM hits GROUP BY ALL)
"""

# Normalised first spelling of a text list, as used by several rules.
COMMON_WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in T.vocab.COMMON_WORDS) + "]"
