"""Ontology graph JSON and gene evidence TSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..functions import vocab

GRAPH = """
  graphs array<struct<
    meta: struct<version: string>,
    nodes: array<struct<id: string, lbl: string, type: string,
      meta: struct<xrefs: array<struct<val: string>>, synonyms: array<struct<pred: string, val: string>>>>>,
    edges: array<struct<sub: string, pred: string, obj: string>>>>
"""


def _clean(arr: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(arr, T.strip), lambda v: F.coalesce(v, F.lit("")) != ""))


def read_ontology(spark: SparkSession, path: str, one_document_per_line: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, version)`` from graph documents.

    Class nodes only, exact synonyms only, ``is_a`` edges only and once each. A
    folder of documents reads in parallel, one task per document or, with
    ``one_document_per_line``, splittable.
    """
    docs = spark.read.schema(GRAPH).option("multiLine", not one_document_per_line).json(path)
    graphs = docs.select(F.explode("graphs").alias("g"))
    empty = F.array().cast("array<string>")
    nodes = (
        graphs.select(F.explode("g.nodes").alias("n"))
        .where((F.col("n.type") == "CLASS") & F.col("n.id").rlike(r"(?i)MONDO[_:]\d+"))
        .select(
            I.normalize_curie("n.id").alias("id"),
            F.col("n.lbl").alias("label"),
            F.coalesce(_clean(F.transform("n.meta.xrefs", lambda x: x["val"])), empty).alias("xrefs"),
            F.coalesce(
                _clean(F.transform(F.filter("n.meta.synonyms", lambda s: s["pred"] == "hasExactSynonym"), lambda s: s["val"])),
                empty,
            ).alias("exact_synonyms"),
        )
    )
    mondo = r"(?i)MONDO[_:]\d+"
    edges = (
        graphs.select(F.posexplode("g.edges").alias("pos", "e"))
        .where((F.col("e.pred") == "is_a") & F.col("e.sub").rlike(mondo) & F.col("e.obj").rlike(mondo))
        .select(I.normalize_curie("e.sub").alias("child"), I.normalize_curie("e.obj").alias("parent"), "pos")
        .groupBy("child", "parent").agg(F.min("pos").alias("pos"))
    )
    version = graphs.agg(F.max("g.meta.version").alias("version"))
    return nodes, edges, version


EVIDENCE_COLUMNS = ["disease_curie", "classification_title", "gene_symbol"]


def evidence_title(c: T.C) -> Column:
    """Class name from a submitted title; null when it is none of the known."""
    t = T.strip(c)
    return (
        F.when(t.isin(list(vocab.EVIDENCE_RANK)), t)
        .when(t.rlike("(?i)definitive"), "Definitive")
        .when(t.rlike("(?i)^strong$"), "Strong")
        .when(t.rlike("(?i)moderate"), "Moderate")
        .when(t.rlike("(?i)limited"), "Limited")
        .when(t.rlike("(?i)disputed"), "Disputed")
        .when(t.rlike("(?i)refuted"), "Refuted")
        .when(t.rlike("(?i)animal"), "Animal Model Only")
        .when(t.rlike("(?i)no known"), "No Known Disease Relationship")
    )


def read_evidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(evidence, version)``: rows ``key, class, rank, gene`` and the newest run date.

    A row counts under its node id and under the catalogue code of its original
    id. Dates that are not ISO dates are ignored.
    """
    from ..operators.evidence import evidence_rank

    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    lost = [c for c in EVIDENCE_COLUMNS if c not in raw.columns]
    if lost:
        raise ValueError(f"evidence columns changed: {', '.join(lost)} not found")
    extra = [c for c in ("disease_original_curie", "submitted_run_date") if c not in raw.columns]
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in extra})
    curie = F.coalesce(T.strip("disease_curie"), F.lit(""))
    original = F.regexp_extract(F.coalesce(F.col("disease_original_curie"), F.lit("")), r"(?i)ORPHA:?(\d+)", 1)
    keys = F.array_compact(
        F.array(
            F.when(curie.startswith("MONDO:"), curie),
            F.when(original != "", F.concat(F.lit("ORPHA:"), original)),
        )
    )
    rows = raw.where(curie != "").select(
        F.explode(keys).alias("key"),
        evidence_title("classification_title").alias("class"),
        F.coalesce(T.strip("gene_symbol"), F.lit("")).alias("gene"),
    ).where(F.col("class").isNotNull())
    date = T.strip("submitted_run_date")
    version = raw.agg(F.max(F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}"), date)).alias("version"))
    return rows.withColumn("rank", evidence_rank("class")), version
