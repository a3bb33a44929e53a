"""Research-stage checklist of each entity.

Beyond the columns of ``confidence``: ``genes, parent_studies, phenotypes,
other_phenotypes, models, designations, approved, fda_count, ema_count``. A null
in an enrichment column means that source was not joined yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .confidence import failed

# Evidence classes that identify a gene, fully and in part.
GENE_MET = ["Definitive", "Strong", "Moderate", "Limited", "Animal Model Only"]
GENE_PARTIAL = ["Disputed"]


def _stage(name: str, status: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("id"), status.alias("status"), detail.alias("detail"))


def readiness_stages(df: DataFrame) -> DataFrame:
    """Adds ``stages`` (six structs), ``filled`` and ``scored``."""
    met, partial, absent, unknown = (F.lit(s) for s in ("met", "partial", "absent", "unknown"))
    has_genes = F.coalesce(F.size("genes"), F.lit(0)) > 0
    known_class = F.coalesce(F.col("gene_class").isin(GENE_MET), F.lit(False))
    gene = (
        F.when(known_class & has_genes, met)
        .when(known_class | has_genes | F.coalesce(F.col("gene_class").isin(GENE_PARTIAL), F.lit(False)), partial)
        .otherwise(absent)
    )
    gene_detail = F.concat_ws(
        " ", F.coalesce("gene_class", F.lit("None")), F.array_join(F.slice("genes", 1, 5), ", ")
    )
    broken = F.col("health") == "broken"
    literature = (
        F.when(F.col("papers").isNull() | broken, unknown).when(F.col("papers") > 0, met).otherwise(absent)
    )
    first, second = F.col("phenotypes"), F.col("other_phenotypes")
    phenotype = (
        F.when(first.isNull() & F.coalesce(second > 0, F.lit(False)), met)
        .when(first.isNull(), unknown)
        .when(first > 0, met)
        .otherwise(absent)
    )
    model = F.when(F.col("models").isNull(), unknown).when(F.col("models") > 0, met).otherwise(absent)
    designation = (
        F.when(F.col("designations").isNull(), unknown)
        .when(F.col("designations") <= 0, absent)
        .when(F.col("approved") > 0, met)
        .otherwise(partial)
    )
    study = (
        F.when(F.col("studies").isNull() | failed("studies_error") | broken, unknown)
        .when(F.col("studies") > 0, met)
        .when(F.coalesce("parent_studies", F.lit(0)) > 0, partial)
        .otherwise(absent)
    )
    counted = lambda c, noun: F.concat_ws(" ", F.col(c).cast("string"), F.lit(noun))
    stages = F.array(
        _stage("gene", gene, gene_detail),
        _stage("literature", literature, counted("papers", "matched papers")),
        _stage("phenotype", phenotype, F.concat_ws(" ", F.coalesce(first, second).cast("string"), F.lit("annotations"))),
        _stage("animal-model", model, counted("models", "models")),
        _stage("orphan-designation", designation, F.concat_ws(
            " ", F.col("fda_count").cast("string"), F.lit("FDA"), F.col("ema_count").cast("string"), F.lit("EMA"))),
        _stage("interventional-trial", study, counted("studies", "matched studies")),
    )
    df = df.withColumn("stages", stages)
    return df.withColumn(
        "filled", F.size(F.filter("stages", lambda s: s["status"].isin("met", "partial")))
    ).withColumn("scored", F.size("stages"))


def stage_status(stage: str) -> Column:
    return F.get(F.filter("stages", lambda s: s["id"] == stage), F.lit(0))["status"]


def readiness_summary(df: DataFrame) -> DataFrame:
    """Adds ``summary``: the first of seven states that holds."""
    gene, model = stage_status("gene"), stage_status("animal-model")
    study, papers = stage_status("interventional-trial"), stage_status("literature")
    some_gene = gene.isin("met", "partial")
    none = study == "absent"
    summary = (
        F.when(study == "met", "study-matched")
        .when(study == "partial", "broader-study-only")
        .when(none & some_gene & (model == "met"), "gene-and-model-no-study")
        .when(none & some_gene & (papers == "met"), "gene-and-papers-no-study")
        .when(none & (gene == "absent") & (model != "met") & (papers != "met"), "sparse-signals")
        .when(F.col("health") == "broken", "query-returned-nothing")
        .otherwise("checklist-only")
    )
    return df.withColumn("summary", summary)
