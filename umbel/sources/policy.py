"""Policy list, refresh log and older artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

POLICY = """
  lastVerified string, officialDiseaseCountClaim bigint, crowdfundingPortal string,
  officialDiseaseCounts array<string>,
  diseases array<struct<orphaCode: string, name: string, `group`: int, source: string, mappingConfidence: string>>,
  groupEntitlements map<string, struct<label: string, mechanism: string, caveat: string>>,
  centresOfExcellence array<struct<name: string, source: string>>
"""
LOG = """
  kind string, ranAt string, at string, orphaCode string, reason string, publishedTotal double,
  liveTotal double, publishedAsOf string, _corrupt_record string
"""


def read_policy(
    spark: SparkSession, path: str, one_document_per_line: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(entries, entitlements, centres, problems)`` of policy documents, one or a folder of them.

    ``problems`` lists what breaks a structure rule, as ``(level, rule, item)``.
    """
    doc = spark.read.schema(POLICY).option("multiLine", not one_document_per_line).json(path)
    entries = doc.select(F.posexplode("diseases").alias("policy_id", "d")).select(
        "policy_id", F.col("d.orphaCode").alias("code"), "d.name", F.col("d.`group`").alias("group"), "d.source",
        F.col("d.mappingConfidence").alias("mapping_confidence"),
    )
    entitlements = doc.select(F.explode("groupEntitlements").alias("group", "e")).select(
        F.col("group").cast("int").alias("group"), F.col("e.label").alias("entitlement"), "e.mechanism", "e.caveat"
    )
    centres = doc.select(F.explode("centresOfExcellence").alias("c")).select("c.name", "c.source")
    blank = lambda c: F.coalesce(T.strip(c), F.lit("")) == ""
    top = F.array_compact(
        F.array(
            F.when(blank("crowdfundingPortal"), F.lit("portal-missing")),
            F.when(F.coalesce(F.size("officialDiseaseCounts"), F.lit(0)) <= 0, F.lit("official-counts-missing")),
        )
    )
    problems = (
        doc.select(F.lit("ASSERT").alias("level"), F.explode(top).alias("rule"), F.lit("").alias("item"))
        .unionByName(
            doc.where(F.size("centresOfExcellence") != 15).select(
                F.lit("WARN").alias("level"), F.lit("centre-count").alias("rule"),
                F.size("centresOfExcellence").cast("string").alias("item"),
            )
        )
        .unionByName(
            centres.where(blank("source")).select(
                F.lit("ASSERT").alias("level"), F.lit("centre-source-missing").alias("rule"), F.col("name").alias("item")
            )
        )
        .unionByName(
            entitlements.where(blank("entitlement") | blank("mechanism") | blank("caveat")).select(
                F.lit("ASSERT").alias("level"), F.lit("entitlement-incomplete").alias("rule"),
                F.col("group").cast("string").alias("item"),
            )
        )
        .unionByName(
            entries.where(blank("source") | blank("mapping_confidence")).select(
                F.lit("ASSERT").alias("level"), F.lit("entry-incomplete").alias("rule"), F.col("name").alias("item")
            )
        )
    )
    return entries, entitlements, centres, problems


def read_refresh_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines in file order; malformed lines are skipped, undated ones kept."""
    raw = spark.read.schema(LOG).option("mode", "PERMISSIVE").json(path)
    # Files by age, then splits by offset, then rows by their place in the split.
    placed = raw.withColumn(
        "seq",
        F.struct(
            F.col("_metadata.file_modification_time").alias("age"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
        ),
    )
    return placed.where(F.col("_corrupt_record").isNull()).select(
        "kind", F.col("orphaCode").alias("code"), "reason",
        F.try_to_timestamp(F.coalesce("ranAt", "at")).alias("at"),
        F.col("publishedTotal").cast("long").alias("published_total"),
        F.col("liveTotal").cast("long").alias("live_total"), "seq",
    )


# Column, type and the value that stands for a field an older file lacks.
DEFAULTS: dict[str, tuple[str, str | None]] = {
    "name_corrected": ("string", None),
    "synonyms": ("array<string>", "array()"),
    "mesh_labels": ("array<string>", "array()"),
    "probe_label": ("string", None),
    "probe_hits": ("bigint", None),
    "phrase_count": ("bigint", "papers"),
    "mesh_count": ("bigint", "0"),
    "registered": ("bigint", "studies"),
    "observational_total": ("bigint", "0"),
    "expanded_access_total": ("bigint", "0"),
    "parent_studies": ("bigint", None),
    "tried": ("array<string>", "array('phrase')"),
}


def upgrade_schema(df: DataFrame) -> DataFrame:
    """Fill fields an older file lacks; never invents a signal.

    Strategies with hits are taken as stored; only where the file has none are
    they inferred, as ``phrase``, from a count above zero.
    """
    for name, (kind, default) in DEFAULTS.items():
        fallback = F.lit(None).cast(kind) if default is None else F.expr(default).cast(kind)
        stored = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        df = df.withColumn(name, F.coalesce(stored, fallback))
    some = (F.coalesce("papers", F.lit(0)) > 0) | (F.coalesce("studies", F.lit(0)) > 0)
    inferred = F.when(some, F.array(F.lit("phrase"))).otherwise(F.array().cast("array<string>"))
    stored_hit = F.col("hit") if "hit" in df.columns else F.lit(None).cast("array<string>")
    df = df.withColumn("hit", F.coalesce(stored_hit, inferred))
    known = F.filter("hit", lambda h: h.isin("phrase", "mesh", "recall-expansion"))
    from_count = F.when(F.coalesce("studies", F.lit(0)) > 0, F.array(F.lit("phrase"))).otherwise(
        F.array().cast("array<string>")
    )
    via = F.when(F.size(known) > 0, known).otherwise(from_count)
    stored_via = F.col("matched_via") if "matched_via" in df.columns else F.lit(None).cast("array<string>")
    return df.withColumn("matched_via", F.coalesce(stored_via, via))
