"""Catalogue and prevalence XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from .xmlsplit import read_records

CATALOGUE = """
  OrphaCode string, Name string, ExpertLink string,
  SynonymList struct<Synonym: array<string>>,
  ExternalReferenceList struct<ExternalReference: array<struct<Source: string, Reference: string>>>,
  SummaryInformationList struct<SummaryInformation: array<struct<
    TextSectionList: struct<TextSection: array<struct<
      TextSectionType: struct<Name: string>, Contents: string>>>>>>,
  DisorderGroup struct<Name: string>, DisorderType struct<Name: string>
"""
PREVALENCE = """
  OrphaCode string,
  PrevalenceList struct<Prevalence: array<struct<
    PrevalenceType: struct<Name: string>, PrevalenceGeographic: struct<Name: string>,
    PrevalenceClass: struct<Name: string>>>>
"""
# Prefixes of names that leave the corpus.
RETIRED_PREFIXES = ["OBSOLETE:", "NON RARE IN EUROPE:"]
GROUP_LEVEL = "Group of disorders"


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail early when a source has no readable rows."""
    if df.isEmpty():
        raise ValueError(f"{what}: root or list is missing or empty; the file's shape has changed")
    return df


def pick_definition(sections: T.C) -> Column:
    """Last non-empty text of type Definition, tags and entities removed."""
    texts = F.filter(T.col(sections), lambda s: (s["type"] == "Definition") & (F.coalesce(s["contents"], F.lit("")) != ""))
    raw = F.get(F.transform(texts, lambda s: s["contents"]), F.size(texts) - 1)
    bare = F.regexp_replace(raw, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return T.strip(bare)


def catalogue_xrefs(refs: T.C, source: str = "MONDO") -> Column:
    """References of one source, as padded ids."""
    mine = F.filter(T.col(refs), lambda r: (r["source"] == source) & (F.coalesce(r["reference"], F.lit("")) != ""))
    return F.transform(
        mine,
        lambda r: F.when(r["reference"].startswith(f"{source}:"), r["reference"]).otherwise(
            F.concat(F.lit(f"{source}:"), F.lpad(r["reference"], F.greatest(F.length(r["reference"]), F.lit(7)), "0"))
        ),
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per catalogue entry; entries without code or name are dropped."""
    raw = read_records(spark, path, "Disorder", CATALOGUE)
    require_rows(raw, "catalogue")
    empty_s = F.array().cast("array<string>")
    sections = F.flatten(
        F.transform(
            F.coalesce("SummaryInformationList.SummaryInformation", F.array()),
            lambda s: F.transform(
                F.coalesce(s["TextSectionList"]["TextSection"], F.array()),
                lambda t: F.struct(t["TextSectionType"]["Name"].alias("type"), t["Contents"].alias("contents")),
            ),
        )
    )
    refs = F.transform(
        F.coalesce("ExternalReferenceList.ExternalReference", F.array()),
        lambda r: F.struct(r["Source"].alias("source"), r["Reference"].alias("reference")),
    )
    link = F.coalesce("ExpertLink", F.concat(F.lit("https://www.orpha.net/en/disease/detail/"), "OrphaCode"))
    synonyms = F.filter(
        F.coalesce("SynonymList.Synonym", empty_s), lambda s: F.coalesce(T.strip(s), F.lit("")) != ""
    )
    flat = raw.select(
        T.strip("OrphaCode").alias("code"),
        T.strip("Name").alias("name"),
        F.transform(synonyms, T.strip).alias("synonyms"),
        sections.alias("sections"),
        refs.alias("refs"),
        F.regexp_replace(link, "^http:", "https:").alias("link"),
        F.col("DisorderGroup.Name").alias("group"),
        F.col("DisorderType.Name").alias("type"),
    ).where((F.coalesce("code", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
    return flat.select(
        "code", "name", "synonyms", pick_definition("sections").alias("definition"),
        catalogue_xrefs("refs").alias("node_ids"), "link", "group", "type",
    )


def pick_prevalence(items: T.C) -> Column:
    """Worldwide point prevalence if there is one, else the first with a class."""
    named = F.filter(
        F.transform(
            T.col(items),
            lambda p: F.struct(
                p["type"].alias("type"), p["geo"].alias("geo"),
                T.strip(F.regexp_replace(p["cls"], "(?i)</?i>", "")).alias("cls"),
            ),
        ),
        lambda p: F.coalesce(p["cls"], F.lit("")) != "",
    )
    best = F.filter(named, lambda p: (p["type"] == "Point prevalence") & (p["geo"] == "Worldwide"))
    return F.coalesce(F.get(best, F.lit(0))["cls"], F.get(named, F.lit(0))["cls"])


def read_prevalence(spark: SparkSession, path: str) -> DataFrame:
    raw = read_records(spark, path, "Disorder", PREVALENCE)
    require_rows(raw, "prevalence")
    items = F.transform(
        F.coalesce("PrevalenceList.Prevalence", F.array()),
        lambda p: F.struct(
            p["PrevalenceType"]["Name"].alias("type"), p["PrevalenceGeographic"]["Name"].alias("geo"),
            p["PrevalenceClass"]["Name"].alias("cls"),
        ),
    )
    return raw.select(T.strip("OrphaCode").alias("code"), pick_prevalence(items).alias("prevalence_class")).where(
        F.col("code").isNotNull() & F.col("prevalence_class").isNotNull()
    )


def retired(name: T.C) -> Column:
    return T.any_of([T.col(name).startswith(p) for p in RETIRED_PREFIXES])


def usable_entities(catalogue: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(usable, excluded count, code to node table)``.

    Groups leave first, then retired names; the code table keeps every entry.
    """
    rows = catalogue.where(F.coalesce(F.col("group") != GROUP_LEVEL, F.lit(True)))
    excluded = rows.agg(F.count_if(retired("name")).alias("excluded"))
    nodes = catalogue.select("code", F.posexplode("node_ids").alias("pos", "raw")).select(
        "code", "pos", I.normalize_curie("raw").alias("node")
    )
    return rows.where(~retired("name")), excluded, nodes
