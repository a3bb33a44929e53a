"""Studies, papers, designations, registry records and associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..functions import vocab
from ..functions.signals import as_array
from .xmlsplit import read_records

STUDY = """
  protocolSection struct<
    identificationModule: struct<nctId: string, briefTitle: string, officialTitle: string>,
    statusModule: struct<overallStatus: string>,
    conditionsModule: struct<conditions: array<string>>,
    designModule: struct<studyType: string>>
"""
SLIM_STUDY = """
  nctId string, briefTitle string, officialTitle string, overallStatus string, studyType string,
  phases array<string>, conditions array<string>, keywords array<string>, startDate string
"""
# One-or-many fields are kept as JSON text and widened by ``as_array``.
PAPER = "id string, source string, pmid string, title string, pubYear string, authorList struct<author: string>"
AUTHOR = """struct<fullName:string,lastName:string,firstName:string,initials:string,
  authorAffiliationDetailsList:struct<authorAffiliation:string>>"""
FDA = """
  _id string, fda_orphan_drug array<struct<generic_name: string, trade_name: string,
    designation_status: string, approval_status: string, designated_date: string,
    orphan_designation: string>>
"""
EMA = """
  data array<struct<medicine_name: string, active_substance: string, intended_use: string,
    eu_designation_number: string, date_of_designation_or_refusal: string, status: string,
    orphan_designation_url: string>>
"""


def filled(c: T.C) -> Column:
    """Trimmed text, null when blank."""
    s = T.strip(c)
    return F.when(s != "", s)


def _empty() -> Column:
    return F.array().cast("array<string>")


def flat_study(p: str = "protocolSection") -> list[Column]:
    ident = f"{p}.identificationModule"
    return [
        F.col(f"{ident}.nctId").alias("nct_id"),
        F.coalesce(filled(f"{ident}.briefTitle"), filled(f"{ident}.officialTitle"), F.lit("Untitled study")).alias("title"),
        F.coalesce(F.col(f"{p}.statusModule.overallStatus"), F.lit("UNKNOWN")).alias("status"),
        F.coalesce(F.col(f"{p}.conditionsModule.conditions"), _empty()).alias("conditions"),
        F.col(f"{p}.designModule.studyType").alias("study_type"),
    ]


def read_studies(spark: SparkSession, path: str, pages: bool = False) -> DataFrame:
    """Studies as JSON lines, or as result pages holding ``studies``."""
    if pages:
        raw = spark.read.schema(f"studies array<struct<{STUDY.strip().replace('protocolSection struct', 'protocolSection: struct', 1)}>>").json(path)
        raw = raw.select(F.explode("studies").alias("s")).select("s.*")
    else:
        raw = spark.read.schema(STUDY).json(path)
    return raw.select(*flat_study()).where(F.coalesce("nct_id", F.lit("")) != "")


def read_slim_studies(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(SLIM_STUDY).json(path)
    return raw.select(
        F.col("nctId").alias("nct_id"),
        F.coalesce("briefTitle", "officialTitle").alias("title"),
        F.col("overallStatus").alias("status"), F.col("studyType").alias("study_type"),
        *[F.coalesce(c, _empty()).alias(c) for c in ("phases", "conditions", "keywords")],
        F.col("startDate").alias("start_date"),
    ).where(F.coalesce("nct_id", F.lit("")) != "")


def read_papers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(papers, authors)`` from JSON lines; only structured authors count."""
    raw = spark.read.schema(PAPER).json(path)
    papers = raw.select(
        F.coalesce("id", "pmid").alias("paper"), "source", "pmid", "title",
        F.regexp_extract("pubYear", r"^\s*(\d+)", 1).try_cast("int").alias("year"),
        as_array("authorList.author", AUTHOR).alias("authors"),
    )
    rows = papers.select("paper", "year", F.posexplode("authors").alias("pos", "a"))
    places = F.filter(
        F.transform(
            as_array("a.authorAffiliationDetailsList.authorAffiliation", "struct<affiliation:string>"),
            lambda x: T.strip(x["affiliation"]),
        ),
        lambda x: F.coalesce(x, F.lit("")) != "",
    )
    authors = rows.select(
        "paper", "year", "pos", F.col("a.lastName").alias("last"), F.col("a.initials").alias("initials"),
        F.col("a.firstName").alias("first"), F.col("a.fullName").alias("full"),
        F.get(places, F.lit(0)).alias("affiliation"),
    )
    return papers.drop("authors"), authors


def fda_key(text: T.C) -> Column:
    return T.normalize_term(F.regexp_replace(T.col(text), r"(?i)^treatment of\s+", ""))


def ema_key(text: T.C) -> Column:
    return T.normalize_term(F.regexp_replace(T.col(text), r"(?i)^(treatment|prevention|diagnosis)\s+of\s+", ""))


def read_fda_designations(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``(ids, key, row)`` per designation; the key is null under four characters."""
    docs = spark.read.schema(FDA).option("multiLine", multi_line).json(path)
    rows = docs.select(F.explode("fda_orphan_drug").alias("d")).select("d.*")
    raw = F.ltrim("orphan_designation")
    nested = raw.startswith("{")
    field = lambda f: filled(F.array_join(as_array(F.get_json_object(raw, f"$.{f}"), "string"), " "))
    plain = lambda f: filled(F.get_json_object(raw, f"$.{f}"))
    joined = lambda f: F.when(F.get_json_object(raw, f"$.{f}").startswith("["), field(f)).otherwise(plain(f))
    text = F.coalesce(
        F.when(nested, F.coalesce(joined("parsed_text"), joined("original_text"))).otherwise(filled("orphan_designation")),
        F.lit(""),
    )
    umls = F.get_json_object(raw, "$.umls")
    ids = F.when(nested & umls.isNotNull(), F.when(umls.startswith("["), F.from_json(umls, "array<string>")).otherwise(F.array(umls)))
    ids = F.filter(F.transform(F.coalesce(ids, _empty()), T.strip), lambda i: F.coalesce(i, F.lit("")) != "")
    key = fda_key(text)
    return rows.select(
        ids.alias("ids"),
        F.when(F.length(key) >= 4, key).alias("key"),
        F.struct(
            F.coalesce(filled("generic_name"), F.lit("unknown")).alias("generic"), text.alias("text"),
            filled("designated_date").alias("date"), filled("approval_status").alias("status"),
            filled("trade_name").alias("trade"), filled("designation_status").alias("designation_status"),
        ).alias("row"),
    )


def read_ema_designations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``(key, row)`` per designation."""
    docs = spark.read.schema(EMA).option("multiLine", multi_line).json(path)
    rows = docs.select(F.explode("data").alias("d")).select("d.*")
    key = ema_key(F.coalesce(T.strip("intended_use"), F.lit("")))
    return rows.select(
        F.when(F.length(key) >= 4, key).alias("key"),
        F.struct(
            filled("eu_designation_number").alias("number"),
            F.coalesce(filled("active_substance"), filled("medicine_name"), F.lit("unknown")).alias("generic"),
            F.coalesce(filled("intended_use"), F.lit("Orphan designation")).alias("text"),
            filled("date_of_designation_or_refusal").alias("date"), filled("status").alias("status"),
            filled("medicine_name").alias("trade"), filled("orphan_designation_url").alias("url"),
        ).alias("row"),
    )


# ---- registry records --------------------------------------------------------

REGISTRY_COLUMNS = ["id", "nct_id", "secondary_ids", "title", "status", "registry", "url", "conditions", "study_type"]
CTIS = """
  ctNumber string, ctTitle string, shortTitle string, conditions string, ctStatus string,
  trialPhase string, eudraCtCode string
"""
ICTRP = ", ".join(
    f"{c} string"
    for c in (
        "trial_id", "trialID", "MainID", "public_title", "scientific_title", "url", "web_address", "condition",
        "Health_condition_or_problem_studied", "secondary_id", "secondary_ids", "SecondaryID",
        "recruitment_status", "study_type",
    )
)
ISRCTN_FULL = ", ".join(
    f"{c} string"
    for c in (
        "isrctn", "_publicIdentifierCanonical", "title", "scientificTitle", "externalRef", "secondaryIdentifiers",
        "overallStatus", "recruitmentStatus", "condition", "conditions", "primaryStudyDesign", "studyType",
    )
)


def split_conditions(c: T.C, marks: str) -> Column:
    parts = F.transform(F.split(F.coalesce(T.col(c), F.lit("")), marks), T.strip)
    return F.filter(parts, lambda p: p != "")


def _isrctn_id(raw: Column) -> Column:
    up = F.upper(raw)
    return F.when(up.startswith("ISRCTN"), up).otherwise(F.concat(F.lit("ISRCTN"), F.regexp_replace(raw, r"\D", "")))


def _registry(df: DataFrame) -> DataFrame:
    return df.where(F.col("id").isNotNull()).select(*REGISTRY_COLUMNS)


def read_ctis(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(CTIS).json(path)
    ident = filled("ctNumber")
    title = F.coalesce(filled("ctTitle"), filled("shortTitle"), ident)
    status = F.coalesce(*[F.when(F.col("ctStatus") == k, v) for k, v in vocab.CTIS_STATUS.items()], filled("ctStatus"))
    return _registry(
        raw.withColumns(
            {
                "id": ident, "nct_id": I.first_nct(ident, title, "eudraCtCode"),
                "secondary_ids": I.secondary_ids(ident, "eudraCtCode", title), "title": title, "status": status,
                "registry": F.lit("ctis"),
                "url": F.concat(F.lit("https://euclinicaltrials.eu/search-for-clinical-trials/?lang=en&EUCT="), F.url_encode(ident)),
                "conditions": split_conditions("conditions", "[;,]"),
                "study_type": F.coalesce(F.concat(F.lit("CTIS "), filled("trialPhase")), F.lit("INTERVENTIONAL")),
            }
        )
    )


def read_ictrp(spark: SparkSession, path: str) -> DataFrame:
    raw = read_records(spark, path, "trial", ICTRP)
    trial = F.coalesce(filled("trial_id"), filled("trialID"), filled("MainID"))
    title = F.coalesce(filled("public_title"), filled("scientific_title"))
    ident = F.coalesce(trial, F.concat(F.lit("ictrp-"), F.substring(F.sha1(title), 1, 12)))
    url = F.coalesce(
        filled("url"), filled("web_address"),
        F.concat(F.lit("https://trialsearch.who.int/Trial2.aspx?TrialID="), F.url_encode(ident)),
    )
    second = F.coalesce(filled("secondary_id"), filled("SecondaryID"), filled("secondary_ids"))
    kind = I.infer_registry(ident)
    return _registry(
        raw.withColumns(
            {
                "id": ident, "nct_id": I.first_nct(ident, url, second, title),
                "secondary_ids": I.secondary_ids(ident, second, url), "title": F.coalesce(title, ident),
                "status": filled("recruitment_status"), "registry": F.when(kind == "other", "ictrp").otherwise(kind),
                "url": url,
                "conditions": split_conditions(
                    F.coalesce(filled("condition"), filled("Health_condition_or_problem_studied")), "[;|]"
                ),
                "study_type": filled("study_type"),
            }
        )
    )


def read_isrctn(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    """Exchange format, or the registry's own with ``full``."""
    if not full:
        raw = read_records(spark, path, "trial", ICTRP)
        trial = filled("trial_id")
        url = F.coalesce(filled("url"), F.concat(F.lit("https://www.isrctn.com/"), trial))
        title = F.coalesce(filled("public_title"), filled("scientific_title"), trial)
        cols = {
            "id": _isrctn_id(trial), "nct_id": I.first_nct(trial, "secondary_id", url, title),
            "secondary_ids": I.secondary_ids(trial, "secondary_id", url), "title": title,
            "status": filled("recruitment_status"), "url": url, "conditions": split_conditions("condition", "[;|]"),
            "study_type": filled("study_type"),
        }
    else:
        raw = read_records(spark, path, "fullTrial", ISRCTN_FULL)
        trial = F.coalesce(filled("isrctn"), filled("_publicIdentifierCanonical"))
        ident = _isrctn_id(trial)
        title = F.coalesce(filled("title"), filled("scientificTitle"), ident)
        second = F.concat_ws(" ", filled("externalRef"), filled("secondaryIdentifiers"))
        cols = {
            "id": ident, "nct_id": I.first_nct(ident, second, title), "secondary_ids": I.secondary_ids(ident, second),
            "title": title, "status": F.coalesce(filled("overallStatus"), filled("recruitmentStatus")),
            "url": F.concat(F.lit("https://www.isrctn.com/"), ident),
            "conditions": split_conditions(F.coalesce(filled("condition"), filled("conditions")), "[;|]"),
            "study_type": F.coalesce(filled("primaryStudyDesign"), filled("studyType")),
        }
    return _registry(raw.withColumns({**cols, "registry": F.lit("isrctn")}))


def read_registry_trials(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One schema for all registries: ``ctis``, ``ictrp``, ``isrctn``, ``isrctn-full``."""
    if kind == "ctis":
        return read_ctis(spark, path)
    if kind == "ictrp":
        return read_ictrp(spark, path)
    if kind in ("isrctn", "isrctn-full"):
        return read_isrctn(spark, path, kind == "isrctn-full")
    raise ValueError(f"unknown registry kind {kind}")


# ---- associations ------------------------------------------------------------

ASSOCIATION = """
  subject string, subject_label string, subject_taxon_label string, object string,
  object_label string, predicate string, category string
"""
ANNOTATION = """
  _id string, notfound boolean,
  ctd struct<chemical_related_to_disease: string, pathway_related_to_disease: string>, hpo string
"""
DRUG_ROW = "id string, maxClinicalStage string, drug struct<id: string, name: string>"
CHEMICAL = "struct<chemical_name:string,direct_evidence:string,mesh_chemical_id:string,pubmed:string>"
PATHWAY = "struct<pathway_name:string>"
PHENOTYPE_BLOCK = "struct<phenotype_related_to_disease:string>"
PHENOTYPE = "struct<hpo_id:string,hpo_name:string,numeric_freq:double>"


def read_associations(spark: SparkSession, path: str) -> DataFrame:
    """Association items as JSON lines: node ids on either side are normalised."""
    raw = spark.read.schema(ASSOCIATION).json(path)
    return raw.withColumns({"subject": I.normalize_curie("subject"), "object": I.normalize_curie("object")})


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(chemicals, pathways, phenotypes)`` by node from annotation documents."""
    raw = spark.read.schema(ANNOTATION).json(path).where(~F.coalesce("notfound", F.lit(False)))
    node = I.normalize_curie("_id").alias("node")
    chem = raw.select(node, F.explode(as_array("ctd.chemical_related_to_disease", CHEMICAL)).alias("c")).select(
        "node", F.col("c.chemical_name").alias("name"), F.col("c.direct_evidence").alias("evidence"),
        F.col("c.mesh_chemical_id").alias("mesh_id"), F.col("c.pubmed").alias("pubmed"),
    )
    path_rows = raw.select(node, F.posexplode(as_array("ctd.pathway_related_to_disease", PATHWAY)).alias("rank", "p")).select(
        "node", F.col("p.pathway_name").alias("name"), "rank"
    )
    blocks = raw.select(node, F.explode(as_array("hpo", PHENOTYPE_BLOCK)).alias("b"))
    pheno = blocks.select("node", F.explode(as_array("b.phenotype_related_to_disease", PHENOTYPE)).alias("p")).select(
        "node", F.col("p.hpo_id").alias("id"), F.col("p.hpo_name").alias("name"), F.col("p.numeric_freq").alias("freq")
    )
    return chem, path_rows, pheno


def read_drugs(spark: SparkSession, path: str) -> DataFrame:
    """Drug responses as JSON lines: one document per node."""
    schema = f"node string, count bigint, rows array<struct<{DRUG_ROW.replace('id string', 'id: string', 1).replace('maxClinicalStage string', 'maxClinicalStage: string').replace('drug struct', 'drug: struct')}>>"
    raw = spark.read.schema(schema).json(path)
    return raw.select(I.normalize_curie("node").alias("node"), F.col("count").alias("source_count"), F.explode("rows").alias("r")).select(
        "node", F.col("r.drug.id").alias("drug"), F.col("r.drug.name").alias("name"),
        F.col("r.maxClinicalStage").alias("stage"), "source_count",
    )
