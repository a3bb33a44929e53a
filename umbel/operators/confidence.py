"""Query health, confidence and credibility of each entity's counts.

Columns read: ``code, name, name_corrected, synonyms, definition, node_ids,
prevalence_class, gene_class, papers, recent, studies, registered,
fully_scanned, papers_error, studies_error, tried, hit, probe_label,
probe_hits``. A null count means not measured and never equals zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab

SUBSTANTIAL = 50


def failed(error: str) -> Column:
    return F.col(error).isNotNull() & (F.col(error) != "")


def zero(count: str) -> Column:
    """Measured and zero."""
    return F.coalesce(F.col(count) == 0, F.lit(False))


def query_health(df: DataFrame) -> DataFrame:
    """Adds ``health`` (broken, suspect, ok), ``health_reasons``, ``tried``."""
    corrected = F.col("name_corrected").isNotNull() & (F.col("name_corrected") != "")
    tried = F.array_distinct(
        F.concat(
            F.coalesce("tried", F.array(F.lit("phrase"))),
            F.when(corrected, F.array(F.lit("corrected-name"))).otherwise(F.array().cast("array<string>")),
        )
    )
    hit = F.array_distinct(F.coalesce("hit", F.array().cast("array<string>")))
    no_fetch = failed("papers_error") | failed("studies_error")
    broken = ~no_fetch & zero("papers") & zero("registered")
    single = (F.size(tried) >= 2) & (F.size(hit) == 1)
    suspect = corrected | single | no_fetch
    reasons = F.when(broken, F.array(F.lit("every strategy returned zero in both sources"))).otherwise(
        F.array_compact(
            F.array(
                F.when(corrected, "label was corrected"),
                F.when(single, "only one strategy returned hits"),
                F.when(no_fetch, "a source could not be read"),
                F.when(~suspect, "a name or identifier strategy returned hits"),
            )
        )
    )
    return (
        df.withColumn("tried", tried)
        .withColumn("health", F.when(broken, "broken").when(suspect, "suspect").otherwise("ok"))
        .withColumn("health_reasons", reasons)
    )


def entity_terms(df: DataFrame, code: str = "code") -> DataFrame:
    """Distinct lower-case names of each entity."""
    names = F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    return (
        df.select(code, F.explode(names).alias("raw"))
        .select(code, F.lower(T.strip("raw")).alias("key"))
        .where("key != ''")
        .distinct()
    )


def name_owners(df: DataFrame, code: str = "code", shown: int = 3) -> DataFrame:
    """``(key, owners, first_owners)`` for names with more than one owner.

    Owners are counted and the first ``shown + 1`` kept per name, so a name
    owned by very many entities is one short row and no pair is ever built.
    """
    terms = entity_terms(df, code)
    counts = terms.groupBy("key").agg(F.count("*").alias("owners")).where("owners > 1")
    w = W.partitionBy("key").orderBy(F.col(code).cast("long"), code)
    first = (
        terms.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= shown + 1)
        .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_rn", code)))[code].alias("first_owners"))
    )
    return counts.join(first, "key")


def name_collisions(df: DataFrame, code: str = "code", shown: int = 3) -> DataFrame:
    """Query terms of an entity that other entities own too.

    ``(code, key, others, shown_owners)``: how many others, the first three.
    """
    names = F.coalesce("synonyms", F.array().cast("array<string>"))
    mine = (
        df.select(code, F.explode(T.kept_terms("name", names)["kept"]).alias("term"))
        .select(code, F.lower(T.strip("term")).alias("key")).distinct()
    )
    return mine.join(name_owners(df, code, shown), "key").select(
        code,
        "key",
        (F.col("owners") - 1).alias("others"),
        F.slice(F.array_remove("first_owners", F.col(code)), 1, shown).alias("shown_owners"),
    )


def is_distinctive(name: T.C) -> Column:
    words = F.filter(
        F.split(F.lower(T.col(name)), r"[\s\-/,]+"),
        lambda w: (w != "") & ~w.isin(vocab.LABEL_STOPWORDS),
    )
    return (F.size(words) >= 2) & (F.length(T.col(name)) >= 12)


def confidence_base(df: DataFrame, code: str = "code") -> DataFrame:
    """Adds ``base_score`` and ``base_confidence`` from the names alone."""
    collisions = name_collisions(df, code).groupBy(code).agg(F.count("*").alias("collisions"))
    names = F.coalesce("synonyms", F.array().cast("array<string>"))
    dropped = F.size(T.kept_terms("name", names)["dropped"])
    joined = df.withColumn("dropped_terms", dropped).join(collisions, code, "left")
    joined = joined.withColumn("collisions", F.coalesce("collisions", F.lit(0)))
    score = (
        F.lit(2)
        + F.when(is_distinctive("name"), 1).otherwise(-1)
        - F.when(F.col("dropped_terms") > 0, 1).otherwise(0)
        - F.when(F.col("collisions") >= 2, 2).when(F.col("collisions") == 1, 1).otherwise(0)
    )
    return joined.withColumn("base_score", score).withColumn(
        "base_confidence",
        F.when(F.col("base_score") >= 3, "high").when(F.col("base_score") >= 1, "medium").otherwise("low"),
    )


def is_ultra_rare(prevalence: T.C) -> Column:
    p = F.lower(F.regexp_replace(T.col(prevalence), r"\s+", " "))
    return F.coalesce(
        T.any_of([p.contains(x) for x in ("<1 / 1 000 000", "<1/1000000", "<1 / 1000000")]), F.lit(False)
    )


def confidence_rules(df: DataFrame) -> DataFrame:
    """Adds ``confidence`` and ``excluded``; rules apply in this order."""
    strong = F.col("gene_class").isin("Definitive", "Strong")
    contradiction = F.coalesce(zero("papers") & strong, F.lit(False))
    scaffold = (F.coalesce("definition", F.lit("")) == "") & (
        F.coalesce(F.size("node_ids"), F.lit(0)) <= 0
    )
    rare = is_ultra_rare("prevalence_class")
    unknown = ~rare & F.coalesce(
        (F.col("prevalence_class") == "") | F.col("prevalence_class").rlike("(?i)unknown"), F.lit(True)
    )
    papers = F.coalesce("papers", F.lit(-1))
    loose = F.coalesce(
        (F.col("studies") > 10) & (F.col("papers") < 50) & (F.col("studies") > F.col("papers") * 2),
        F.lit(False),
    )
    far = loose & (F.col("studies") > F.col("papers") * 5)
    c = F.col("confidence")
    df = df.withColumn("confidence", F.when(contradiction, "low").otherwise(F.col("base_confidence")))
    df = df.withColumn("excluded", contradiction)
    df = df.withColumn("confidence", F.when(scaffold, "low").otherwise(c))
    df = df.withColumn(
        "confidence",
        F.when(rare & (papers >= 500), "low")
        .when(rare & (papers >= 200) & (c == "high"), "medium")
        .when(unknown & (papers >= 1000), "low")
        .otherwise(c),
    )
    return df.withColumn(
        "confidence", F.when(far, "low").when(loose & (c == "high"), "medium").otherwise(c)
    )


def confidence_final(df: DataFrame) -> DataFrame:
    """Last adjustments, in order: failed fetch, parent probe, broken, mojibake."""
    undone = failed("papers_error") & F.col("excluded")
    probe = (
        ~F.col("excluded")
        & zero("papers")
        & ~failed("papers_error")
        & F.coalesce(F.col("probe_hits") >= SUBSTANTIAL, F.lit(False))
    )
    c = F.col("confidence")
    df = df.withColumn("confidence", F.when(undone, F.col("base_confidence")).otherwise(c)).withColumn(
        "excluded", F.col("excluded") & ~undone
    )
    df = df.withColumn("_probe", probe)
    low = F.col("_probe") | (F.col("health") == "broken") | T.has_encoding_damage("name")
    return (
        df.withColumn("confidence", F.when(low, "low").otherwise(c))
        .withColumn("excluded", F.col("excluded") | F.col("_probe"))
        .drop("_probe")
    )


def credible(metric: str) -> Column:
    """Gate of one metric; a paper-side flag never touches the study gate."""
    sound = F.col("health") != "broken"
    if metric == "papers":
        return sound & ~F.col("excluded") & (F.col("confidence") != "low") & ~failed("papers_error")
    return sound & ~failed("studies_error") & F.coalesce("fully_scanned", F.lit(True))


def derive(df: DataFrame, code: str = "code") -> DataFrame:
    """Health, confidence and exclusion in one lineage."""
    return confidence_final(confidence_rules(confidence_base(query_health(df), code)))


def contaminated(terms: str = "recall_terms") -> Column:
    """Trusted rows with studies whose recall terms are more than gene symbols."""
    listed = F.coalesce(F.col(terms), F.array().cast("array<string>"))
    suspicious = F.exists(
        listed, lambda t: ~t.rlike(vocab.GENE_SYMBOL) | F.upper(t).isin(vocab.FREQUENT_GENES)
    )
    return (
        (F.col("health") != "broken")
        & ~failed("studies_error")
        & F.coalesce(F.col("studies") > 0, F.lit(False))
        & suspicious
    )


def age_flags(df: DataFrame, verified: str, as_of: T.C, warn: int = 183, fail: int = 365, stale: int = 30) -> DataFrame:
    """Age in days and its flags; null when never verified."""
    age = F.datediff(T.col(as_of), F.col(verified))
    return (
        df.withColumn("age_days", age)
        .withColumn("warn", F.coalesce(age > warn, F.lit(False)))
        .withColumn("fail", F.coalesce(age > fail, F.lit(False)))
        .withColumn("recheck", F.coalesce(age > stale, F.lit(True)))
    )
