"""Audit rules, guards and invariants over derived entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..runtime import side_by_side
from .confidence import failed

# Audit thresholds.
CONTAMINATION_SHARE = 0.02
SHARE_TOLERANCE = 0.0005
# Reviewer names that are no person; a caller adds the names of its own tools.
MACHINE_REVIEWERS = "(?i)model|consensus"


def _recall(terms: str = "recall_terms") -> Column:
    return F.coalesce(F.col(terms), F.array().cast("array<string>"))


def non_gene_terms() -> Column:
    return F.filter(_recall(), lambda t: ~t.rlike(vocab.GENE_SYMBOL))


def frequent_gene_terms() -> Column:
    return F.filter(_recall(), lambda t: F.upper(t).isin(vocab.FREQUENT_GENES))


def counted_for_studies() -> Column:
    """The audit's own gate: it recounts without the derivation's columns."""
    return (F.col("health") != "broken") & ~failed("studies_error") & F.col("studies").isNotNull()


def row_issues(df: DataFrame) -> DataFrame:
    """``(level, issue, code, detail)``, one row per broken row rule.

    All rules are one array per row, so the corpus is read once.
    """
    scaffold = "(?i)disease or disorder"
    damaged = T.has_encoding_damage("name")
    has_corrected = F.coalesce(F.col("name_corrected") != "", F.lit(False))
    diverges = F.coalesce(F.col("query"), F.lit("")).rlike(scaffold) != F.coalesce(
        F.col("study_query"), F.lit("")
    ).rlike(scaffold)
    sources = F.coalesce(F.col("secondary_errors"), F.array().cast("array<string>"))
    all_failed = (
        F.array_contains(sources, "ctis")
        & F.array_contains(sources, "isrctn")
        & (F.coalesce("secondary_fetched", F.lit(0)) == 0)
    )
    trials_exceed = F.coalesce((F.col("studies") > F.col("papers")) & (F.col("studies") > 0), F.lit(False))
    no_parent = (
        F.coalesce(F.col("studies") == 0, F.lit(False))
        & F.col("parent_studies").isNull()
        & (F.coalesce(F.size("node_ids"), F.lit(0)) > 0)
    )
    rules = [
        ("ASSERT", "confidence-contradicts-queryhealth",
         (F.col("health") == "broken") & (F.col("confidence") != "low"), F.col("confidence")),
        ("ASSERT", "label-encoding-corrupt", damaged & ~has_corrected, F.col("name")),
        ("WARN", "label-encoding-corrupt", damaged & has_corrected, F.col("name_corrected")),
        ("ASSERT", "credible-record-null-total",
         F.coalesce(F.col("in_studies_denominator"), F.lit(False)) & F.col("studies").isNull(), F.lit("no number")),
        ("WARN", "high-frequency-oncogene-in-trial-query",
         F.size(frequent_gene_terms()) > 0, F.array_join(frequent_gene_terms(), ", ")),
        ("WARN", "ontology-speak-divergence", diverges, F.lit("query filters differ")),
        ("WARN", "trials-exceed-publications", trials_exceed,
         F.concat_ws(" vs ", F.col("studies").cast("string"), F.col("papers").cast("string"))),
        ("WARN", "no-parent-tier-despite-mondo-ancestry", no_parent, F.lit("zero studies, no parent tier")),
        ("WARN", "secondary-registries-all-sources-failed", all_failed, F.array_join(sources, ", ")),
    ]
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    test,
                    F.struct(
                        F.lit(level).alias("level"), F.lit(issue).alias("issue"),
                        F.coalesce(detail.cast("string"), F.lit("")).alias("detail"),
                    ),
                )
                for level, issue, test, detail in rules
            ]
        )
    )
    return df.select("code", F.explode(hits).alias("i")).select("i.level", "i.issue", "code", "i.detail")


def audit_counts(df: DataFrame) -> DataFrame:
    """The audit's recount, one row."""
    gate = counted_for_studies()
    dirty = F.size(non_gene_terms()) > 0
    clean = gate & ~dirty & (F.size(frequent_gene_terms()) == 0)
    some = gate & F.coalesce(F.col("studies") > 0, F.lit(False))
    none = F.coalesce(F.col("studies") == 0, F.lit(False))
    return df.agg(
        F.count("*").alias("entities"),
        F.count_if(gate).alias("counted"),
        F.count_if(gate & none).alias("counted_zero"),
        F.count_if(some).alias("with_studies"),
        F.count_if(some & dirty).alias("contaminated"),
        F.count_if(clean).alias("clean"),
        F.count_if(clean & none).alias("clean_zero"),
    )


def corpus_issues(counts: DataFrame, aggregate: DataFrame, validation: DataFrame | None = None, machine_reviewers: str = MACHINE_REVIEWERS) -> DataFrame:
    """Corpus rules from two one-row frames side by side.

    ``aggregate``: ``studies_denominator, no_studies, share_zero``.
    ``validation``: ``method, reviewed_by``.
    """
    frames = [counts, aggregate] + ([validation] if validation is not None else [])
    row = side_by_side(*frames)
    share = F.col("contaminated") / F.when(F.col("with_studies") > 0, F.col("with_studies"))
    implied = F.col("no_studies") / F.when(F.col("studies_denominator") > 0, F.col("studies_denominator"))
    rules = [
        ("ASSERT", "denominator-mismatch", F.col("studies_denominator") != F.col("counted")),
        ("ASSERT", "notrials-mismatch", F.col("no_studies") != F.col("counted_zero")),
        ("ASSERT", "share-does-not-match-counts", F.abs(implied - F.col("share_zero")) > SHARE_TOLERANCE),
        ("WARN", "parent-term-contamination", share > CONTAMINATION_SHARE),
    ]
    if validation is not None:
        rules.append(
            ("ASSERT", "validation-method-mislabelled",
             F.col("method").rlike("(?i)human") & F.col("reviewed_by").rlike(machine_reviewers))
        )
    hits = F.array_compact(
        F.array(*[
            F.when(test, F.struct(F.lit(level).alias("level"), F.lit(issue).alias("issue")))
            for level, issue, test in rules
        ])
    )
    return row.select(F.explode(hits).alias("i")).select(
        "i.level", "i.issue", F.lit(None).cast("string").alias("code"), F.lit("").alias("detail")
    )


def audit_issues(
    df: DataFrame, aggregate: DataFrame, validation: DataFrame | None = None, machine_reviewers: str = MACHINE_REVIEWERS,
) -> DataFrame:
    return row_issues(df).unionByName(corpus_issues(audit_counts(df), aggregate, validation, machine_reviewers))


def audit_summary(issues: DataFrame) -> DataFrame:
    """Issues per code and level, most first."""
    return (
        issues.groupBy("level", "issue").agg(F.count("*").alias("n"))
        .orderBy("level", F.col("n").desc(), "issue")
    )


def clean_subset_share(counts: DataFrame) -> DataFrame:
    """Published share of zeros beside the share on the verified-clean subset."""
    def share(n: str, d: str) -> Column:
        return F.when(F.col(d) > 0, F.floor(F.col(n) / F.col(d) * 10000 + 0.5) / 10000.0)

    return counts.select(
        share("counted_zero", "counted").alias("published"), share("clean_zero", "clean").alias("clean_subset")
    )


def refresh_guards(before: DataFrame, after: DataFrame, nightly: bool = True, accuracy_batch: bool = False) -> DataFrame:
    """``(guard, ok)``: rows may not fall; a nightly zero count may move 5 or 15%.

    Both frames are one row: ``rows, no_studies, sources``.
    """
    limit = 0.15 if accuracy_batch else 0.05
    row = side_by_side(
        before.select(F.col("rows").alias("r0"), F.col("no_studies").alias("z0"), F.col("sources").alias("s0")),
        after.select(F.col("rows").alias("r1"), F.col("no_studies").alias("z1"), F.col("sources").alias("s1")),
    )
    moved = F.abs(F.col("z1") - F.col("z0")) / F.when(F.col("z0") > 0, F.col("z0"))
    guards = [("row-count", F.col("r1") >= F.col("r0"))]
    if nightly:
        guards += [
            ("sources-unchanged", F.col("s0").eqNullSafe(F.col("s1"))),
            ("zero-count-drift", F.coalesce(moved <= limit, F.lit(True))),
        ]
    rows = F.array(*[F.struct(F.lit(g).alias("guard"), ok.alias("ok")) for g, ok in guards])
    return row.select(F.explode(rows).alias("g")).select("g.guard", "g.ok")


def aggregate_invariants(aggregate: DataFrame) -> DataFrame:
    """``(rule, ok)`` over the one-row headline counters.

    ``usable``, ``after_groups``, ``disorder_level`` and ``catalogue_rows`` are
    checked where present.
    """
    c = F.col
    counts = [
        "no_studies", "no_studies_inclusive", "no_registered", "studies_denominator",
        "no_recent_papers", "papers_denominator",
    ]
    rules = [
        ("present", reduce(lambda a, b: a & b, [c(n).isNotNull() & (c(n) >= 0) for n in counts])),
        ("zero-within-studies", c("no_studies") <= c("studies_denominator")),
        ("inclusive-within-specific", c("no_studies_inclusive") <= c("no_studies")),
        ("registered-within-specific",
         (c("no_registered") <= c("no_studies")) & (c("no_registered") <= c("studies_denominator"))),
        ("zero-within-papers", c("no_recent_papers") <= c("papers_denominator")),
    ]
    if {"usable", "after_groups"} <= set(aggregate.columns):
        rules.append(("usable-within-levels", c("usable") <= c("after_groups")))
    if {"disorder_level", "catalogue_rows"} <= set(aggregate.columns):
        rules.append(("level-within-catalogue", c("disorder_level") <= c("catalogue_rows")))
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(ok, F.lit(False)).alias("ok")) for r, ok in rules])
    return aggregate.select(F.explode(rows).alias("g")).select("g.rule", "g.ok")
