"""Votes, consensus, review gates and accuracy against labels.

Verdicts are the strings true, false, uncertain, relevant-to-parent-category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..runtime import side_by_side
from .match import phrase_match, study_texts

# Verdicts a vote may give.
VERDICTS = ["true", "false", "uncertain", "relevant-to-parent-category"]
PARENT = "relevant-to-parent-category"
# Review sizes.
MAX_CANDIDATES = 220
CHECKS = 10
CHECKS_NEEDED = 8


def vote_validity(votes: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``verdict``, ``reason`` and ``valid`` parsed from a vote's JSON text.

    A code fence around the JSON is removed; the verdict must be one of the
    four, the reason 1 to 500 characters.
    """
    body = F.regexp_replace(F.regexp_replace(T.strip(raw), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    verdict = F.get_json_object(body, "$.relevant")
    reason = T.strip(F.get_json_object(body, "$.reason"))
    ok = F.coalesce(verdict.isin(VERDICTS) & F.length(reason).between(1, 500), F.lit(False))
    return votes.withColumns({"verdict": verdict, "reason": reason, "valid": ok})


def ballots(votes: DataFrame, keys: list[str], voters: tuple[str, str]) -> DataFrame:
    """One row per candidate with both verdicts; no valid vote is uncertain."""
    wide = votes.groupBy(*keys).pivot("voter", list(voters)).agg(
        F.max(F.when(F.col("valid"), F.col("verdict")))
    )
    a, b = voters
    return wide.select(
        *keys,
        F.coalesce(F.col(a), F.lit("uncertain")).alias("first"),
        F.coalesce(F.col(b), F.lit("uncertain")).alias("second"),
    )


def consensus(first: T.C = "first", second: T.C = "second") -> Column:
    a, b = T.col(first), T.col(second)
    return (
        F.when((a == "true") & (b == "true"), "relevant")
        .when((a == "false") & (b == "false"), "irrelevant")
        .when((a == PARENT) & (b == PARENT), "parent-category")
        .otherwise("uncertain")
    )


def consensus_reason(first: T.C = "first", second: T.C = "second") -> Column:
    a, b = T.col(first), T.col(second)
    unsure = a.isin("uncertain", PARENT) | b.isin("uncertain", PARENT)
    return F.when(a == b, F.when(a == "uncertain", "unsure").otherwise("agreed")).when(unsure, "unsure").otherwise(
        "disagreed"
    )


def consensus_with_hint(hint: T.C, first: T.C = "first", second: T.C = "second") -> Column:
    """As ``consensus``; a parent hint settles uncertain when nobody said false."""
    base, a, b = consensus(first, second), T.col(first), T.col(second)
    soft = (a != "false") & (b != "false") & (a.isin(PARENT, "uncertain") | b.isin(PARENT, "uncertain"))
    return F.when((base == "uncertain") & T.col(hint) & soft, "parent-category").otherwise(base)


def parent_hint(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``hint``: a condition contains the parent label, a name parent.

    ``candidates``: ``entity, doc, conditions``; ``entities``: ``entity, name,
    parent_label``.
    """
    joined = candidates.join(entities.select("entity", "name", "parent_label"), "entity", "left")
    needle = T.normalize_term("parent_label")
    hit = T.is_name_parent("name", "parent_label") & F.exists(
        F.coalesce("conditions", F.array().cast("array<string>")),
        lambda c: T.phrase_present(T.normalize_term(c), needle),
    )
    return joined.withColumn("hint", F.coalesce(hit, F.lit(False))).drop("name", "parent_label")


def entity_accuracy(labels: DataFrame, found: DataFrame, keys: tuple[str, str] = ("entity", "doc")) -> DataFrame:
    """Recall, precision and coverage per entity; null where undefined.

    ``labels``: ``entity, doc, difficulty, consensus``; ``found``: ``entity, doc``.
    """
    entity, doc = keys
    hit = found.select(entity, doc).distinct().withColumn("_found", F.lit(True))
    rows = labels.join(hit, [entity, doc], "left").withColumn("_found", F.coalesce("_found", F.lit(False)))
    rel, irr = F.col("consensus") == "relevant", F.col("consensus") == "irrelevant"
    counts = rows.groupBy(entity).agg(
        F.max("difficulty").alias("difficulty"),
        F.count("*").alias("candidates"),
        F.count_if(rel).alias("relevant"),
        F.count_if(irr).alias("irrelevant"),
        F.count_if(F.col("consensus").isin("uncertain", "parent-category")).alias("uncertain"),
        F.count_if(rel & F.col("_found")).alias("found_relevant"),
        F.count_if(irr & F.col("_found")).alias("found_irrelevant"),
    )
    judged = F.col("found_relevant") + F.col("found_irrelevant")
    return counts.withColumns(
        {
            "recall": F.when(F.col("relevant") > 0, F.col("found_relevant") / F.col("relevant")),
            "precision": F.when(judged > 0, F.col("found_relevant") / judged),
            "coverage": (F.col("relevant") + F.col("irrelevant")) / F.col("candidates"),
        }
    )


def accuracy(per_entity: DataFrame) -> DataFrame:
    """Macro means per difficulty and overall (difficulty ``all``).

    Null scores are left out; an empty mean is 1. Overall coverage pools the
    candidates, per-difficulty coverage averages entities.
    """
    one = F.lit(1.0)
    means = [
        F.count("*").alias("entities"),
        F.coalesce(F.avg("recall"), one).alias("recall"),
        F.coalesce(F.avg("precision"), one).alias("precision"),
    ]
    by = per_entity.groupBy("difficulty").agg(*means, F.coalesce(F.avg("coverage"), one).alias("coverage"))
    settled = F.sum(F.col("relevant") + F.col("irrelevant"))
    pooled = settled / F.sum(F.col("relevant") + F.col("irrelevant") + F.col("uncertain"))
    overall = per_entity.agg(*means, F.coalesce(pooled, one).alias("coverage")).withColumn(
        "difficulty", F.lit("all")
    )
    return by.unionByName(overall)


def regressions(current: DataFrame, baseline: DataFrame, entity: str = "entity", found: str = "found") -> DataFrame:
    """Entities whose found count fell below the baseline."""
    old = baseline.select(entity, F.col(found).alias("baseline"))
    return current.select(entity, found).join(old, entity).where(F.col(found) < F.col("baseline"))


def baseline_check(current: DataFrame, baseline: DataFrame, eps: float = 0.02) -> DataFrame:
    """``(comparable, regressed, advance)`` from two one-row summaries.

    Both hold ``version, recall``. Unlike versions are not compared.
    """
    row = side_by_side(
        current.select(F.col("version").alias("v1"), F.col("recall").alias("r1")),
        baseline.select(F.col("version").alias("v0"), F.col("recall").alias("r0")),
    )
    same = F.col("v1") == F.col("v0")
    regressed = same & (F.col("r1") < F.col("r0") - eps)
    return row.select(
        same.alias("comparable"), regressed.alias("regressed"),
        (same & ~regressed & (F.col("r1") >= F.col("r0"))).alias("advance"),
    )


def exact_condition(conditions: T.C, labels: T.C) -> Column:
    """A condition equals one of the labels of five characters or more."""
    wanted = F.filter(F.transform(T.col(labels), T.normalize_term), lambda l: F.length(l) >= 5)
    return F.arrays_overlap(F.transform(T.col(conditions), T.normalize_term), wanted)


def review_gate(packets: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(entity, problem)`` rows; an empty result lets the review pass.

    ``packets``: ``entity, fetch_error, fully_scanned, labels, range_reviewed,
    reviewed_by, reviewed_on``; ``candidates``: ``entity, doc, study_type,
    conditions, verdict, reason, disagreement_reviewed``.
    """
    blank = lambda c: F.coalesce(T.strip(c), F.lit("")) == ""
    packet_rules = F.array_compact(
        F.array(
            F.when(~blank("fetch_error"), "fetch-failed"),
            F.when(~F.coalesce("fully_scanned", F.lit(False)), "not-fully-scanned"),
            F.when(~F.coalesce("range_reviewed", F.lit(False)), "range-not-reviewed"),
            F.when(blank("reviewed_by") | F.col("reviewed_on").isNull(), "reviewer-missing"),
        )
    )
    packet_rows = packets.select("entity", F.explode(packet_rules).alias("problem"))
    rows = candidates.join(packets.select("entity", "labels"), "entity")
    inter = F.col("study_type") == "INTERVENTIONAL"
    disagrees = (
        inter & exact_condition("conditions", "labels")
        & F.col("verdict").isin("false", "uncertain")
        & ~F.coalesce("disagreement_reviewed", F.lit(False))
    )
    missing = F.col("verdict").isNull() | blank("reason")
    candidate_rows = rows.groupBy("entity").agg(
        F.count_if(F.coalesce(disagrees, F.lit(False))).alias("d"), F.count_if(missing).alias("m")
    )
    candidate_rows = candidate_rows.select(
        "entity",
        F.explode(
            F.array_compact(
                F.array(F.when(F.col("d") > 0, "unreviewed-disagreement"), F.when(F.col("m") > 0, "verdict-missing"))
            )
        ).alias("problem"),
    )
    planted = candidates.where(~inter | F.col("study_type").isNull()).agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "false").alias("caught")
    )
    planted = planted.select(
        F.lit(None).cast("string").alias("entity"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("n") < CHECKS, "too-few-checks").when(
                        F.col("caught") < CHECKS_NEEDED, "checks-missed"
                    )
                )
            )
        ).alias("problem"),
    )
    return packet_rows.unionByName(candidate_rows).unionByName(planted)


def label_sets(candidates: DataFrame, pattern: str = r"^NCT\d{8}$") -> DataFrame:
    """``(entity, label, doc)``: distinct valid ids per verdict, one per row.

    Rows rather than arrays, so an entity with very many documents is no burden.
    Only interventional rows count; irrelevant leaves out broad-only finds.
    """
    doc = F.upper(T.strip("doc"))
    label = (
        F.when(F.col("verdict") == "true", "relevant")
        .when((F.col("verdict") == "false") & (F.col("discovered_via") != "broad"), "irrelevant")
        .when(F.col("verdict") == "uncertain", "uncertain")
        .when(F.col("verdict") == PARENT, "parent")
    )
    return (
        candidates.where(F.col("study_type") == "INTERVENTIONAL")
        .select("entity", label.alias("label"), doc.alias("doc"))
        .where(F.col("label").isNotNull() & F.col("doc").rlike(pattern))
        .distinct()
    )


def control_score(votes: DataFrame, controls: DataFrame) -> DataFrame:
    """``(voter, n, right, passed)``: known negatives each voter called false."""
    rows = votes.join(controls.select("entity", "doc").distinct(), ["entity", "doc"], "left_semi")
    return (
        rows.groupBy("voter")
        .agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "false").alias("right"))
        .withColumn("passed", (F.col("n") >= CHECKS) & (F.col("right") >= CHECKS_NEEDED))
    )


def adjudication_status(
    candidates: DataFrame, votes: DataFrame, voters: tuple[str, str], noisy: DataFrame | None = None, most: int = MAX_CANDIDATES
) -> DataFrame:
    """``(entity, candidates, voted, status)`` of every entity.

    Ready if all candidates have both voters' verdicts; else the first that holds of
    ``listed-as-noisy``, ``too-many-candidates`` and ``votes-missing``.
    """
    per_doc = votes.where(F.col("voter").isin(list(voters))).groupBy("entity", "doc").agg(
        F.bool_or(F.col("voter") == voters[0]).alias("_a"), F.bool_or(F.col("voter") == voters[1]).alias("_b")
    )
    both = F.coalesce(F.col("_a") & F.col("_b"), F.lit(False))
    sized = candidates.select("entity", "doc").distinct().join(per_doc, ["entity", "doc"], "left").groupBy("entity").agg(
        F.count("*").alias("candidates"), F.count_if(both).alias("voted")
    )
    if noisy is None:
        noisy = candidates.sparkSession.createDataFrame([(c,) for c in vocab.NOISY_CODES], "entity string")
    listed = noisy.select(F.col("entity").cast("string").alias("_noisy")).distinct().withColumn("_listed", F.lit(True))
    status = (
        F.when(F.col("_listed"), "listed-as-noisy").when(F.col("candidates") > most, "too-many-candidates")
        .when(F.col("voted") < F.col("candidates"), "votes-missing").otherwise("ready")
    )
    joined = sized.join(listed, F.col("entity").cast("string") == F.col("_noisy"), "left")
    return joined.select("entity", "candidates", "voted", status.alias("status"))


def adjudication_ready(
    candidates: DataFrame, votes: DataFrame, voters: tuple[str, str], noisy: DataFrame | None = None
) -> DataFrame:
    """Entities whose candidates all have both voters' verdicts and that are not too large."""
    ready = adjudication_status(candidates, votes, voters, noisy).where("status = 'ready'")
    return ready.select("entity", "candidates", F.lit(True).alias("complete"))


def evidence_key(voter: T.C, version: T.C, *fields: T.C) -> Column:
    """SHA-256 over voter, version and evidence; how a row was found is left out."""
    parts = [T.col(voter).alias("voter"), T.col(version).alias("version")]
    parts += [T.col(f).alias(f"f{i}") for i, f in enumerate(fields)]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def found_documents(studies: DataFrame, terms: DataFrame) -> DataFrame:
    """``(entity, doc)`` that production matching finds."""
    return phrase_match(study_texts(studies), terms).select("entity", "doc").distinct()
