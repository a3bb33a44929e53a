"""Corpus-level counters, snapshot rows and plotting tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import text as T
from ..functions import vocab
from ..runtime import side_by_side
from .confidence import credible, failed, zero
from .ranks import distribution


def headline_counts(df: DataFrame) -> DataFrame:
    """Eleven counters in one pass.

    Broken rows leave every denominator and still count as incomplete.
    """
    pub, study = credible("papers"), credible("studies")
    sound = F.col("health") != "broken"
    no_study = study & zero("studies")
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(pub).alias("papers_denominator"),
        F.count_if(study).alias("studies_denominator"),
        F.count_if(pub & study).alias("both_denominator"),
        F.count_if(pub & zero("recent")).alias("no_recent_papers"),
        F.count_if(no_study).alias("no_studies"),
        F.count_if(no_study & (F.coalesce("parent_studies", F.lit(0)) == 0)).alias("no_studies_inclusive"),
        F.count_if(study & zero("registered")).alias("no_registered"),
        F.count_if(pub & study & zero("recent") & zero("studies")).alias("no_recent_no_studies"),
        F.count_if(failed("papers_error") | failed("studies_error")).alias("incomplete"),
        F.count_if(~sound).alias("broken"),
    )


def defensibility(df: DataFrame) -> DataFrame:
    """Zero-study rows split by whether their recent papers reach the median."""
    gate = df.where(credible("papers") & F.col("recent").isNotNull()).select("recent")
    median = distribution(gate, "recent").select("median")
    recent = F.coalesce("recent", F.lit(0))
    rows = df.where(credible("studies") & zero("studies")).select(
        recent.alias("r"), credible("papers").alias("ok")
    )
    rich = F.col("ok") & (F.col("r") > 0) & (F.col("r") >= median.scalar())
    return rows.withColumn("rich", rich).agg(
        F.count_if("rich").alias("substantial_literature"),
        F.count_if(~F.col("rich")).alias("no_literature"),
    )


def corpus_rollup(catalogue: DataFrame, group: str = "group", name: str = "name") -> DataFrame:
    """Rows per group and the total (``is_total``) of a catalogue, in one pass.

    ``share_rank`` numbers groups by size, ties by name; the total has none.
    """
    label = F.coalesce(F.col(group), F.lit("(missing)"))
    is_group = F.col("group") == "Group of disorders"
    retired = ~is_group & (F.col("name").startswith("OBSOLETE:") | F.col("name").startswith("NON RARE IN EUROPE:"))
    # Rolled up on the label alone, so the flags are sums of what stands in the row.
    rows = catalogue.select(label.alias("group"), F.col(name).alias("name")).select(
        "group", is_group.alias("is_group"), retired.alias("is_retired"), (F.col("group") == "Disorder").alias("is_disorder")
    )
    levels = rows.rollup("group").agg(
        F.grouping("group").cast("boolean").alias("is_total"), F.count("*").alias("total"),
        F.count_if(~F.col("is_group")).alias("after_groups"), F.count_if("is_retired").alias("retired"),
        F.count_if("is_disorder").alias("disorder_level"),
    ).withColumn("usable", F.col("after_groups") - F.col("retired"))
    # One row a group: a short window.
    w = W.partitionBy("is_total").orderBy(F.col("total").desc(), "group")
    return levels.withColumn("share_rank", F.when(~F.col("is_total"), F.row_number().over(w)))


def corpus_levels(catalogue: DataFrame, group: str = "group", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """``(per group, totals)`` of a catalogue, two views of one rollup."""
    levels = corpus_rollup(catalogue, group, name)
    per = levels.where(~F.col("is_total")).select("group", F.col("total").alias("n"))
    totals = levels.where("is_total").select("total", "after_groups", "retired", "disorder_level", "usable")
    return per, totals


def headline_range(aggregate: DataFrame) -> DataFrame:
    """Shares without a study, specific and parent-inclusive, with their range."""
    d = F.col("studies_denominator")
    measured = d > 0
    specific = F.when(measured, S.percent_1("no_studies", d))
    inclusive = F.when(measured, S.percent_1(F.coalesce("no_studies_inclusive", "no_studies"), d))
    return aggregate.select(
        specific.alias("specific_pct"),
        inclusive.alias("inclusive_pct"),
        F.least(specific, inclusive).alias("low"),
        F.greatest(specific, inclusive).alias("high"),
    )


def gene_related(name: T.C) -> Column:
    return T.col(name).rlike(vocab.GENE_RELATED_NAME)


def hyper_specific(df: DataFrame) -> DataFrame:
    """Long or hyphenated labels without papers under a well-covered parent."""
    rows = df.where(
        zero("papers")
        & (F.col("probe_hits") >= 50)
        & ~F.col("probe_label").rlike(vocab.UNINFORMATIVE_PARENT)
        & ((F.length("name") >= 45) | F.col("name").contains("-"))
    )
    return rows.select(
        "code", "name", "papers", "probe_label", "probe_hits", gene_related("name").alias("gene_related")
    ).orderBy(F.col("probe_hits").desc(), "code")


def gene_related_forms(df: DataFrame, sparse: int = 5) -> DataFrame:
    """Labels named after a gene, and how many of them have few papers."""
    return df.where(gene_related("name")).agg(
        F.count("*").alias("gene_related"),
        F.count_if(F.coalesce("papers", F.lit(0)) < sparse).alias("gene_related_sparse"),
    )


def findings_snapshot(df: DataFrame, catalogue_totals: DataFrame, defects: DataFrame) -> DataFrame:
    """One row: searchability, study range, label defects, hyper-specific labels.

    ``defects`` has ``origin``; ``catalogue_totals`` comes from ``corpus_levels``.
    """
    counts = headline_counts(df)
    row = side_by_side(
        counts,
        headline_range(counts).select("specific_pct", "inclusive_pct"),
        hyper_specific(df).agg(F.count("*").alias("hyper_specific")),
        gene_related_forms(df),
        defects.agg(F.count_if(F.col("origin") == "upstream").alias("upstream_defects")),
        catalogue_totals.select(F.col("total").alias("catalogue_rows"), "after_groups", "retired", "usable"),
    )
    return row.withColumns(
        {
            "broken_pct": S.percent_1("broken", "total"),
            "papers_excluded": F.col("total") - F.col("papers_denominator"),
            "papers_excluded_pct": S.percent_1(F.col("total") - F.col("papers_denominator"), "total"),
            "upstream_pct": S.percent_1("upstream_defects", "catalogue_rows"),
        }
    )


EXAMPLES = "section string, rank int, code string, name string, detail string, papers long, parent string, parent_hits long"


def _first(df: DataFrame, section: str, order: list, most: int | None) -> DataFrame:
    """Rows of one section numbered in order; a limit keeps the sort to the rows shown."""
    shown = df.orderBy(*order) if most is None else df.orderBy(*order).limit(most)
    # As many rows as a page shows, or as many defects as were reviewed by hand.
    at = F.row_number().over(W.partitionBy("section").orderBy(*order))
    fields = {name: kind for name, kind in (part.split() for part in EXAMPLES.split(", ")) if name not in ("section", "rank")}
    given = [F.col(n).cast(k).alias(n) if n in df.columns else F.lit(None).cast(k).alias(n) for n, k in fields.items()]
    return shown.withColumn("section", F.lit(section)).withColumn("rank", at).select("section", "rank", *given)


def findings_examples(df: DataFrame, defects: DataFrame, curated: list[str] | None = None) -> DataFrame:
    """``EXAMPLES`` rows of a findings snapshot, by section.

    ``broken``: the first eight, with their first reason. ``defect``: every upstream
    defect (``code, name, form, origin``). ``gene-related``: four labels named after a
    gene with under five papers. ``hyper-specific``: the curated codes if three or
    more are there, at most four of them; else three labels with the best-covered
    parents and two sparse gene-related ones, at most four together.
    """
    by_code = [F.expr("try_cast(code as bigint)"), F.col("code")]
    missing = F.lit("every search strategy returned zero")
    broken = df.where("health = 'broken'").withColumn("detail", F.coalesce(F.get("health_reasons", F.lit(0)), missing))
    upstream = defects.where("origin = 'upstream'").withColumn("detail", F.col("form"))
    sparse = df.where(gene_related("name") & (F.coalesce("papers", F.lit(0)) < 5)).withColumn("detail", F.lit("gene-related"))
    labels = df.withColumnsRenamed({"probe_label": "parent", "probe_hits": "parent_hits"})
    chosen = labels.where(F.col("code").isin(curated if curated is not None else vocab.FINDINGS_CODES))
    listed = F.array_position(F.array(*[F.lit(c) for c in (curated if curated is not None else vocab.FINDINGS_CODES)]), F.col("code"))
    parents = hyper_specific(df).withColumnsRenamed({"probe_label": "parent", "probe_hits": "parent_hits"})
    if chosen.count() >= 3:
        hyper = _first(chosen.withColumn("place", listed), "hyper-specific", [F.col("place")], 4)
    else:
        best = _first(parents, "hyper-specific", [F.col("parent_hits").desc(), *by_code], 3)
        few = _first(sparse.withColumn("parent_hits", F.lit(0)), "hyper-specific", by_code, 2).withColumn("rank", F.col("rank") + 3)
        both = best.unionByName(few)
        # Five rows at most.
        hyper = both.withColumn("rank", F.row_number().over(W.partitionBy("section").orderBy("rank"))).where("rank <= 4")
    return (
        _first(broken, "broken", by_code, 8)
        .unionByName(_first(upstream, "defect", by_code, None))
        .unionByName(_first(sparse, "gene-related", by_code, 4))
        .unionByName(hyper)
    )


def findings_record(snapshot: DataFrame, provenance: DataFrame) -> DataFrame:
    """The snapshot's row with the versions and the sampling it was made from.

    ``provenance``, one row: ``catalogue_version, ontology_version, evidence_version,
    mode, n, seed, excluded``. Versions that were not recorded stay null.
    """
    return side_by_side(snapshot, provenance)


def landscape_cells(df: DataFrame) -> DataFrame:
    """Slim projection for plotting."""
    return df.select(
        "code", "name", "papers", "recent", "studies", "people", "confidence",
        (F.col("health") == "broken").alias("broken"), "group",
    )


def search_index(df: DataFrame) -> DataFrame:
    """Names and three signal levels."""
    return df.select(
        "code", "name", "synonyms",
        S.signal_level("papers", "papers").alias("papers_level"),
        S.signal_level("people", "people").alias("people_level"),
        S.signal_level("studies", "studies").alias("studies_level"),
    )


def landscape_histogram(cells: DataFrame, metric: str, kind: str) -> DataFrame:
    """Cells per level 0-4, plus broken and unknown."""
    level = (
        F.when(F.col("broken"), "broken")
        .when(F.col(metric).isNull(), "unknown")
        .otherwise(S.signal_level(metric, kind).cast("string"))
    )
    return cells.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def landscape_groups(cells: DataFrame, group: str = "group", collation: str | None = None) -> DataFrame:
    """Entities per group, largest first, then by name; blank becomes Ungrouped."""
    label = F.when(T.strip(group) != "", T.strip(group)).otherwise("Ungrouped")
    return (
        cells.groupBy(label.alias("group")).agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), T.display_key("group", collation))
    )


def log_points(cells: DataFrame, x: str = "recent", y: str = "studies") -> tuple[DataFrame, DataFrame]:
    """``(points, maxima)`` on the log10(1 + x) scale."""
    points = cells.select("code", S.log1p10(x).alias("x"), S.log1p10(y).alias("y"))
    return points, points.agg(F.max("x").alias("max_x"), F.max("y").alias("max_y"))
