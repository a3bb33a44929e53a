"""Study counts per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab
from ..runtime import materialize, side_by_side


def first_n(df: DataFrame, keys: list[str], order: list, n: int, fields: list[str], out: str) -> DataFrame:
    """The first ``n`` rows of each key as an array of structs, in order.

    The rank filter is pushed below the shuffle (each task forwards at most
    ``n`` rows per key), so the array and the task stay small for any key.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    top = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    packed = F.array_sort(F.collect_list(F.struct("_rn", *fields)))
    return top.groupBy(*keys).agg(
        F.transform(packed, lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(out)
    )


def study_signals(matches: DataFrame, cap: int = 15) -> DataFrame:
    """Counts per entity over distinct matched documents.

    ``matches`` has ``entity, doc, study_type, status, matched_via``. Only
    interventional documents make ``total``; the other types are kept apart. Counts
    and lists read the matches from a table, so they are found once.
    """
    columns = ["entity", "doc", "study_type", "status", "matched_via"]
    m = materialize(matches.select(*columns).dropDuplicates(["entity", "doc"]), "signals")
    recruiting = F.upper("status").isin(vocab.RECRUITING_STATUSES)
    inter = F.coalesce(F.col("study_type") == "INTERVENTIONAL", F.lit(False))
    obs = F.coalesce(F.col("study_type") == "OBSERVATIONAL", F.lit(False))
    counts = m.groupBy("entity").agg(
        F.count_if(inter).alias("total"),
        F.count_if(inter & recruiting).alias("recruiting_count"),
        F.count_if(obs).alias("observational_total"),
        F.count_if(obs & recruiting).alias("observational_recruiting"),
        F.count_if(~inter & ~obs).alias("expanded_access_total"),
        F.count("*").alias("registered_total"),
        F.array_sort(F.collect_set(F.when(inter, F.col("matched_via")))).alias("matched_via"),
        F.array_compact(
            F.array(
                F.when(F.bool_or(F.col("matched_via").isin("phrase", "both")), "phrase"),
                F.when(F.bool_or(F.col("matched_via").isin("mesh", "both")), "mesh"),
                F.when(F.bool_or(F.col("matched_via") == "recall-expansion"), "recall-expansion"),
            )
        ).alias("strategies_with_hits"),
    )
    lists = first_n(m.where(inter & recruiting), ["entity"], ["doc"], cap, ["doc", "status"], "recruiting")
    return counts.join(lists, "entity", "left")


def fallback_scan(tiers: list[DataFrame], key: str = "entity") -> DataFrame:
    """First complete tier per entity; null and an error when none is.

    Each tier holds ``(key, total, complete)``, from the widest term list to the
    narrowest. A partial count is never published.
    """
    joined = tiers[0].select(key)
    for i, tier in enumerate(tiers):
        joined = joined.join(
            tier.select(key, F.col("total").alias(f"t{i}"), F.col("complete").alias(f"c{i}")), key, "left"
        )
    done = [F.coalesce(F.col(f"c{i}"), F.lit(False)) for i in range(len(tiers))]
    total = F.coalesce(*[F.when(d, F.col(f"t{i}")) for i, d in enumerate(done)])
    tier_no = F.coalesce(*[F.when(d, F.lit(i)) for i, d in enumerate(done)])
    return joined.select(
        key,
        total.alias("total"),
        tier_no.alias("tier"),
        F.when(tier_no.isNull(), "incomplete scan after the narrowest terms").alias("error"),
    )


def offline_match_summary(
    entities: DataFrame, hits: DataFrame, code: str, existing: str, doc: str, cap: int = 50
) -> DataFrame:
    """Match counts per entity beside the stored total, with the first matches.

    ``hits`` has ``code, doc, study_type, term, via``.
    """
    inter = F.coalesce(F.col("study_type") == "INTERVENTIONAL", F.lit(False))
    counts = hits.groupBy(code).agg(
        F.count("*").alias("matches"), F.count_if(inter).alias("interventional")
    )
    lists = first_n(
        hits.withColumn("_other", ~inter), [code], ["_other", doc], cap, [doc, "term", "via"], "first_matches"
    )
    zero = F.lit(0).cast("long")
    return (
        entities.select(code, F.col(existing).alias("existing"))
        .join(counts, code, "left")
        .join(lists, code, "left")
        .select(
            code,
            "existing",
            F.coalesce("matches", zero).alias("matches"),
            F.coalesce("interventional", zero).alias("interventional"),
            (F.coalesce("interventional", zero) - F.col("existing")).alias("delta"),
            "first_matches",
            (F.coalesce("matches", zero) > cap).alias("truncated"),
        )
    )


def offline_match_totals(per_entity: DataFrame, hits: DataFrame, doc: str) -> DataFrame:
    """One row over the corpus, with the sizes of both disagreement lists."""
    stored = F.coalesce("existing", F.lit(0))
    left = per_entity.agg(
        F.count_if(F.col("matches") > 0).alias("entities_with_hit"),
        F.count_if(F.col("interventional") > 0).alias("entities_with_interventional"),
        F.count_if((stored == 0) & (F.col("interventional") > 0)).alias("stored_zero_matched_some"),
        F.count_if((stored > 0) & (F.col("interventional") == 0)).alias("stored_some_matched_zero"),
    )
    docs = hits.groupBy(doc).agg(F.bool_or(F.col("study_type") == "INTERVENTIONAL").alias("inter"))
    right = docs.agg(
        F.count("*").alias("docs_matched"), F.count_if("inter").alias("interventional_docs")
    )
    return side_by_side(left, right)


def disagreements(per_entity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities stored as zero but matched, and the reverse."""
    stored = F.coalesce("existing", F.lit(0))
    return (
        per_entity.where((stored == 0) & (F.col("interventional") > 0)),
        per_entity.where((stored > 0) & (F.col("interventional") == 0)),
    )

