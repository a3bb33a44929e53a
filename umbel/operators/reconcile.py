"""Merging, carrying over and comparing two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def merge_candidates(first: DataFrame, broad: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Union by key with the source; the first side's fields win."""
    a = first.dropDuplicates([key]).select(key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(1).alias("a_in"))
    b = broad.dropDuplicates([key]).select(key, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(1).alias("b_in"))
    source = (
        F.when(F.col("a_in").isNotNull() & F.col("b_in").isNotNull(), "both")
        .when(F.col("a_in").isNotNull(), "pipeline")
        .otherwise("broad")
    )
    merged = [F.when(F.col("a_in").isNotNull(), F.col(f"a_{f}")).otherwise(F.col(f"b_{f}")).alias(f) for f in fields]
    return a.join(b, key, "full_outer").select(key, *merged, source.alias("source"))


def carry_forward(new: DataFrame, old: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Reuse earlier verdicts by key where the new row has none."""
    prior = old.select(*keys, *[F.col(f).alias(f"_old_{f}") for f in fields]).dropDuplicates(keys)
    joined = new.join(prior, keys, "left")
    for f in fields:
        kept = F.coalesce(f, f"_old_{f}") if f in new.columns else F.col(f"_old_{f}")
        joined = joined.withColumn(f, kept)
    return joined.drop(*[f"_old_{f}" for f in fields])


def labels_align(gold: T.C, labels: T.C) -> Column:
    """Any catalogue label contains the folded gold label or is contained in it."""
    head = F.substring_index(F.substring_index(T.col(gold), " / ", 1), " (", 1)
    expected = T.fold_label(head)
    return F.exists(
        F.transform(T.col(labels), T.fold_label),
        lambda l: l.contains(expected) | expected.contains(l),
    )


def align_labels(gold: DataFrame, catalogue: DataFrame, all_codes: DataFrame) -> DataFrame:
    """``(code, problem)`` rows.

    ``gold``: ``code, name, difficulty, true_count, relevant (array),
    irrelevant, uncertain, reviewed_by``; ``catalogue``: ``code, labels``.
    """
    known = all_codes.select("code").distinct().withColumn("_known", F.lit(True))
    rows = (
        gold.where(F.col("code").rlike(r"^\d+$"))
        .join(known, "code", "left")
        .join(catalogue.select("code", "labels"), "code", "left")
    )
    absent = F.col("_known").isNull()
    reviewed = (
        F.col("relevant").isNotNull() & F.col("irrelevant").isNotNull() & F.col("uncertain").isNotNull()
        & (F.coalesce(T.strip("reviewed_by"), F.lit("")) != "")
    )
    grouped = ~absent & F.col("labels").isNull()
    problems = F.array_compact(
        F.array(
            F.when(~reviewed, "review-incomplete").when(
                F.coalesce(F.col("true_count") != F.size("relevant"), F.lit(True)), "count-mismatch"
            ),
            F.when(absent, "absent-code")
            .when(grouped & (F.col("difficulty") != "umbrella"), "not-a-usable-row")
            .when(F.col("labels").isNotNull() & ~labels_align("name", "labels"), "label-mismatch"),
        )
    )
    return rows.select("code", F.explode(problems).alias("problem"))


def snapshot_diff(
    before: DataFrame, after: DataFrame, key: str, fields: list[str],
    touched: DataFrame | None = None, frozen_if_touched: list[str] | None = None,
    derived: list[str] | None = None,
) -> DataFrame:
    """``(key, change, field)``: rows lost or added, and forbidden field changes.

    Touched rows may not change ``frozen_if_touched``; untouched rows may change
    only ``derived``. Without ``touched``, every row counts as touched.
    """
    frozen = set(fields if frozen_if_touched is None else frozen_if_touched)
    loose = set(derived or [])
    a = before.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(1).alias("_in_b"))
    b = after.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(1).alias("_in_a"))
    rows = a.join(b, key, "full_outer")
    if touched is None:
        rows = rows.withColumn("_t", F.lit(True))
    else:
        marks = touched.select(key).distinct().withColumn("_t", F.lit(True))
        rows = rows.join(marks, key, "left").withColumn("_t", F.coalesce("_t", F.lit(False)))
    both = F.col("_in_b").isNotNull() & F.col("_in_a").isNotNull()
    changes = [
        F.when(F.col("_in_a").isNull(), F.struct(F.lit("lost").alias("change"), F.lit(None).cast("string").alias("field"))),
        F.when(F.col("_in_b").isNull(), F.struct(F.lit("added").alias("change"), F.lit(None).cast("string").alias("field"))),
    ]
    for f in fields:
        differs = both & ~F.col(f"_b_{f}").eqNullSafe(F.col(f"_a_{f}"))
        barred = (F.col("_t") & F.lit(f in frozen)) | (~F.col("_t") & F.lit(f not in loose))
        changes.append(
            F.when(differs & barred, F.struct(F.lit("changed").alias("change"), F.lit(f).alias("field")))
        )
    return rows.select(key, F.explode(F.array_compact(F.array(*changes))).alias("c")).select(
        key, "c.change", "c.field"
    )


def transitions(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Entities that went from measured zero to more."""
    old = before.where(F.col(value) == 0).select(key)
    return after.where(F.col(value) > 0).join(old, key, "left_semi").select(key, value)
