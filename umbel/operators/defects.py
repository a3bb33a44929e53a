"""Label defects: where they occur, and whether the source or the parser made them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab

PATTERNS = {"joined-words": vocab.JOINED_WORDS, **vocab.MISSPELLINGS}


def label_hits(df: DataFrame, code: str, name: str, synonyms: str, patterns: dict[str, str]) -> DataFrame:
    """``(code, pattern, field, label)``: the name if it matches, else the first synonym."""

    def check(pid: str, rx: str) -> Column:
        others = F.coalesce(F.col(synonyms), F.array().cast("array<string>"))
        syn = F.get(F.filter(others, lambda s: s.rlike(rx)), F.lit(0))

        def hit(field: str, label: Column) -> Column:
            return F.struct(F.lit(pid).alias("pattern"), F.lit(field).alias("field"), label.alias("label"))

        return F.when(F.col(name).rlike(rx), hit("Name", F.col(name))).when(syn.isNotNull(), hit("Synonym", syn))

    checks = [check(pid, rx) for pid, rx in patterns.items()]
    return df.select(F.col(code).alias("code"), F.explode(F.array_compact(F.array(*checks))).alias("h")).select(
        "code", "h.pattern", "h.field", "h.label"
    )


def label_defect_scan(hits: DataFrame) -> DataFrame:
    """Per pattern: rows whose name matches, rows where any label does."""
    return hits.groupBy("pattern").agg(
        F.count_if(F.col("field") == "Name").alias("in_name"), F.count("*").alias("in_any")
    )


def defect_examples(hits: DataFrame, most: int = 15, most_joined: int = 25) -> DataFrame:
    """First examples of each pattern by code."""
    w = W.partitionBy("pattern").orderBy(F.col("code").cast("long"), "code")
    cap = F.when(F.col("pattern") == "joined-words", most_joined).otherwise(most)
    top = max(most, most_joined)
    return (
        hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).where(F.col("rank") <= cap)
    )


def classify_defects(suspects: DataFrame, raw: DataFrame, parsed: DataFrame) -> DataFrame:
    """Origin of each suspected form: upstream, parser or not-reproduced.

    ``suspects``: ``code, kind, form``; ``raw``: ``code, name, synonyms``;
    ``parsed``: ``code, parsed``.
    """
    rows = suspects.join(raw.select("code", "name", "synonyms"), "code", "left").join(
        parsed.select("code", "parsed"), "code", "left"
    )
    form = F.lower("form")
    in_name = F.coalesce(F.lower("name").contains(form), F.lit(False))
    in_synonym = F.coalesce(F.exists("synonyms", lambda s: F.lower(s).contains(form)), F.lit(False))
    in_parsed = F.coalesce(F.lower("parsed").contains(form), F.lit(False))
    origin = (
        F.when(F.col("name").isNull(), "not-reproduced")
        .when(in_name, "upstream")
        .when(in_parsed & ~in_synonym, "parser")
        .when(in_synonym, "upstream")
        .otherwise("not-reproduced")
    )
    note = (
        F.when(F.col("name").isNull(), "code not found")
        .when(in_name & F.col("parsed").isNull(), "in name, not parsed")
        .when(in_name & (F.col("parsed") == F.col("name")), "name equals parsed label")
        .when(in_name & in_parsed, "in name and parsed label")
        .when(in_name, "in name, parsed label differs")
        .when(in_parsed & ~in_synonym, "only in parsed label")
        .when(in_synonym, "in a synonym only")
        .otherwise("not found")
    )
    return rows.select("code", "kind", "form", "name", "parsed", origin.alias("origin"), note.alias("note"))
