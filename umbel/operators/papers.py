"""Paper counts, yearly series and people per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def publication_signals(matches: DataFrame) -> DataFrame:
    """Phrase, label and union counts of distinct papers per entity.

    ``matches`` has ``entity, strategy, doc`` (strategy phrase, mesh or
    expansion). One row per paper first, so a plain count is distinct.
    """
    per_doc = matches.groupBy("entity", "doc").agg(
        F.bool_or(F.col("strategy") == "phrase").alias("phrase"),
        F.bool_or(F.col("strategy") == "mesh").alias("mesh"),
    )
    return per_doc.groupBy("entity").agg(
        F.count("*").alias("total"),
        F.count_if("phrase").alias("phrase_count"),
        F.count_if("mesh").alias("mesh_count"),
        F.array_compact(
            F.array(F.when(F.bool_or("phrase"), "phrase"), F.when(F.bool_or("mesh"), "mesh"))
        ).alias("strategies_with_hits"),
    )


def yearly_series(
    papers: DataFrame, entities: DataFrame, key: str, year: str, now: int, years: int = 15
) -> tuple[DataFrame, DataFrame]:
    """``(series, recent)``: zero-filled counts per year, last-ten-years sum.

    ``papers`` has one row per entity and paper. The window is clamped to 0-30
    years; the recent sum always covers ten.
    """
    span = max(0, min(30, years))
    counted = papers.groupBy(key, year).agg(F.count("*").alias("n"))
    keys = entities.select(key).distinct()
    first = now - (span - 1)
    if span:
        grid = keys.select(key, F.explode(F.sequence(F.lit(first), F.lit(now))).alias(year))
    else:
        grid = keys.select(key, F.lit(None).cast("int").alias(year)).limit(0)
    series = grid.join(counted, [key, year], "left").select(
        key, year, F.coalesce("n", F.lit(0)).alias("n")
    )
    recent = counted.where(F.col(year).between(now - 9, now)).groupBy(key).agg(F.sum("n").alias("recent"))
    recent = keys.join(recent, key, "left").select(key, F.coalesce("recent", F.lit(0)).alias("recent"))
    return series, recent


def author_key(last: T.C, initials: T.C, first: T.C | None = None) -> Column:
    """Last name and up to three initials, lower case; null for groups."""
    name = T.strip(last)
    given = T.col(initials) if first is None else F.coalesce(
        F.when(T.strip(initials) != "", T.col(initials)), T.col(first)
    )
    marks = F.substring(F.regexp_replace(F.coalesce(given, F.lit("")), "[^A-Za-z]", ""), 1, 3)
    usable = (F.length(name) >= 2) & ~name.rlike(vocab.GROUP_AUTHOR)
    return F.when(usable, F.concat(F.lower(name), F.lit("|"), F.lower(marks)))


def sample_papers(papers: DataFrame, key: str, order: list, n: int = 200) -> DataFrame:
    """The first ``n`` papers of each entity; the people count is a sample by rule."""
    w = W.partitionBy(key).orderBy(*order)
    return papers.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def researchers(
    authors: DataFrame, key: str, order: list[str], top: int = 10, collation: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(counts, leaders)`` from rows ``key, author, display, affiliation, year``.

    ``order`` names the columns that fix paper order: the display name is the
    first seen, the affiliation the last one that is not null. Leaders with as many
    papers go by name, in a collation if one is given.
    """
    at = F.struct(*order)
    people = (
        authors.where(F.col("author").isNotNull())
        .groupBy(key, "author")
        .agg(
            F.count("*").alias("papers"),
            F.min_by("display", at).alias("display"),
            F.max_by("affiliation", F.when(F.col("affiliation").isNotNull(), at)).alias("affiliation"),
            F.max("year").alias("latest_year"),
        )
    )
    counts = people.groupBy(key).agg(F.count("*").alias("people"))
    w = W.partitionBy(key).orderBy(F.col("papers").desc(), T.display_key("display", collation), "author")
    leaders = people.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return counts, leaders
