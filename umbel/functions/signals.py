"""Small numeric rules shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import C, col


def percent_1(numerator: C, denominator: C) -> Column:
    """Percent to one decimal, halves up; 0 when there is no denominator."""
    n, d = col(numerator).cast("double"), col(denominator).cast("double")
    return F.when(d > 0, F.floor(n * 1000 / d + 0.5) / F.lit(10.0)).otherwise(F.lit(0.0))


def signal_level(count: C, kind: str) -> Column:
    """0 to 4; null counts as 0."""
    two, three, four = vocab.SIGNAL_STEPS[kind]
    c = col(count)
    return (
        F.when(c.isNull() | (c <= 0), 0)
        .when(c < two, 1)
        .when(c < three, 2)
        .when(c < four, 3)
        .otherwise(4)
    )


def log1p10(c: C) -> Column:
    return F.log10(F.lit(1.0) + F.coalesce(col(c), F.lit(0)).cast("double"))


def neglect_score(papers: C, recent: C, studies: C, people: C, gene_class: C) -> Column:
    boost = (
        F.when(col(gene_class) == "None", 0.4)
        .when(col(gene_class).isin("Limited", "Disputed"), 0.2)
        .otherwise(0.0)
    )
    return F.lit(10.0) - (log1p10(papers) + log1p10(recent) + log1p10(studies) + log1p10(people)) + boost


def as_array(c: C, element: str) -> Column:
    """One-or-many JSON text as an array; null or JSON null becomes empty.

    ``element`` is the DDL type of one element.
    """
    raw = F.ltrim(col(c))
    many = F.from_json(raw, f"array<{element}>")
    if element == "string":
        one = F.array(F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))
    else:
        one = F.array(F.from_json(raw, element))
    empty = F.array().cast(f"array<{element}>")
    return (
        F.when(raw.isNull() | raw.isin("", "null"), empty)
        .when(raw.startswith("["), F.coalesce(many, empty))
        .otherwise(F.filter(one, lambda x: x.isNotNull()))
    )


def data_as_of(*stamps: C) -> Column:
    """Latest of the given ISO timestamps; unreadable ones are skipped."""
    return F.greatest(*[F.try_to_timestamp(col(s)) for s in stamps])


def age_days(since: C, now: C) -> Column:
    return F.datediff(col(now), col(since))
