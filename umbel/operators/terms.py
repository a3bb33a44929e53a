"""Term tables: one row per entity and term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import materialize


def apply_stoplist(entities: DataFrame, code: str, label: str, synonyms: str) -> DataFrame:
    """Rows ``(code, term, reason)``; a null reason means the term is kept."""
    judged = T.stoplist_split(F.concat(F.array(label), F.col(synonyms)))
    kept = F.transform(
        judged["kept"], lambda t: F.struct(t.alias("term"), F.lit(None).cast("string").alias("reason"))
    )
    rows = entities.select(code, F.explode(F.concat(kept, judged["dropped"])).alias("x"))
    return rows.select(code, "x.term", "x.reason")


def phrase_term_rows(
    entities: DataFrame, code: str, names: str, synonyms: str, cap: int = 40
) -> tuple[DataFrame, DataFrame]:
    """``(terms, dropped)`` tables of ``phrase_terms`` for every entity, which are made once for both."""
    built = materialize(entities.select(code, T.phrase_terms(names, synonyms, cap).alias("p")), "phrases")
    terms = built.select(code, F.posexplode("p.terms").alias("pos", "term"))
    dropped = built.select(code, F.explode("p.dropped").alias("x")).select(
        code, "x.term", "x.reason"
    )
    return terms, dropped


def strategy_terms(entities: DataFrame, code: str, columns: dict[str, str]) -> DataFrame:
    """Long table ``(code, strategy, term)`` from array columns, one per strategy."""
    tagged = F.array(
        *[
            F.struct(F.lit(strategy).alias("strategy"), F.col(c).alias("terms"))
            for strategy, c in columns.items()
        ]
    )
    wide = entities.select(code, F.explode(tagged).alias("s"))
    return wide.select(code, "s.strategy", F.explode("s.terms").alias("term"))


def query_strings(
    entities: DataFrame, code: str, terms: str, labels: str, budget: int = 900
) -> DataFrame:
    """Stored query forms of each entity: OR query, labelled query, chunks."""
    return entities.select(
        code,
        T.or_query(terms).alias("query"),
        T.label_query(labels).alias("label_query"),
        T.pack_chunks(terms, budget).alias("chunks"),
    )


def merge_corrections(prior: DataFrame, entities: DataFrame) -> DataFrame:
    """Prior report rows, plus entities with a correction not yet listed.

    Both inputs carry ``code``; ``entities`` also ``name`` and ``name_corrected``.
    """
    fresh = (
        entities.where(F.col("name_corrected").isNotNull() & (F.col("name_corrected") != ""))
        .join(prior.select("code"), "code", "left_anti")
        .select(
            "code",
            F.col("name").alias("original"),
            F.col("name_corrected").alias("corrected"),
            F.lit("missing-boundary").alias("type"),
            F.lit("rebuilt from the corrected name").alias("detail"),
            F.lit(True).alias("applied"),
        )
    )
    return prior.unionByName(fresh).orderBy(F.col("code").cast("long"))


def search_entities(
    entities: DataFrame, q: str, code: str = "code", name: str = "name",
    synonyms: str = "synonyms", limit: int = 12,
) -> DataFrame:
    """Substring search on name, synonyms or code; first rows by code."""
    needle = q.strip().lower()
    if len(needle) < 2:
        return entities.limit(0)
    bare = needle.removeprefix("orpha").removeprefix(":") if needle.startswith("orpha") else needle
    hit = (
        F.lower(name).contains(needle)
        | F.col(code).contains(bare)
        | F.exists(F.col(synonyms), lambda s: F.lower(s).contains(needle))
    )
    return entities.where(hit).orderBy(F.col(code).cast("long")).limit(limit)
