"""Matching term phrases to document text on token boundaries.

Every term hangs on one anchor, one of its tokens. A document can only contain the
term if it contains the anchor, so an equality join on distinct document tokens gives
the candidates and a containment test on the normalised text decides. No term is
compared with a document that lacks its anchor, and nothing is compared pairwise.

Text never moves: explode, probe and test run in one stage against a broadcast term
table. A table past the bound is cut into slices that each fit, and the text is
scanned once a slice. Then the anchor is the token found in the fewest documents,
read off one count sketch over all text, so a word that every document has is never
an anchor of a term that has another. Within the bound that extra scan costs more
than it saves, and the anchor is the token shared by the fewest other terms (the
longest of those).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..runtime import broadcast_if_small, broadcast_slices, materialize

MIN_CONDITION = 4
MIN_TITLE = {"phrase": 8, "mesh": 6, "recall": 4}

# The count sketch: so many cells a row, whatever the text; estimates are never too low.
SKETCH_CELLS, SKETCH_ROWS = 1 << 18, 2
# Slices whose hits make one table.
SLICES_A_TABLE = 8


def study_texts(
    studies: DataFrame, doc: str = "nct_id", title: str = "title", conditions: str = "conditions"
) -> DataFrame:
    """Rows ``(doc, field, in_title, text)``, text normalised; ``field`` numbers the fields of a document."""
    fields = F.concat(
        F.transform(
            F.coalesce(F.col(conditions), F.array().cast("array<string>")),
            lambda c: F.struct(F.lit(False).alias("in_title"), T.normalize_term(c).alias("text")),
        ),
        F.array(
            F.struct(F.lit(True).alias("in_title"), T.normalize_term(F.coalesce(title, F.lit(""))).alias("text"))
        ),
    )
    rows = studies.select(F.col(doc).alias("doc"), F.posexplode(fields).alias("field", "f"))
    return rows.select("doc", "field", "f.in_title", "f.text")


def plain_texts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Rows ``(doc, field, in_title, text)`` where the whole text counts as one field.

    Empty texts stay: they have no anchor, and a filter on the computed text
    would make the scan normalise every text twice.
    """
    return docs.select(
        F.col(doc).alias("doc"), F.lit(0).alias("field"), F.lit(False).alias("in_title"), T.normalize_term(text).alias("text")
    )


def normal_terms(
    terms: DataFrame, entity: str, term: str = "term", strategy: str | Column = "phrase"
) -> DataFrame:
    """Distinct ``(entity, strategy, term)`` of at least four characters."""
    kind = F.lit(strategy) if isinstance(strategy, str) else strategy
    return (
        terms.select(F.col(entity).alias("entity"), kind.alias("strategy"), T.normalize_term(term).alias("term"))
        .where(F.length("term") >= MIN_CONDITION)
        .distinct()
    )


def _cells(token: str) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(row), token), F.lit(SKETCH_CELLS)) for row in range(SKETCH_ROWS)])


def frequency_sketch(texts: DataFrame) -> DataFrame:
    """``(row, cell, n)``: texts per cell of a token's hash, over all of ``text``."""
    tokens = texts.select(F.explode(F.array_distinct(F.split("text", " "))).alias("token"))
    return tokens.select(F.posexplode(_cells("token")).alias("row", "cell")).groupBy("row", "cell").agg(F.count("*").alias("n"))


def estimated_frequency(tokens: DataFrame, sketch: DataFrame) -> DataFrame:
    """``(token, n_texts)`` of distinct tokens: the least of their cells."""
    spots = tokens.select("token", F.posexplode(_cells("token")).alias("row", "cell"))
    return spots.join(sketch, ["row", "cell"], "left").groupBy("token").agg(F.min(F.coalesce("n", F.lit(0))).alias("n_texts"))


def anchored(terms: DataFrame, sketch: DataFrame | None = None) -> DataFrame:
    """Distinct terms with their anchor token."""
    distinct = terms.select("term").distinct()
    parts = distinct.select("term", F.explode(F.array_distinct(F.split("term", " "))).alias("token"))
    shared = parts.groupBy("token").agg(F.count("*").alias("n_terms"))
    order = [F.col("n_terms"), -F.length("token"), F.col("token")]
    if sketch is not None:
        shared = shared.join(estimated_frequency(shared.select("token"), sketch), "token")
        order = [F.col("n_texts"), *order]
    return parts.join(shared, "token").groupBy("term").agg(F.min_by("token", F.struct(*order)).alias("anchor"))


def anchored_slices(texts: DataFrame, terms: DataFrame) -> list[DataFrame]:
    """The term table with anchors, ready to be broadcast slice by slice."""
    near = anchored(terms)
    if broadcast_if_small(near)[1]:
        return [F.broadcast(near)]
    sketch = materialize(frequency_sketch(texts), "sketch")
    return broadcast_slices(anchored(terms, sketch), "term")


def over_slices(slices: list[DataFrame], hits) -> DataFrame:
    """``hits(slice)`` of every slice together; many slices are written some at a time."""
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    if len(slices) <= SLICES_A_TABLE:
        return union([hits(side) for side in slices])
    groups = [slices[i : i + SLICES_A_TABLE] for i in range(0, len(slices), SLICES_A_TABLE)]
    return union([materialize(union([hits(side) for side in group]), "hits") for group in groups])


def term_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(doc, in_title, term)`` for each text field that contains a term."""
    wide = T.exploded(texts, F.array_distinct(F.split("text", " ")), "anchor", "doc", "in_title", "text")

    def hits(side: DataFrame) -> DataFrame:
        found = wide.join(side, "anchor").where(T.phrase_present(F.col("text"), F.col("term")))
        return found.select("doc", "in_title", "term")

    return over_slices(anchored_slices(texts, terms), hits)


def phrase_match(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(entity, strategy, doc)`` with ``via_condition`` and ``via_title``.

    Conditions take terms of four characters, titles the strategy's minimum.
    """
    hits = term_hits(texts, terms)
    side, _ = broadcast_if_small(terms)
    floor = F.lit(MIN_CONDITION)
    for name, least in MIN_TITLE.items():
        floor = F.when(F.col("strategy") == name, least).otherwise(floor)
    return (
        hits.join(side, "term")
        .where(~F.col("in_title") | (F.length("term") >= floor))
        .groupBy("entity", "strategy", "doc")
        .agg(
            F.bool_or(~F.col("in_title")).alias("via_condition"),
            F.bool_or("in_title").alias("via_title"),
        )
    )


def classify_matches(matches: DataFrame) -> DataFrame:
    """One row per entity and document with the label of what matched."""
    flags = matches.groupBy("entity", "doc").agg(
        *[F.bool_or(F.col("strategy") == s).alias(s) for s in MIN_TITLE]
    )
    via = (
        F.when(F.col("phrase") & F.col("mesh"), "both")
        .when(F.col("phrase"), "phrase")
        .when(F.col("mesh"), "mesh")
        .otherwise("recall-expansion")
    )
    return flags.withColumn("matched_via", via)


def split_by_list(
    matches: DataFrame, listed: DataFrame, doc: str = "doc", listed_id: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """``(counted, umbrella)``: documents on the list are set apart."""
    key = F.upper(T.strip(doc))
    ids = listed.select(F.upper(T.strip(listed_id)).alias("_id")).distinct()
    keyed = matches.withColumn("_id", key)
    return (
        keyed.join(ids, "_id", "left_anti").drop("_id"),
        keyed.join(ids, "_id", "left_semi").drop("_id"),
    )


def umbrella_list(df: DataFrame) -> DataFrame:
    """The fixed list of umbrella studies."""
    return df.sparkSession.createDataFrame([(i,) for i in vocab.UMBRELLA_STUDIES], "id string")


def owned_terms(entities: DataFrame, code: str, terms: str, least: int = 5) -> DataFrame:
    """Distinct ``(term, code)`` with the number of owners of the term."""
    rows = (
        entities.select(code, F.explode(terms).alias("raw"))
        .select(code, T.normalize_term("raw").alias("term"))
        .where(F.length("term") >= least)
        .distinct()
    )
    owners = rows.groupBy("term").agg(F.count("*").alias("owners"))
    return rows.join(owners, "term")


def exact_term_match(
    owned: DataFrame,
    docs: DataFrame,
    code: str,
    doc: str,
    conditions: str,
    keywords: str,
    cap: int = 8,
    least: int = 5,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Normalised equality of owned terms with conditions, then keywords.

    ``carry`` names columns of the document that its matches keep, so that ``docs``
    is built and read once.

    Terms with more than ``cap`` owners are ambiguous and assign nothing (see
    ``ambiguous_terms``). One row per entity and document: a condition hit beats
    a keyword hit, earlier fields come first.
    """

    def listed(rank: int, via: str, column: str) -> Column:
        return F.transform(
            F.coalesce(F.col(column), F.array().cast("array<string>")),
            lambda v, i: F.struct(
                F.lit(rank).alias("rank"), i.alias("pos"), F.lit(via).alias("via"),
                v.alias("value"), T.normalize_term(v).alias("term"),
            ),
        )

    fields = F.concat(listed(0, "condition", conditions), listed(1, "keyword", keywords))
    rows = (
        docs.select(doc, *carry, F.explode(fields).alias("f"))
        .select(doc, *carry, "f.*")
        .where(F.length("term") >= least)
    )
    # Equal fields of one document count once, before anything is shuffled far.
    once = rows.groupBy(doc, *carry, "term").agg(F.min(F.struct("rank", "pos", "via", "value")).alias("f"))
    usable = owned.where(F.col("owners") <= cap).select("term", code)
    joined = once.join(usable, "term")
    best = F.min(F.struct("f.rank", "f.pos", "term", "f.via", "f.value"))
    return (
        joined.groupBy(code, doc, *carry)
        .agg(best.alias("b"))
        .select(code, doc, *carry, F.col("b.term").alias("term"), F.col("b.via").alias("via"), F.col("b.value").alias("value"))
    )


def ambiguous_terms(owned: DataFrame, cap: int = 8) -> DataFrame:
    """Terms dropped for having more than ``cap`` owners."""
    return owned.where(F.col("owners") > cap).select("term", "owners").distinct()


def parent_tier(parent_matches: DataFrame, own_matches: DataFrame) -> DataFrame:
    """Documents of the broader label that the entity does not count already."""
    own = own_matches.select("entity", "doc").distinct()
    return parent_matches.join(own, ["entity", "doc"], "left_anti")


def count_live(queries: DataFrame, texts: DataFrame, entity: str, query: str) -> DataFrame:
    """Documents matching any phrase of each stored query; zero when none."""
    terms = (
        queries.select(F.col(entity).alias("entity"), F.explode(T.split_query(query)).alias("term"))
        .distinct()
    )
    hits = term_hits(texts, terms)
    side, _ = broadcast_if_small(terms)
    counts = (
        hits.join(side, "term").select("entity", "doc").distinct()
        .groupBy("entity").agg(F.count("*").alias("live"))
    )
    return (
        queries.select(F.col(entity).alias("entity")).distinct()
        .join(counts, "entity", "left")
        .select("entity", F.coalesce("live", F.lit(0)).alias("live"))
    )
