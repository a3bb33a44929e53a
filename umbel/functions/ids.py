"""Identifier rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import C, col, normalize_term, strip


def normalize_curie(c: C, prefix: str = "MONDO") -> Column:
    """IRI, ``MONDO_1`` or ``MONDO:1`` to ``MONDO:0000001``; others upper-cased."""
    raw = strip(c)
    digits = F.regexp_extract(raw, rf"(?i){prefix}[_:](\d+)", 1)
    padded = F.concat(F.lit(f"{prefix}:"), F.lpad(digits, F.greatest(F.length(digits), F.lit(7)), "0"))
    return (
        F.when(digits != "", padded)
        .when(raw.rlike(r"^\d+$"), F.concat(F.lit(f"{prefix}:"), F.lpad(raw, F.greatest(F.length(raw), F.lit(7)), "0")))
        .otherwise(F.regexp_replace(F.upper(raw), "^([^_:]+)_", "$1:"))
    )


def canonical_id(c: C) -> Column:
    return F.regexp_replace(F.upper(strip(c)), r"\s+", "")


def first_nct(*cols: C) -> Column:
    """First study id of the main registry over the columns in order."""
    hits = [F.upper(F.regexp_extract(col(c), vocab.REGISTRY_ID_PATTERNS[0], 0)) for c in cols]
    return F.coalesce(*[F.when(h != "", h) for h in hits])


def secondary_ids(*cols: C) -> Column:
    """All registry ids in the columns, canonical, distinct, in pattern order."""
    found = [
        F.coalesce(F.regexp_extract_all(col(c), F.lit(p), F.lit(0)), F.array().cast("array<string>"))
        for c in cols
        for p in vocab.REGISTRY_ID_PATTERNS
    ]
    return F.array_distinct(F.transform(F.concat(*found), canonical_id))


def infer_registry(c: C) -> Column:
    key = canonical_id(c)
    ladder = reduce(
        lambda w, kv: w.when(key.startswith(kv[0]), kv[1]),
        list(vocab.REGISTRY_PREFIXES.items())[1:],
        F.when(key.startswith("NCT"), vocab.REGISTRY_PREFIXES["NCT"]),
    )
    return ladder.when(key.rlike(r"^\d{4}-\d{6}-\d{2}"), "euctr").otherwise("other")


def title_fingerprint(c: C, tokens: int | None = None) -> Column:
    """Tokens longer than two characters: all of them, or the first ``tokens``.

    A prefix makes titles one that differ further on, so it is the caller's choice.
    """
    words = F.filter(F.split(normalize_term(c), " "), lambda t: F.length(t) > 2)
    return F.array_join(words if tokens is None else F.slice(words, 1, tokens), " ")


def xref_bucket(c: C) -> Column:
    """Bucket name of a cross-reference, null when its prefix is not kept."""
    prefix = F.upper(strip(F.substring_index(col(c), ":", 1)))
    return (
        F.when(prefix.isin("MESH", "MSH"), "mesh")
        .when(prefix == "UMLS", "umls")
        .when(prefix.isin("OMIM", "MIM"), "omim")
        .when(prefix == "NCIT", "ncit")
    )


def xref_value(c: C) -> Column:
    return strip(F.regexp_extract(col(c), "^[^:]*:(.*)$", 1))
