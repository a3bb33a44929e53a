"""Text and term rules as Column expressions.

Arrays here are the names of one entity, so folds stay inside a row and need no
shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab

C = str | Column


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: C) -> Column:
    return F.btrim(col(c), F.lit(" \t\n\r\f\v "))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def exploded(df: DataFrame, array: Column, name: str, *others: C) -> DataFrame:
    """``others`` and each value of ``array`` that is not null.

    A plain ``explode`` makes Spark filter by the size of the array first, and a costly
    array is then computed once more for that.
    """
    return df.select(*others, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def words_literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def normalize_term(c: C) -> Column:
    """Lower case; every run outside a-z and 0-9 becomes one space."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def _accent_table() -> tuple[str, str]:
    """Latin letters that decompose to one plain letter plus marks."""
    src, dst = [], []
    for point in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) > 1 and parts[0].isascii() and parts[0].islower():
            src.append(chr(point))
            dst.append(parts[0])
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def fold_label(c: C) -> Column:
    """``normalize_term`` after dropping diacritics."""
    bare = F.translate(F.lower(col(c)), _ACCENTED, _PLAIN)
    return normalize_term(F.regexp_replace(bare, "[̀-ͯ]", ""))


def tokens(c: C) -> Column:
    return F.filter(F.split(normalize_term(c), " "), lambda t: t != "")


def distinct_by(arr: C, key: Callable[[Column], Column]) -> Column:
    """First spelling of each key, order kept; empty keys dropped."""
    keyed = F.transform(col(arr), lambda t: F.struct(key(t).alias("k"), strip(t).alias("t")))
    empty = F.array().cast("array<struct<k:string,t:string>>")
    return F.aggregate(
        keyed,
        empty,
        lambda acc, x: F.when(
            (x["k"] == "") | x["k"].isNull() | F.exists(acc, lambda a: a["k"] == x["k"]), acc
        ).otherwise(F.concat(acc, F.array(x))),
        lambda acc: F.transform(acc, lambda a: a["t"]),
    )


def unique_terms(arr: C) -> Column:
    return distinct_by(arr, normalize_term)


def unique_lower(arr: C) -> Column:
    return distinct_by(arr, lambda t: F.lower(strip(t)))


# ---- single-term rules -------------------------------------------------------


def stop_reason(term: C) -> Column:
    """Why a term is too weak to search for; null when it is kept."""
    t = strip(term)
    weak_code = t.rlike(vocab.BARE_CODE) & (
        F.length(F.regexp_replace(t, "[^A-Za-z0-9]", "")) < 4
    )
    return (
        F.when(F.length(t) < 5, "too-short")
        .when(weak_code, "bare-acronym")
        .when(F.lower(t).isin(vocab.COMMON_WORDS), "common-word")
        .when(
            t.rlike(vocab.NUMERIC_PREFIX_LETTER) | t.rlike(vocab.LETTER_SEP_LETTER),
            "numeric-letter",
        )
    )


def is_ontology_speak(c: C) -> Column:
    return col(c).rlike(vocab.SCAFFOLD_LABEL)


def article_variants(c: C) -> Column:
    """``of the x`` gives ``of x`` too, and the other way round."""
    t = strip(c)
    other = F.when(
        t.rlike(r"(?i)\bof the\b"), F.regexp_replace(t, r"(?i)\bof the\b", "of")
    ).when(t.rlike(r"(?i)\bof [a-z]"), F.regexp_replace(t, r"(?i)\bof ([a-z])", "of the $1"))
    return unique_terms(F.array_compact(F.array(t, other)))


def content_tokens(c: C) -> Column:
    return F.filter(
        F.split(normalize_term(c), " "),
        lambda t: (F.length(t) >= 5) & ~t.isin(vocab.COMMON_WORDS),
    )


def strip_qualifiers(c: C) -> Column:
    """Zero or one alias without its leading clinical qualifier."""
    rest = strip(F.regexp_extract(col(c), vocab.LEADING_QUALIFIER, 1))
    return F.when(F.length(rest) >= 5, F.array(rest)).otherwise(F.array().cast("array<string>"))


def is_blocked_token(t: Column) -> Column:
    return t.isin(
        vocab.HIGH_VOLUME_TOKENS + vocab.PHENOTYPE_TOKENS + vocab.ORGAN_TOKENS + vocab.COMMON_WORDS
    )


def is_generic_label(c: C) -> Column:
    """Umbrella labels that would match very many documents."""
    parts = F.struct(
        strip(c).alias("label"), normalize_term(c).alias("norm"), content_tokens(c).alias("content")
    )

    def judge(v: Column) -> Column:
        label, norm, content = v["label"], v["norm"], v["content"]
        organ_head = (
            (F.size(content) == 1)
            & label.rlike(r"(?i)\b(disease|disorder|syndrome|condition)$")
            & is_blocked_token(F.get(content, F.lit(0)))
        )
        return any_of(
            [
                F.length(norm) < 5,
                label.rlike(vocab.GENERIC_LABEL),
                norm.rlike(vocab.GENERIC_LABEL),
                label.rlike("(?i)multiple congenital anomalies"),
                label.rlike("(?i)intellectual disability") & (F.size(content) <= 3),
                F.size(content) == 0,
                F.coalesce(organ_head, F.lit(False)),
            ]
        )

    return let(parts, judge)


def phrase_present(haystack: Column, needle: Column) -> Column:
    """Containment on token boundaries; both sides already normalised."""
    sp = F.lit(" ")
    return F.concat(sp, haystack, sp).contains(F.concat(sp, needle, sp))


def is_name_parent(name: C, candidate: C) -> Column:
    n, k = normalize_term(name), normalize_term(candidate)
    return (F.length(k) >= 5) & (n != k) & phrase_present(n, k)


def shares_signal(name: C, label: C) -> Column:
    return ~is_name_parent(name, label) & F.arrays_overlap(
        content_tokens(name), content_tokens(label)
    )


def cap_genes(arr: C) -> Column:
    usable = F.filter(
        F.transform(col(arr), strip),
        lambda g: (F.length(g) >= 2) & ~F.upper(g).isin(vocab.FREQUENT_GENES),
    )
    return F.slice(unique_terms(usable), 1, 3)


def is_safe_recall(term: C, genes: C | None = None) -> Column:
    """Ordered rules that admit a term into the recall expansion."""
    parts = F.struct(
        strip(term).alias("t"), content_tokens(term).alias("content"), tokens(term).alias("plain")
    )

    def judge(v: Column) -> Column:
        t, content, plain = v["t"], v["content"], v["plain"]
        lone, first = F.get(plain, F.lit(0)), F.get(content, F.lit(0))
        is_gene = F.lit(False)
        if genes is not None:
            is_gene = F.exists(col(genes), lambda g: F.upper(g) == F.upper(t))
        return (
            F.when((t == "") | F.upper(t).isin(vocab.FREQUENT_GENES), False)
            .when(is_gene, True)
            .when(is_ontology_speak(t) | is_generic_label(t), False)
            .when(F.size(content) >= 2, F.length(t) >= 20)
            .when((F.size(content) == 1) & (F.size(plain) == 2), ~is_blocked_token(first))
            .when(F.size(plain) != 1, False)
            .otherwise((F.length(lone) >= 12) & ~is_blocked_token(lone))
        )

    return let(parts, judge)


def infer_genes(name: C) -> Column:
    n = col(name)
    symbol = r"([A-Z][A-Z0-9]{1,14}(?:-[A-Z0-9]{1,8})?)"
    related = F.regexp_extract(n, rf"\b{symbol}-related\b", 1)
    leading = F.regexp_extract(n, rf"^{symbol}(?:\s|,|:|/)", 1)
    leading = F.when(~leading.rlike("(?i)^(ORPHA|OMIM|MESH|MONDO)$"), leading).otherwise("")
    return F.filter(
        unique_terms(F.array(related, leading)),
        lambda g: ~F.upper(g).isin(vocab.FREQUENT_GENES),
    )


def has_encoding_damage(c: C) -> Column:
    return col(c).rlike(vocab.MOJIBAKE)


# ---- term lists of one entity ------------------------------------------------


def stoplist_split(arr: C) -> Column:
    """``struct(kept, dropped array<struct<term, reason>>)`` over distinct terms."""
    judged = F.transform(
        unique_lower(arr), lambda t: F.struct(t.alias("term"), stop_reason(t).alias("reason"))
    )

    def split(rows: Column) -> Column:
        kept = F.filter(rows, lambda x: x["reason"].isNull())
        return F.struct(
            F.transform(kept, lambda x: x["term"]).alias("kept"),
            F.filter(rows, lambda x: x["reason"].isNotNull()).alias("dropped"),
        )

    return let(judged, split)


def kept_terms(label: C, synonyms: C) -> Column:
    """Stoplist over label and synonyms; the label itself always stays."""
    lab = strip(label)

    def with_label(both: Column) -> Column:
        present = F.exists(both["kept"], lambda k: F.lower(k) == F.lower(lab)) | (lab == "")
        kept = F.when(present, both["kept"]).otherwise(F.concat(F.array(lab), both["kept"]))
        return F.struct(kept.alias("kept"), both["dropped"].alias("dropped"))

    return let(stoplist_split(F.concat(F.array(lab), col(synonyms))), with_label)


def or_query(arr: C) -> Column:
    """Quoted terms joined with OR."""
    return F.array_join(
        F.transform(
            col(arr), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit("")), F.lit('"'))
        ),
        " OR ",
    )


def label_query(arr: C, tag: str = "MESH") -> Column:
    """Labelled form of ``or_query`` over distinct labels."""
    bare = F.transform(col(arr), lambda t: F.replace(t, F.lit('"'), F.lit("")))
    return F.array_join(
        F.transform(unique_lower(bare), lambda t: F.concat(F.lit(f'{tag}:"'), t, F.lit('"'))),
        " OR ",
    )


def split_query(q: C) -> Column:
    """Phrases of a stored OR query, normalised, at least four characters."""
    parts = F.transform(F.split(col(q), r"(?i)\s+OR\s+"), normalize_term)
    return F.filter(parts, lambda p: F.length(p) >= 4)


def phrase_terms(names: C, synonyms: C, cap: int = 40) -> Column:
    """``struct(terms, dropped)``: names first, article variants added, capped.

    Everything beyond the cap is listed under ``dropped`` with its reason.
    """
    names, synonyms = col(names), col(synonyms)
    clean = F.filter(synonyms, lambda s: ~is_ontology_speak(s))
    scaffold = F.filter(synonyms, lambda s: is_ontology_speak(s))
    rest = F.concat(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), clean)

    def because(terms: Column, why: str) -> Column:
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(why).alias("reason")))

    def widen(judged: Column) -> Column:
        variants = F.transform(F.concat(names, judged["kept"]), lambda t: article_variants(t))
        return F.struct(unique_lower(F.flatten(variants)).alias("wide"), judged["dropped"].alias("dropped"))

    def cut(v: Column) -> Column:
        wide = v["wide"]
        over = F.slice(wide, cap + 1, F.greatest(F.size(wide) - cap, F.lit(0)))
        return F.struct(
            F.slice(wide, 1, cap).alias("terms"),
            F.concat(
                v["dropped"],
                because(scaffold, "scaffold-synonym"),
                because(over, "over-cap"),
            ).alias("dropped"),
        )

    return let(let(kept_terms(F.get(names, F.lit(0)), rest), widen), cut)


def pack_chunks(arr: C, budget: int = 900) -> Column:
    """Greedy packing of quoted terms into chunks by their joined length."""
    bare = F.filter(
        F.transform(col(arr), lambda t: F.replace(strip(t), F.lit('"'), F.lit(""))),
        lambda t: t != "",
    )
    state = "struct<done:array<array<string>>,cur:array<string>,len:int>"
    start = F.struct(
        F.array().cast("array<array<string>>").alias("done"),
        F.array().cast("array<string>").alias("cur"),
        F.lit(0).alias("len"),
    ).cast(state)

    def step(acc: Column, t: Column) -> Column:
        piece = F.length(t) + 2
        grown = acc["len"] + piece + F.when(F.size(acc["cur"]) > 0, 4).otherwise(0)
        full = (F.size(acc["cur"]) > 0) & (grown > budget)
        return F.when(
            full,
            F.struct(
                F.concat(acc["done"], F.array(acc["cur"])).alias("done"),
                F.array(t).alias("cur"),
                piece.alias("len"),
            ),
        ).otherwise(
            F.struct(
                acc["done"].alias("done"),
                F.concat(acc["cur"], F.array(t)).alias("cur"),
                grown.alias("len"),
            )
        )

    return F.aggregate(bare, start, step, lambda a: F.concat(a["done"], F.array(a["cur"])))


def recall_terms(name: C, synonyms: C, aliases: C | None = None) -> Column:
    """Manual aliases and the shortest usable synonym, where safe."""
    name = col(name)
    ok = F.filter(
        F.transform(col(synonyms), strip),
        lambda s: F.length(s).between(5, 100)
        & ~is_ontology_speak(s)
        & ~is_generic_label(s)
        & ~is_name_parent(name, s),
    )
    ranked = F.array_sort(
        F.transform(ok, lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i"), s.alias("s")))
    )
    shortest = F.slice(F.transform(ranked, lambda r: r["s"]), 1, 1)
    manual = F.array().cast("array<string>") if aliases is None else col(aliases)
    manual = F.filter(manual, lambda a: ~is_name_parent(name, a))
    return F.filter(unique_terms(F.concat(manual, shortest)), lambda t: is_safe_recall(t))


def publication_terms(name: C, genes: C) -> Column:
    """Gene symbols of four letters or more and their usual phrasings."""
    capped = cap_genes(F.concat(col(genes), infer_genes(name)))
    shaped = F.transform(
        capped,
        lambda g: F.array(
            F.when(F.length(g) >= 4, g).otherwise(""),
            F.concat(g, F.lit(" syndrome")),
            F.concat(g, F.lit("-related")),
        ),
    )
    return unique_terms(F.flatten(shaped))


def novel_terms(base: C, extra: C) -> Column:
    known = F.transform(col(base), normalize_term)
    return F.filter(col(extra), lambda t: ~F.array_contains(known, normalize_term(t)))


def display_key(c: C, collation: str | None = "UNICODE") -> Column:
    """Sort key for people: accents and case beside their plain letters; bytes without a collation."""
    return F.collate(col(c), collation) if collation else col(c)
