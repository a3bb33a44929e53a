"""SQL fragments that state the text rules, for the checks."""

from __future__ import annotations

from ..functions import vocab


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


def content(x: str) -> str:
    return (
        f"list_filter(string_split({norm(x)}, ' '), "
        f"lambda t: length(t) >= 5 AND t NOT IN {in_list(vocab.COMMON_WORDS)})"
    )


def matches(x: str, rx: str) -> str:
    return f"regexp_matches({x}, {q(rx)})"


def stop_reason(t: str) -> str:
    return f"""CASE WHEN length({t}) < 5 THEN 'too-short'
      WHEN {matches(t, vocab.BARE_CODE)} AND length(regexp_replace({t}, '[^A-Za-z0-9]', '', 'g')) < 4 THEN 'bare-acronym'
      WHEN lower({t}) IN {in_list(vocab.COMMON_WORDS)} THEN 'common-word'
      WHEN {matches(t, vocab.NUMERIC_PREFIX_LETTER)} OR {matches(t, vocab.LETTER_SEP_LETTER)}
        THEN 'numeric-letter' END"""


def blocked(t: str) -> str:
    return f"({t} IN {in_list(vocab.HIGH_VOLUME_TOKENS + vocab.PHENOTYPE_TOKENS + vocab.ORGAN_TOKENS + vocab.COMMON_WORDS)})"


def generic(x: str) -> str:
    c = content(x)
    return f"""(length({norm(x)}) < 5 OR {matches(x, vocab.GENERIC_LABEL)} OR {matches(norm(x), vocab.GENERIC_LABEL)}
      OR {matches(x, '(?i)multiple congenital anomalies')}
      OR ({matches(x, '(?i)intellectual disability')} AND len({c}) <= 3) OR len({c}) = 0
      OR (len({c}) = 1 AND {matches(x, '(?i)\\b(disease|disorder|syndrome|condition)$')} AND {blocked(c + '[1]')}))"""


def scaffold(x: str) -> str:
    return matches(x, vocab.SCAFFOLD_LABEL)


def contains(h: str, n: str) -> str:
    return f"contains(' ' || {h} || ' ', ' ' || {n} || ' ')"


def name_parent(name: str, cand: str) -> str:
    return f"(length({norm(cand)}) >= 5 AND {norm(name)} <> {norm(cand)} AND {contains(norm(name), norm(cand))})"


def shares_signal(name: str, label: str) -> str:
    return f"(NOT {name_parent(name, label)} AND list_has_any({content(name)}, {content(label)}))"


def frequent_gene(x: str) -> str:
    return f"(upper({x}) IN {in_list(vocab.FREQUENT_GENES)})"


def safe_recall(t: str) -> str:
    c, w = content(t), words(t)
    return f"""CASE WHEN {t} = '' OR {frequent_gene(t)} THEN false
      WHEN {scaffold(t)} OR {generic(t)} THEN false
      WHEN len({c}) >= 2 THEN length({t}) >= 20
      WHEN len({c}) = 1 AND len({w}) = 2 THEN NOT {blocked(c + '[1]')}
      WHEN len({w}) <> 1 THEN false
      ELSE length({w}[1]) >= 12 AND NOT {blocked(w + '[1]')} END"""


def fingerprint(x: str, tokens: int | None = None) -> str:
    cut = "" if tokens is None else f"[1:{tokens}]"
    return f"array_to_string(list_filter(string_split({norm(x)}, ' '), lambda t: length(t) > 2){cut}, ' ')"
