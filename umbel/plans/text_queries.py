"""Text, term and identifier rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..functions import vocab
from ..operators import defects, name_index, tagging, terms, vocabulary
from ..runtime import scratch_path
from . import sqltext as S
from .registry import query
from .tables import ENTITIES_SQL, entities, load, sentences

JOINED = lambda c: F.array_join(c, " | ")


@query("normalize_term", f"SELECT doc_id, md5({S.norm('text')}) AS h, length({S.norm('text')}) AS n FROM documents")
def _(spark, sf):
    n = T.normalize_term("text")
    return load(spark, sf, "documents").select("doc_id", F.md5(n).alias("h"), F.length(n).alias("n"))


@query("fold_label", f"SELECT doc_id, md5({S.norm('strip_accents(lower(text))')}) AS h FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(T.fold_label("text")).alias("h"))


@query("unique_terms", f"""
WITH t AS (SELECT p_partkey, unnest([p_name, p_brand, upper(p_name), p_type, p_name || '!', lower(p_type)]) AS s,
                  unnest([1, 2, 3, 4, 5, 6]) AS pos FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, {S.norm('s')} ORDER BY pos) AS rn FROM t)
SELECT p_partkey, string_agg(s, ' | ' ORDER BY pos) AS terms FROM k WHERE rn = 1 GROUP BY p_partkey""")
def _(spark, sf):
    arr = F.array("p_name", "p_brand", F.upper("p_name"), "p_type", F.concat("p_name", F.lit("!")), F.lower("p_type"))
    return load(spark, sf, "part").select("p_partkey", JOINED(T.unique_terms(arr)).alias("terms"))


@query("stoplist", f"""
WITH {ENTITIES_SQL}, t AS (SELECT DISTINCT code, unnest(list_concat([name], synonyms)) AS term FROM entities)
SELECT code, term, {S.stop_reason('term')} AS reason FROM t""")
def _(spark, sf):
    return terms.apply_stoplist(entities(spark, sf), "code", "name", "synonyms")


@query("stoplist_words", f"""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS t FROM documents)
SELECT coalesce({S.stop_reason('t')}, 'kept') AS reason, count(*) AS n FROM w WHERE t <> '' GROUP BY 1""")
def _(spark, sf):
    words = (
        load(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("t")).where("t != ''").distinct()
    )
    return words.groupBy(F.coalesce(T.stop_reason("t"), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("kept_terms", f"""
WITH {ENTITIES_SQL}
SELECT code, name || ' | ' || array_to_string(list_filter(synonyms, lambda s: ({S.stop_reason('s')}) IS NULL), ' | ') AS kept,
  len(list_filter(synonyms, lambda s: ({S.stop_reason('s')}) IS NOT NULL)) AS dropped,
  array_to_string(list_transform(list_concat([name], list_filter(synonyms, lambda s: ({S.stop_reason('s')}) IS NULL)),
     lambda s: '"' || s || '"'), ' OR ') AS query
FROM entities""")
def _(spark, sf):
    k = entities(spark, sf).select("code", T.kept_terms("name", "synonyms").alias("k"))
    return k.select(
        "code", JOINED("k.kept").alias("kept"), F.size("k.dropped").alias("dropped"), T.or_query("k.kept").alias("query")
    )


@query("phrase_terms", """
WITH v AS (SELECT p_partkey, p_name || ' of ' || p_type AS n, p_name || ' of the ' || p_type || ' kind' AS s1, p_brand AS s2 FROM part)
SELECT p_partkey, array_to_string([n, regexp_replace(n, '(?i)\\bof ([a-z])', 'of the \\1', 'g'), s1,
    regexp_replace(s1, '(?i)\\bof the\\b', 'of', 'g'), s2], ' | ') AS terms, 1 AS dropped FROM v""")
def _(spark, sf):
    p = load(spark, sf, "part").select(
        "p_partkey",
        F.array(F.concat_ws(" of ", "p_name", "p_type")).alias("names"),
        F.array(
            F.concat(F.col("p_name"), F.lit(" of the "), F.col("p_type"), F.lit(" kind")),
            F.col("p_brand"),
            F.concat(F.col("p_type"), F.lit(" caused disease or disorder")),
        ).alias("synonyms"),
    )
    kept, dropped = terms.phrase_term_rows(p, "p_partkey", "names", "synonyms")
    joined = kept.groupBy("p_partkey").agg(
        JOINED(F.array_sort(F.collect_list(F.struct("pos", "term")))["term"]).alias("terms")
    )
    return joined.join(dropped.groupBy("p_partkey").agg(F.count("*").cast("int").alias("dropped")), "p_partkey")


@query("pack_chunks", """
WITH RECURSIVE t AS (
  SELECT item_id, s, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS i FROM (
    SELECT item_id, trim(unnest(l), ' ' || chr(9) || chr(10)) AS s, unnest(range(len(l))) AS pos
    FROM (SELECT item_id, regexp_split_to_array(text, '[,.]') AS l FROM benchmark)) WHERE s <> ''),
f AS (SELECT item_id, i, 1 AS chunk, length(s) + 2 AS n FROM t WHERE i = 1
  UNION ALL
  SELECT t.item_id, t.i, CASE WHEN n + length(s) + 6 > 100 THEN chunk + 1 ELSE chunk END,
    CASE WHEN n + length(s) + 6 > 100 THEN length(s) + 2 ELSE n + length(s) + 6 END
  FROM f JOIN t ON t.item_id = f.item_id AND t.i = f.i + 1)
SELECT item_id, max(chunk) AS chunks, count(*) AS terms, max(n) AS longest FROM f GROUP BY item_id""")
def _(spark, sf):
    b = load(spark, sf, "benchmark").select("item_id", T.pack_chunks(F.split("text", "[,.]"), 100).alias("c"))
    lengths = F.transform("c", lambda ch: F.length(T.or_query(ch)))
    return b.select(
        "item_id", F.size("c").alias("chunks"), F.size(F.flatten("c")).alias("terms"), F.array_max(lengths).alias("longest")
    )


@query("stored_queries", f"""
SELECT p_partkey, '"' || p_name || '" OR "' || p_brand || '" OR "a b"' AS query,
  'MESH:"' || p_name || '" OR MESH:"' || p_type || '"' AS labelled,
  {S.norm('p_name')} || ' | ' || {S.norm('p_brand')} AS phrases FROM part""")
def _(spark, sf):
    p = load(spark, sf, "part").select(
        "p_partkey", T.or_query(F.array("p_name", "p_brand", F.lit("a b"))).alias("query"),
        T.label_query(F.array("p_name", F.upper("p_name"), "p_type")).alias("labelled"),
    )
    return p.withColumn("phrases", JOINED(T.split_query("query")))


@query("content_tokens", f"SELECT doc_id, len({S.content('text')}) AS n, md5(array_to_string({S.content('text')}, ' ')) AS h FROM documents")
def _(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", T.content_tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("h"))


def _labels(spark, sf):
    """Labels of every rule branch, made from each part's own words."""
    size, n, ty = F.col("p_size"), F.col("p_name"), F.col("p_type")
    lit = F.lit
    label = (
        F.when(size % 8 == 0, F.concat(lit("inborn "), n, lit(" activity")))
        .when(size % 8 == 1, F.concat(ty, lit(" caused disease or disorder")))
        .when(size % 8 == 2, F.concat(lit("heart "), F.when(size > 25, "disease").otherwise("disorder")))
        .when(size % 8 == 3, F.concat(ty, lit(" syndrome")))
        .when(size % 8 == 4, F.concat(lit("multiple congenital anomalies "), ty))
        .when(size % 8 == 5, F.concat(lit("congenital "), n, lit(" "), ty))
        .when(size % 8 == 6, F.concat(F.lower(ty), F.lower(F.replace(n, lit(" "), lit("")))))
        .otherwise(n)
    )
    return load(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand", label.alias("label"))


LABELS_SQL = """lab AS (SELECT p_partkey, p_name, p_type, p_size, p_brand, CASE p_size % 8
  WHEN 0 THEN 'inborn ' || p_name || ' activity' WHEN 1 THEN p_type || ' caused disease or disorder'
  WHEN 2 THEN 'heart ' || CASE WHEN p_size > 25 THEN 'disease' ELSE 'disorder' END
  WHEN 3 THEN p_type || ' syndrome' WHEN 4 THEN 'multiple congenital anomalies ' || p_type
  WHEN 5 THEN 'congenital ' || p_name || ' ' || p_type
  WHEN 6 THEN lower(p_type) || lower(replace(p_name, ' ', '')) ELSE p_name END AS label FROM part)"""


@query("label_rules", f"""
WITH {LABELS_SQL}
SELECT p_partkey, label, {S.scaffold('label')} AS scaffold, {S.generic('label')} AS generic_label, {S.safe_recall('label')} AS safe,
  CASE WHEN p_size % 8 = 5 THEN p_name || ' ' || p_type ELSE '' END AS stripped FROM lab""")
def _(spark, sf):
    return _labels(spark, sf).select(
        "p_partkey", "label", T.is_ontology_speak("label").alias("scaffold"), T.is_generic_label("label").alias("generic_label"),
        T.is_safe_recall("label").alias("safe"), F.array_join(T.strip_qualifiers("label"), "|").alias("stripped"),
    )


@query("label_relations", f"""
WITH {LABELS_SQL}
SELECT a.p_partkey, {S.name_parent('a.label', 'b.p_name')} AS parent, {S.shares_signal('a.label', 'b.label')} AS signal
FROM lab a JOIN lab b ON b.p_partkey = a.p_partkey + 1""")
def _(spark, sf):
    a = _labels(spark, sf)
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"), F.col("label").alias("other_label"))
    return a.join(b, "p_partkey").select(
        "p_partkey", T.is_name_parent("label", "other").alias("parent"), T.shares_signal("label", "other_label").alias("signal")
    )


_OKSYN = f"length(s) BETWEEN 5 AND 100 AND NOT {S.scaffold('s')} AND NOT {S.generic('s')} AND NOT {S.name_parent('label', 's')}"


@query("recall_terms", f"""
WITH {LABELS_SQL}, syn AS (SELECT p_partkey, label, unnest([p_name, p_brand || ' ' || p_name || ' extended', lower(p_type) || lower(replace(p_name, ' ', ''))]) AS s,
    unnest([1, 2, 3]) AS pos FROM lab),
best AS (SELECT p_partkey, arg_min(s, length(s) * 10 + pos) AS s FROM syn WHERE {_OKSYN} GROUP BY p_partkey)
SELECT p_partkey, s AS recall FROM best WHERE {S.safe_recall('s')}""")
def _(spark, sf):
    syn = F.array(
        "p_name", F.concat_ws(" ", "p_brand", "p_name", F.lit("extended")),
        F.concat(F.lower("p_type"), F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit("")))),
    )
    return T.exploded(_labels(spark, sf), T.recall_terms("label", syn), "recall", "p_partkey")


@query("gene_terms", """
WITH g AS (SELECT p_partkey, p_type, upper(split_part(p_name, ' ', 1)) AS w FROM part),
t AS (SELECT p_partkey, p_type, p_type || ' | ' || p_type || ' syndrome | ' || p_type || '-related' AS first,
  CASE WHEN w = p_type THEN '' ELSE CASE WHEN length(w) >= 4 THEN ' | ' || w ELSE '' END
    || ' | ' || w || ' syndrome | ' || w || '-related' END AS second FROM g)
SELECT p_partkey, p_type AS inferred, first || second AS terms FROM t""")
def _(spark, sf):
    name = F.concat("p_type", F.lit("-related "), "p_name")
    genes = F.array("p_type", F.lit("KRAS"), F.upper(F.substring_index("p_name", " ", 1)))
    return load(spark, sf, "part").select(
        "p_partkey", JOINED(T.infer_genes(name)).alias("inferred"), JOINED(T.publication_terms(name, genes)).alias("terms")
    )


@query("novel_terms", """
SELECT p_partkey, p_brand || ' | ' || p_type || ' x' AS novel FROM part""")
def _(spark, sf):
    extra = F.array(F.upper("p_name"), "p_brand", F.lower("p_type"), F.concat("p_type", F.lit(" x")))
    return load(spark, sf, "part").select("p_partkey", JOINED(T.novel_terms(F.array("p_name", "p_type"), extra)).alias("novel"))


@query("token_frequency", """
WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM documents)
SELECT token, count(*) AS freq, length(token) AS len FROM w WHERE token <> '' GROUP BY token""")
def _(spark, sf):
    return vocabulary.token_frequency(load(spark, sf, "documents"), ["text"])


@query("token_frequency_alnum", f"""
WITH w AS (SELECT unnest(string_split({S.norm('text')}, ' ')) AS token FROM documents)
SELECT token, count(*) AS freq, length(token) AS len FROM w WHERE token <> '' GROUP BY token""")
def _(spark, sf):
    return vocabulary.token_frequency(load(spark, sf, "documents"), ["text"], "alnum")


@query("misspelling_candidates", """
WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM documents),
f AS (SELECT token, count(*) AS freq, length(token) AS len FROM w WHERE token <> '' GROUP BY token),
r AS (SELECT *, CASE WHEN len >= 9 THEN 2 ELSE 1 END AS cap FROM f WHERE len >= 6 AND freq <= 2),
p AS (SELECT r.token, r.freq, c.token AS neighbour, c.freq AS nfreq, c.len AS nlen, levenshtein(r.token, c.token) AS dist, cap
  FROM r JOIN f c ON substr(r.token, 1, 1) = substr(c.token, 1, 1) AND c.freq >= greatest(8, 4 * r.freq)
    AND c.len BETWEEN r.len - cap AND r.len + cap AND c.token <> r.token)
SELECT token, freq, neighbour, nfreq, dist FROM p WHERE dist BETWEEN 1 AND cap
QUALIFY row_number() OVER (PARTITION BY token ORDER BY dist, nfreq DESC, nlen, neighbour) = 1""")
def _(spark, sf):
    freq = vocabulary.token_frequency(load(spark, sf, "documents"), ["text"])
    return vocabulary.misspelling_candidates(freq, freq)


@query("split_glued_tokens", """
WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS token FROM part),
f AS (SELECT token FROM w GROUP BY token HAVING count(*) >= 8 AND length(token) >= 3)
SELECT CAST(p_partkey AS VARCHAR) AS code, replace(p_name, ' ', '') || '  ' || p_brand AS original, p_name || '  ' || p_brand AS corrected
FROM part WHERE split_part(p_name, ' ', 1) IN (SELECT token FROM f) AND split_part(p_name, ' ', 2) IN (SELECT token FROM f)""")
def _(spark, sf):
    p = load(spark, sf, "part")
    freq = vocabulary.token_frequency(p, ["p_name"])
    names = p.select(
        F.col("p_partkey").cast("string").alias("code"),
        F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("")), F.lit("  "), "p_brand").alias("name"),
    )
    return vocabulary.split_glued_tokens(names, freq)


@query("merge_corrections", f"""
WITH {ENTITIES_SQL}
SELECT code, name AS original, CASE WHEN p_size % 2 = 0 THEN p_name || ' prior' ELSE name_corrected END AS corrected, true AS applied
FROM entities WHERE name_corrected IS NOT NULL""")
def _(spark, sf):
    e = entities(spark, sf)
    prior = e.where(F.col("name_corrected").isNotNull() & (F.size("tried") == 2)).select(
        "code", F.col("name").alias("original"), F.concat("probe_label", F.lit(" prior")).alias("corrected"),
        F.lit("missing-boundary").alias("type"), F.lit("").alias("detail"), F.lit(True).alias("applied"),
    )
    return terms.merge_corrections(prior, e).select("code", "original", "corrected", "applied")


@query("encoding_damage", f"SELECT doc_id, regexp_matches(text, '{vocab.MOJIBAKE}') AS damaged FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.has_encoding_damage("text").alias("damaged"))


_PATTERNS = {"widget": r"(?i)\bwidget\b", "economy": r"(?i)econ", "brand-one": r"(?i)brand#1\b", "colour": r"(?i)^(red|blue) "}
_HITS_SQL = "WITH h AS (" + " UNION ALL ".join(
    f"""SELECT p_partkey AS code, {S.q(n)} AS pattern, CASE WHEN {S.matches('p_name', rx)} THEN 'Name' ELSE 'Synonym' END AS field,
      CASE WHEN {S.matches('p_name', rx)} THEN p_name WHEN {S.matches('p_brand', rx)} THEN p_brand ELSE p_type END AS label
      FROM part WHERE {S.matches('p_name', rx)} OR {S.matches('p_brand', rx)} OR {S.matches('p_type', rx)}"""
    for n, rx in _PATTERNS.items()
) + ")"


def _label_hits(spark, sf):
    p = load(spark, sf, "part").withColumn("synonyms", F.array("p_brand", "p_type"))
    return defects.label_hits(p, "p_partkey", "p_name", "synonyms", _PATTERNS)


@query("label_defect_scan", f"{_HITS_SQL} SELECT pattern, count(*) FILTER (WHERE field = 'Name') AS in_name, count(*) AS in_any FROM h GROUP BY pattern")
def _(spark, sf):
    return defects.label_defect_scan(_label_hits(spark, sf))


@query("label_defect_examples", f"""{_HITS_SQL}
SELECT pattern, code, field, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY code) AS rank FROM h) WHERE rank <= 15""")
def _(spark, sf):
    return defects.defect_examples(_label_hits(spark, sf))


# Names with the defects that are looked for, in the name or in a synonym.
_PLANT = {0: " gallblader", 1: " Haploinsuffiency", 2: " choreathetosis type", 3: " cornealdystrophy", 4: " chondrodystrophy", 5: " microcephalicdwarfism"}
_PLANT_SQL = "CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN {S.q(v)}" for k, v in _PLANT.items()) + " ELSE '' END"
_FIXED_SQL = f"WITH n AS (SELECT p_partkey AS code, p_name || CASE WHEN p_partkey % 2 = 0 THEN {_PLANT_SQL} ELSE '' END AS name, p_type || {_PLANT_SQL} AS syn FROM part), h AS (" + " UNION ALL ".join(
    f"""SELECT code, {S.q(n)} AS pattern, CASE WHEN {S.matches('name', rx)} THEN 'Name' ELSE 'Synonym' END AS field, CASE WHEN {S.matches('name', rx)} THEN name ELSE syn END AS label
      FROM n WHERE {S.matches('name', rx)} OR {S.matches('syn', rx)}"""
    for n, rx in defects.PATTERNS.items()
) + ")"


def _fixed_hits(spark, sf):
    k = F.col("p_partkey") % 9
    plant = F.coalesce(*[F.when(k == n, v) for n, v in _PLANT.items()], F.lit(""))
    p = load(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, plant).otherwise("")).alias("name"), F.array(F.concat("p_type", plant)).alias("synonyms")
    )
    return defects.label_hits(p, "p_partkey", "name", "synonyms", defects.PATTERNS)


@query("known_defect_scan", f"{_FIXED_SQL} SELECT pattern, count(*) FILTER (WHERE field = 'Name') AS in_name, count(*) AS in_any FROM h GROUP BY pattern")
def _(spark, sf):
    return defects.label_defect_scan(_fixed_hits(spark, sf))


@query("known_defect_examples", f"""{_FIXED_SQL}
SELECT pattern, code, field, label, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY code) AS rank FROM h)
WHERE rank <= CASE WHEN pattern = 'joined-words' THEN 25 ELSE 15 END""")
def _(spark, sf):
    return defects.defect_examples(_fixed_hits(spark, sf)).select("pattern", "code", "field", "label", "rank")


@query("classify_defects", """
WITH s AS (SELECT p_partkey AS code, p_type AS kind, upper(split_part(p_name, ' ', 2)) AS form, p_name, p_brand, p_size FROM part),
r AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand END AS rname, CASE WHEN p_size % 5 = 0 THEN p_name ELSE '' END AS rsyn,
  CASE WHEN p_size % 2 = 0 THEN p_name END AS pname FROM s),
b AS (SELECT code, kind, form, contains(lower(rname), lower(form)) AS n, contains(lower(rsyn), lower(form)) AS y,
  coalesce(contains(lower(pname), lower(form)), false) AS p, p_size FROM r)
SELECT code, form, CASE WHEN p_size % 7 = 0 THEN 'not-reproduced' WHEN n THEN 'upstream' WHEN p AND NOT y THEN 'parser' WHEN y THEN 'upstream' ELSE 'not-reproduced' END AS origin FROM b""")
def _(spark, sf):
    p = load(spark, sf, "part").withColumn("code", F.col("p_partkey"))
    size = F.col("p_size")
    suspects = p.select("code", F.col("p_type").alias("kind"), F.upper(F.substring_index("p_name", " ", -1)).alias("form"))
    raw = p.where(size % 7 != 0).select(
        "code", F.when(size % 3 == 0, F.col("p_name")).otherwise(F.col("p_brand")).alias("name"),
        F.array(F.when(size % 5 == 0, F.col("p_name")).otherwise("")).alias("synonyms"),
    )
    parsed = p.where(size % 2 == 0).select("code", F.col("p_name").alias("parsed"))
    return defects.classify_defects(suspects, raw, parsed).select("code", "form", "origin")


_SPAN = "STRUCT(start INTEGER, size INTEGER, term VARCHAR)[]"
_HIT = f"{{'term': %s, 'start': CAST(%s AS INTEGER), 'size': CAST(%s AS INTEGER), 'until': CAST(0 AS INTEGER), 'spans': CAST([] AS {_SPAN})}}"
_FREE = "len(list_filter(a.spans, lambda x: x.start < h.start + h.size AND h.start < x.start + x.size)) = 0"
_AGAIN = "(a.term = h.term AND h.start < a.until)"


@query("dictionary_tags", f"""
WITH d AS MATERIALIZED (SELECT doc_id AS doc, string_split({S.norm('text')}, ' ') AS tok FROM documents),
t AS (SELECT DISTINCT {S.norm('s')} AS term FROM (SELECT unnest(regexp_split_to_array(text, '[.\\n]')) AS s FROM benchmark)),
tt AS (SELECT term, string_split(term, ' ') AS parts FROM t WHERE term <> ''),
occ AS (SELECT doc, unnest(tok) AS w, unnest(range(len(tok))) AS i FROM d),
hits AS (SELECT doc, term, i, len(parts) AS size FROM occ JOIN tt ON w = parts[1] JOIN d USING (doc) WHERE list_slice(tok, i + 1, i + len(parts)) = parts),
l AS (SELECT doc, list({_HIT % ('term', 'i', 'size')} ORDER BY length(term) DESC, term, i) AS hs FROM hits GROUP BY doc),
r AS (SELECT doc, list_reduce(list_prepend({_HIT % ("''", '-1', '0')}, hs), lambda a, h: {{'term': h.term, 'start': h.start, 'size': h.size,
   'until': CASE WHEN {_AGAIN} THEN a.until ELSE h.start + h.size END,
   'spans': CASE WHEN NOT {_AGAIN} AND {_FREE} THEN list_append(a.spans, {{'start': h.start, 'size': h.size, 'term': h.term}}) ELSE a.spans END}}) AS s FROM l)
SELECT doc, x.start AS start, x.size AS size, x.term AS term FROM (SELECT doc, unnest(s.spans) AS x FROM r)""")
def _(spark, sf):
    return tagging.dictionary_tags(load(spark, sf, "documents"), sentences(spark, sf), "doc_id", "text")


@query("search_entities", f"""
WITH {ENTITIES_SQL}
SELECT code, name FROM entities WHERE contains(lower(name), 'widget') OR contains(code, 'widget')
  OR len(list_filter(synonyms, lambda s: contains(lower(s), 'widget'))) > 0 ORDER BY CAST(code AS BIGINT) LIMIT 12""")
def _(spark, sf):
    return terms.search_entities(entities(spark, sf), " Widget ").select("code", "name")


@query("name_search", f"""
WITH {ENTITIES_SQL}, n AS (SELECT DISTINCT substr(p_name, 2, 5) AS q FROM part UNION SELECT DISTINCT 'ORPHA:' || substr(CAST(p_partkey AS VARCHAR), 1, 2) FROM part UNION SELECT DISTINCT substr(p_type, 1, 2) FROM part),
t AS (SELECT q, lower(trim(q)) AS typed, CASE WHEN lower(trim(q)) LIKE 'orpha%' THEN regexp_replace(lower(trim(q)), '^orpha:?', '') ELSE lower(trim(q)) END AS bare FROM n WHERE length(trim(q)) >= 2),
h AS (SELECT q, code, row_number() OVER (PARTITION BY q ORDER BY CAST(code AS BIGINT)) AS rank FROM t JOIN entities
  ON contains(lower(name), typed) OR contains(code, bare) OR len(list_filter(synonyms, lambda s: contains(lower(s), typed))) > 0)
SELECT q, CAST(rank AS INT) AS rank, code FROM h WHERE rank <= 12""")
def _(spark, sf):
    path, p = scratch_path(spark, "names"), load(spark, sf, "part")
    name_index.build_index(entities(spark, sf), path)
    needles = p.select(F.explode(F.array(
        F.substring("p_name", 2, 5), F.concat(F.lit("ORPHA:"), F.substring(F.col("p_partkey").cast("string"), 1, 2)), F.substring("p_type", 1, 2)
    )).alias("q")).distinct()
    return name_index.first_found(name_index.search(spark, path, needles)).select("q", "rank", "code")


@query("normalize_curie", """
SELECT p_partkey, 'MONDO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS a, 'MONDO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS b,
  'ORPHA:' || p_partkey AS c FROM part""")
def _(spark, sf):
    k = F.col("p_partkey").cast("string")
    return load(spark, sf, "part").select(
        "p_partkey", I.normalize_curie(F.concat(F.lit("http://purl.obolibrary.org/obo/MONDO_"), k)).alias("a"),
        I.normalize_curie(F.concat(F.lit("mondo:"), k)).alias("b"), I.normalize_curie(F.concat(F.lit(" orpha_"), k)).alias("c"),
    )


def _id_text():
    k = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    day = F.date_format("o_orderdate", "yyyy")
    return F.concat(
        F.lit("see nct"), k, F.lit(" and ISRCTN"), k, F.lit(", EU "), day, F.lit("-"), F.substring(k, 3, 6), F.lit("-21; DRKS"), k, F.lit(".")
    )


@query("trial_ids", """
WITH k AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS k, strftime(o_orderdate, '%Y') AS y FROM orders)
SELECT o_orderkey, 'NCT' || k AS nct, 'NCT' || k || ' | ISRCTN' || k || ' | ' || y || '-' || substr(k, 3, 6) || '-21 | DRKS' || k AS ids,
  'euctr' AS registry FROM k""")
def _(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", _id_text().alias("t"))
    ids = I.secondary_ids("t")
    return o.select(
        "o_orderkey", I.first_nct("t").alias("nct"), JOINED(ids).alias("ids"),
        I.infer_registry(F.get(ids, F.lit(2))).alias("registry"),
    )


@query("title_fingerprint", f"SELECT doc_id, md5({S.fingerprint('text')}) AS whole, {S.fingerprint('text', 12)} AS fp FROM documents")
def _(spark, sf):
    # The key of twelve tokens is there for comparison with older clusters.
    return load(spark, sf, "documents").select("doc_id", F.md5(I.title_fingerprint("text")).alias("whole"), I.title_fingerprint("text", 12).alias("fp"))
