"""Evidence, policy, designations, associations, registries and hierarchies."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..operators import (
    associations, designations, evidence, graph, identifiers, reconcile, registries,
)
from ..runtime import materialize, scratch_path
from ..sources import snapshots
from . import sqltext as S
from .registry import query
from .tables import load

# ---- identifiers -------------------------------------------------------------

_PAD = "lpad(CAST(p_partkey AS VARCHAR), 6, '0')"


def _part_nodes(spark, sf):
    """Each part owns its own node and its brand's; nodes carry cross-references."""
    p = load(spark, sf, "part")
    own = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    owned = p.select(
        F.col("p_partkey").alias("entity"), F.posexplode(F.array(own, F.col("p_brand"))).alias("pos", "node")
    )
    k = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    mine = p.select(
        own.alias("id"),
        F.array(F.concat(F.lit("MSH:D"), k), F.concat(F.lit("UMLS:C"), k), F.concat(F.lit("MIM: "), k), F.lit("GARD:1")).alias("xrefs"),
        F.array("p_name", "p_type").alias("exact_synonyms"),
    )
    brands = p.select(F.col("p_brand").alias("id")).distinct().select(
        "id", F.array(F.concat(F.lit("MESH:"), "id"), F.concat(F.lit("NCIT:"), "id")).alias("xrefs"),
        F.array("id").alias("exact_synonyms"),
    )
    return owned, mine.unionByName(brands)


@query("collect_identifiers", f"""
SELECT p_partkey AS entity, 'D' || {_PAD} || '|' || p_brand AS mesh, 'C' || {_PAD} AS umls, {_PAD} AS omim, p_brand AS ncit FROM part""")
def _(spark, sf):
    d = identifiers.collect_identifiers(*_part_nodes(spark, sf))
    return d.select("entity", *[F.array_join(b, "|").alias(b) for b in identifiers.BUCKETS])


@query("collect_exact_synonyms", "SELECT p_partkey AS entity, p_name || '|' || p_type || '|' || p_brand AS synonyms FROM part")
def _(spark, sf):
    d = identifiers.collect_exact_synonyms(*_part_nodes(spark, sf))
    return d.select("entity", F.array_join("synonyms", "|").alias("synonyms"))


@query("identifier_rows", f"""
SELECT p_partkey AS entity, unnest(['mesh', 'umls', 'omim', 'mesh', 'ncit']) AS bucket, unnest(['D' || {_PAD}, 'C' || {_PAD}, {_PAD}, p_brand, p_brand]) AS value FROM part""")
def _(spark, sf):
    return identifiers.identifier_rows(*_part_nodes(spark, sf)).select("entity", "bucket", "value")


@query("synonym_rows", "SELECT p_partkey AS entity, unnest([p_name, p_type, p_brand]) AS synonym FROM part")
def _(spark, sf):
    return identifiers.synonym_rows(*_part_nodes(spark, sf)).select("entity", "synonym")


@query("label_rows", """
WITH l AS (SELECT o_custkey AS entity, o_orderkey AS pos, CASE WHEN o_orderstatus = 'F' THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS label FROM orders)
SELECT entity, min(pos) AS pos, arg_min(label, pos) AS label FROM l GROUP BY entity, lower(label)""")
def _(spark, sf):
    return identifiers.label_rows(*_descriptor_ids(spark, sf))


@query("first_labels", """
WITH l AS (SELECT o_custkey AS entity, o_orderkey AS pos, CASE WHEN o_orderstatus = 'F' THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS label FROM orders),
f AS (SELECT entity, lower(label) AS k, arg_min(label, pos) AS label, min(pos) AS pos FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY pos) AS rn FROM f)
SELECT entity, string_agg(label, '|' ORDER BY pos) AS labels FROM r WHERE rn <= 2 GROUP BY entity""")
def _(spark, sf):
    d = identifiers.resolve_labels(*_descriptor_ids(spark, sf), cap=2)
    return d.select("entity", F.array_join("labels", "|").alias("labels"))


def _descriptor_ids(spark, sf):
    """Descriptor ids of each customer: one per order, labelled by priority."""
    o = load(spark, sf, "orders")
    ident = F.concat(F.lit("D"), F.col("o_orderkey").cast("string"))
    ids = o.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("pos"), ident.alias("id"))
    labels = o.select(ident.alias("id"), F.when(F.col("o_orderstatus") == "F", F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority")).alias("label"))
    return ids, labels


@query("resolve_labels", """
WITH l AS (SELECT o_custkey AS entity, o_orderkey AS pos, CASE WHEN o_orderstatus = 'F' THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS label FROM orders),
f AS (SELECT entity, lower(label) AS k, arg_min(label, pos) AS label, min(pos) AS pos FROM l GROUP BY ALL)
SELECT entity, string_agg(label, '|' ORDER BY pos) AS labels FROM f GROUP BY entity""")
def _(spark, sf):
    d = identifiers.resolve_labels(*_descriptor_ids(spark, sf))
    return d.select("entity", F.array_join("labels", "|").alias("labels"))


@query("backfill_labels", """
WITH p AS (SELECT p_partkey, p_size, p_name, p_type FROM part)
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'complete' WHEN p_size % 4 = 1 THEN 'still-empty' WHEN p_size % 4 = 2 THEN 'unchanged' ELSE 'filled' END AS outcome,
  CASE WHEN p_size % 4 = 0 THEN p_name || '|' || p_type WHEN p_size % 4 = 1 THEN '' WHEN p_size % 4 = 2 THEN p_name ELSE p_type || '|' || p_name END AS labels FROM p""")
def _(spark, sf):
    size = F.col("p_size") % 4
    none = F.array().cast("array<string>")
    p = load(spark, sf, "part").select(
        "p_partkey", F.array("p_brand", "p_type").alias("ids"),
        F.when(size == 0, F.array("p_name", "p_type")).otherwise(F.array("p_name")).alias("labels"),
        F.when(size == 1, none).when(size == 2, F.array(F.upper("p_name"))).otherwise(F.array("p_type", "p_name")).alias("fresh"),
    )
    return identifiers.backfill(p, "ids", "labels", "fresh").select(
        "p_partkey", "outcome", F.array_join("labels", "|").alias("labels")
    )


# ---- evidence and policy -----------------------------------------------------


@query("best_evidence", """
WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS rank, o_orderstatus AS s FROM orders),
k AS (SELECT o_custkey, y, max(rank) AS rank FROM o GROUP BY ALL), t AS (SELECT o_custkey, max(rank) AS rank FROM k GROUP BY ALL),
g AS (SELECT o.o_custkey, t.rank, string_agg(DISTINCT s, '|' ORDER BY s) AS symbols FROM t JOIN k USING (o_custkey, rank) JOIN o ON o.o_custkey = k.o_custkey AND o.y = k.y GROUP BY ALL)
SELECT c_custkey AS entity, rank, coalesce(symbols, '') AS symbols FROM customer LEFT JOIN g ON o_custkey = c_custkey""")
def _(spark, sf):
    o = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")).alias("key"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("rank"), F.col("o_orderstatus").alias("symbol"),
    )
    keys = o.select("entity", "key").unionByName(
        load(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.lit("none").alias("key"))
    )
    d = evidence.best_evidence(keys, o, "entity", "key", "rank", "symbol")
    return d.select("entity", "rank", F.array_join("symbols", "|").alias("symbols"))


def _evidence_keys(spark, sf):
    o = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")).alias("key"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("rank"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("symbol"),
    )
    everyone = load(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.lit("none").alias("key"))
    return o.select("entity", "key").unionByName(everyone), o


@query("evidence_rows", """
WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS rank, nullif(o_orderstatus, 'P') AS s FROM orders),
k AS (SELECT o_custkey, y, max(rank) AS rank FROM o GROUP BY ALL), t AS (SELECT o_custkey, max(rank) AS rank FROM k GROUP BY ALL),
g AS (SELECT DISTINCT o.o_custkey, s FROM t JOIN k USING (o_custkey, rank) JOIN o ON o.o_custkey = k.o_custkey AND o.y = k.y WHERE s IS NOT NULL)
SELECT c_custkey AS entity, rank, s AS symbol FROM customer LEFT JOIN t ON t.o_custkey = c_custkey LEFT JOIN g ON g.o_custkey = c_custkey""")
def _(spark, sf):
    keys, o = _evidence_keys(spark, sf)
    return evidence.evidence_rows(keys, o, "entity", "key", "rank", "symbol")


def _halving(spark, sf):
    """A deep hierarchy over customers: k has parents k/2 and k/3."""
    c = load(spark, sf, "customer").where("c_custkey > 0")
    k = F.col("c_custkey")
    up = F.array_distinct(F.array(F.floor(k / 2), F.floor(k / 3)).cast("array<bigint>"))
    return c.select(k.alias("child"), F.posexplode(up).alias("pos", "parent"))


_CLOSURE_SQL = """
e AS (SELECT c_custkey AS child, c_custkey // 2 AS parent, 0 AS pos FROM customer WHERE c_custkey > 0
  UNION SELECT c_custkey, c_custkey // 3, 1 FROM customer WHERE c_custkey > 0 AND c_custkey // 3 <> c_custkey // 2),
walk AS (SELECT child AS node, parent AS ancestor, 1 AS depth, [pos] AS path FROM e WHERE child <> parent
  UNION ALL SELECT node, e.parent, depth + 1, list_append(path, e.pos) FROM walk JOIN e ON e.child = ancestor WHERE depth < 12),
closure AS MATERIALIZED (SELECT node, ancestor, min(depth) AS depth, arg_min(path, (depth, path)) AS path FROM walk WHERE node <> ancestor GROUP BY ALL)
"""


def _closure(spark, sf):
    return graph.ancestors(_halving(spark, sf))


@query("ancestors", f"WITH RECURSIVE {_CLOSURE_SQL} SELECT node, ancestor, depth, array_to_string(path, '-') AS path FROM closure")
def _(spark, sf):
    return _closure(spark, sf).select(
        "node", "ancestor", "depth", F.array_join(F.col("path").cast("array<string>"), "-").alias("path")
    )


@query("ancestors_geography", """
SELECT 'C' || c_custkey AS node, 'N' || c_nationkey AS ancestor, 1 AS depth FROM customer
UNION ALL SELECT 'C' || c_custkey, 'R' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 1 FROM nation""")
def _(spark, sf):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    up = load(spark, sf, "customer").select(tag("C", "c_custkey").alias("child"), tag("N", "c_nationkey").alias("parent"))
    top = load(spark, sf, "nation").select(tag("N", "n_nationkey").alias("child"), tag("R", "n_regionkey").alias("parent"))
    edges = up.unionByName(top).withColumn("pos", F.lit(0))
    return graph.ancestors(edges).select("node", "ancestor", "depth")


@query("ancestors_brands", """
WITH b AS (SELECT DISTINCT p_brand AS b, substr(p_brand, 1, 7) AS m FROM part), t AS (SELECT DISTINCT m FROM b)
SELECT b AS node, m AS ancestor, 1 AS depth, '0' AS path FROM b WHERE b <> m UNION ALL SELECT b, 'Brand', 2, '0-0' FROM b WHERE b <> m UNION ALL SELECT m, 'Brand', 1, '0' FROM t""")
def _(spark, sf):
    brands = load(spark, sf, "part").select(F.col("p_brand").alias("child"), F.substring("p_brand", 1, 7).alias("parent")).distinct()
    top = brands.select(F.col("parent").alias("child"), F.lit("Brand").alias("parent")).distinct()
    tree = graph.small_ancestors(brands.unionByName(top).withColumn("pos", F.lit(0)))
    return tree.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "-"))


def _named_customers(spark, sf):
    """Customers as labelled nodes: the label comes from segment and key."""
    c = load(spark, sf, "customer")
    word = F.element_at(
        F.array(*[F.lit(w) for w in ("amyloid", "cardiac", "disease", "marfanoid", "retinal", "skeletal")]),
        (F.col("c_custkey") % 6 + 1).cast("int"),
    )
    label = F.concat(word, F.lit(" "), F.lower("c_mktsegment"))
    nodes = c.select(F.col("c_custkey").alias("id"), label.alias("label"))
    names = c.select(
        F.col("c_custkey").alias("entity"),
        F.concat(word, F.lit(" "), F.lower("c_mktsegment"), F.lit(" type "), (F.col("c_custkey") % 9).cast("string")).alias("name"),
    )
    # Two nodes per entity: its own and its predecessor's.
    ids = c.select(
        F.col("c_custkey").alias("entity"), F.posexplode(F.array(F.col("c_custkey"), F.greatest(F.col("c_custkey") - 1, F.lit(0)))).alias("pos", "node")
    ).groupBy("entity", "node").agg(F.min("pos").alias("pos"))
    return names, ids, nodes


_NAMED_SQL = """
w AS (SELECT c_custkey, ['amyloid','cardiac','disease','marfanoid','retinal','skeletal'][c_custkey % 6 + 1] || ' ' || lower(c_mktsegment) AS label FROM customer),
names AS (SELECT c_custkey AS entity, label || ' type ' || (c_custkey % 9) AS name FROM w),
ids AS (SELECT entity, node, min(pos) AS pos FROM (SELECT c_custkey AS entity, c_custkey AS node, 0 AS pos FROM customer
  UNION ALL SELECT c_custkey, greatest(c_custkey - 1, 0), 1 FROM customer) GROUP BY ALL),
la AS (SELECT i.entity, c.ancestor, w.label, i.pos, c.depth, c.path FROM ids i JOIN closure c ON c.node = i.node JOIN w ON w.c_custkey = c.ancestor),
"""


def _labelled_sql(depth: str) -> str:
    return f"""lab AS MATERIALIZED (SELECT entity, label, ancestor, pos, depth, path, name FROM (
      SELECT *, row_number() OVER (PARTITION BY entity, label ORDER BY pos, depth, path) AS rn FROM la {depth}) JOIN names USING (entity) WHERE rn = 1)"""


@query("recall_parents", f"""WITH RECURSIVE {_CLOSURE_SQL}, {_NAMED_SQL} {_labelled_sql('WHERE depth <= 2')}
SELECT entity, rank, label FROM (SELECT entity, label, row_number() OVER (PARTITION BY entity ORDER BY pos, depth, path) AS rank FROM lab
  WHERE NOT {S.generic('label')} AND {S.shares_signal('name', 'label')}) WHERE rank <= 3""")
def _(spark, sf):
    names, ids, nodes = _named_customers(spark, sf)
    near = graph.ancestors(_halving(spark, sf), ids, max_depth=2)
    return graph.recall_parents(names, ids, near, nodes).select("entity", "rank", "label")


@query("parent_category", f"""WITH RECURSIVE {_CLOSURE_SQL}, {_NAMED_SQL} {_labelled_sql('WHERE depth <= 2')}
SELECT entity, label FROM (SELECT entity, label, row_number() OVER (PARTITION BY entity ORDER BY length(label) DESC, pos, depth, path) AS rn FROM lab
  WHERE NOT {S.generic('label')} AND NOT {S.scaffold('label')} AND {S.name_parent('name', 'label')}) WHERE rn = 1""")
def _(spark, sf):
    names, ids, nodes = _named_customers(spark, sf)
    near = graph.ancestors(_halving(spark, sf), ids, max_depth=2)
    return graph.parent_category(names, ids, near, nodes).select("entity", "label")


@query("parent_probe", f"""WITH RECURSIVE {_CLOSURE_SQL}, {_NAMED_SQL} {_labelled_sql('')},
hits AS (SELECT label, count(*) % 83 AS hits FROM w JOIN orders ON o_custkey = c_custkey GROUP BY label),
r AS (SELECT entity, label, coalesce(hits, 0) AS hits, rank FROM (SELECT entity, label, row_number() OVER (PARTITION BY entity ORDER BY pos, depth, path) AS rank FROM lab)
  LEFT JOIN hits USING (label) WHERE rank <= 8),
s AS (SELECT *, min(CASE WHEN hits >= 50 THEN rank END) OVER (PARTITION BY entity) AS stop FROM r)
SELECT entity, label, hits FROM s WHERE stop IS NULL OR rank <= stop QUALIFY row_number() OVER (PARTITION BY entity ORDER BY hits DESC, rank) = 1""")
def _(spark, sf):
    return _probe(spark, sf)


def _probe(spark, sf):
    _, ids, nodes = _named_customers(spark, sf)
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    hits = (
        nodes.join(orders, "id").groupBy(T.normalize_term("label").alias("label_key"))
        .agg((F.count("*") % 83).alias("hits"))
    )
    return graph.probe_edges(ids, _halving(spark, sf), nodes, hits).select("entity", "label", "hits")


def _policy(spark, sf):
    """Customers named in a policy: one entry per order of top priority."""
    o = load(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    return o.select(
        F.col("o_orderkey").alias("policy_id"), F.col("o_custkey").alias("code"),
        F.concat(F.lit("entry "), F.col("o_custkey").cast("string")).alias("name"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("group"),
    )


_POLICY_SQL = """pol AS (SELECT o_orderkey AS policy_id, o_custkey AS code, 'entry ' || o_custkey AS name, CAST(o_orderkey % 3 + 1 AS INT) AS g
  FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')"""


@query("policy_match", f"""WITH RECURSIVE {_CLOSURE_SQL}, {_POLICY_SQL},
d AS (SELECT code AS entity, string_agg(DISTINCT g, ',' ORDER BY g) AS groups, NULL::BIGINT AS ancestor, 'direct' AS via FROM pol GROUP BY code),
pa AS (SELECT node AS entity, arg_min(ancestor, (depth, path)) AS ancestor FROM closure WHERE ancestor IN (SELECT code FROM pol)
  AND node NOT IN (SELECT code FROM pol) GROUP BY node),
r AS (SELECT entity, groups, ancestor, via FROM d UNION ALL
  SELECT pa.entity, string_agg(DISTINCT g, ',' ORDER BY g), ancestor, 'parent' FROM pa JOIN pol ON code = ancestor GROUP BY pa.entity, ancestor)
SELECT c_custkey AS entity, via IS NOT NULL AS listed, via, ancestor, groups FROM customer LEFT JOIN r ON entity = c_custkey""")
def _(spark, sf):
    return _policy_match(spark, sf)


def _policy_match(spark, sf):
    """Customers have one node each, so its nearest linked ancestor is all that counts."""
    pol = _policy(spark, sf)
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_custkey").alias("code"))
    ids = c.select("entity", F.col("code").alias("node"), F.lit(0).alias("pos"))
    code_nodes = c.select("code", F.col("code").alias("node"))
    labels = c.select(F.col("code").alias("id"), F.concat(F.lit("node "), F.col("code").cast("string")).alias("label"))
    nodes = evidence.policy_nodes(pol, code_nodes, labels)
    ent = pol.select("group").distinct().withColumn("entitlement", F.concat(F.lit("benefit "), F.col("group").cast("string")))
    indirect = ids.join(pol.select(F.col("code").alias("node")).distinct(), "node", "left_anti")
    near = graph.nearest(_halving(spark, sf), indirect, nodes)
    d = evidence.policy_match(c, ids, pol, nodes, near, ent)
    return d.select("entity", "listed", "via", F.col("ancestor").cast("bigint").alias("ancestor"),
                    F.array_join(F.col("groups").cast("array<string>"), ",").alias("groups"))


@query("parent_fallbacks", f"""WITH RECURSIVE {_CLOSURE_SQL}, {_POLICY_SQL}, {_NAMED_SQL} {_labelled_sql('')},
hits AS (SELECT label, count(*) % 83 AS hits FROM w JOIN orders ON o_custkey = c_custkey GROUP BY label),
r AS (SELECT entity, label, coalesce(hits, 0) AS hits, rank FROM (SELECT entity, label, row_number() OVER (PARTITION BY entity ORDER BY pos, depth, path) AS rank FROM lab)
  LEFT JOIN hits USING (label) WHERE rank <= 8),
s AS (SELECT *, min(CASE WHEN hits >= 50 THEN rank END) OVER (PARTITION BY entity) AS stop FROM r),
probe AS (SELECT entity, label, hits FROM s WHERE stop IS NULL OR rank <= stop QUALIFY row_number() OVER (PARTITION BY entity ORDER BY hits DESC, rank) = 1),
pa AS (SELECT node AS entity, arg_min(ancestor, (depth, path)) AS ancestor FROM closure WHERE ancestor IN (SELECT code FROM pol)
  AND node NOT IN (SELECT code FROM pol) GROUP BY node)
SELECT c_custkey AS entity, pa.ancestor AS policy_ancestor, probe.label AS probe_label, probe.hits AS probe_hits
FROM customer LEFT JOIN pa ON pa.entity = c_custkey LEFT JOIN probe ON probe.entity = c_custkey""")
def _(spark, sf):
    policy = _policy_match(spark, sf).select("entity", F.col("ancestor").alias("policy_ancestor"))
    probe = _probe(spark, sf)
    return policy.join(probe.select("entity", F.col("label").alias("probe_label"), F.col("hits").alias("probe_hits")), "entity", "left")


@query("policy_missing", f"""WITH {_POLICY_SQL} SELECT policy_id, code FROM pol WHERE code NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)""")
def _(spark, sf):
    cat = load(spark, sf, "customer").where("c_nationkey != 3").select(F.col("c_custkey").alias("code"))
    return evidence.reconcile_policy(_policy(spark, sf), cat, 63)[0].select("policy_id", "code")


@query("policy_totals", f"""WITH {_POLICY_SQL}, k AS (SELECT code, count(*) AS n FROM pol GROUP BY code)
SELECT sum(n)::BIGINT AS coded_entries, count(*) AS unique_codes, count(*) - 63 AS delta, count(*) FILTER (WHERE n > 1) AS repeated FROM k""")
def _(spark, sf):
    cat = load(spark, sf, "customer").select(F.col("c_custkey").alias("code"))
    _, totals, repeated = evidence.reconcile_policy(_policy(spark, sf), cat, 63)
    from ..runtime import side_by_side

    return side_by_side(totals, repeated.agg(F.count("*").alias("repeated")))


# ---- designations ------------------------------------------------------------


def _designation_rows(spark, sf):
    """Line items as designations of their part: by part id, by part name."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_linestatus")
    # The text is the part's, so its key is made once a part.
    p = load(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("text"))
    j = li.join(p.withColumn("key", T.normalize_term("text")), li["l_partkey"] == p["p_partkey"])
    status = F.when(F.col("l_returnflag") == "R", "Designated/FDA Approved for Orphan Indication").otherwise("Positive")
    key = F.col("l_partkey").cast("string")
    row = F.struct(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("generic"), "text",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), status.alias("status"),
        F.col("l_orderkey").cast("string").alias("number"),
    )
    marked = (F.col("l_linestatus") == "O") & (F.col("l_partkey") % 4 == 0)
    return j.select(
        F.when(marked, F.array(F.concat(F.lit("p"), key))).otherwise(F.array().cast("array<string>")).alias("ids"),
        "key", row.alias("row"),
    )


def _designation_entities(spark, sf):
    """Parts: known by id, and named after themselves and the two before them."""
    p = load(spark, sf, "part").select("p_partkey", "p_name")
    ids = p.select(F.col("p_partkey").alias("entity"), F.concat(F.lit(" P"), F.col("p_partkey").cast("string")).alias("id"))
    near = F.array(*[F.struct((F.col("p_partkey") + k).alias("entity"), F.lit(k).alias("pos")) for k in (0, 1, 2)])
    near = p.select(
        F.explode(near).alias("n"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name")
    )
    names = near.select("n.entity", "n.pos", "name")
    return ids, names.join(p.select(F.col("p_partkey").alias("entity")), "entity", "left_semi")


_DESIG_SQL = """
d AS MATERIALIZED (SELECT l_partkey AS pk, l_linestatus = 'O' AND l_partkey % 4 = 0 AS marked, 's' || l_suppkey % 10 AS generic, p_name || ' ' || l_partkey AS text,
  strftime(l_shipdate, '%Y-%m-%d') AS date, l_returnflag = 'R' AS fda_top, l_returnflag <> 'R' AS ema_top, CAST(l_orderkey AS VARCHAR) AS number,
  CASE WHEN l_returnflag = 'R' THEN 'Designated/FDA Approved for Orphan Indication' ELSE 'Positive' END AS status FROM lineitem JOIN part ON l_partkey = p_partkey),
nm AS MATERIALIZED (SELECT a.p_partkey AS entity, b.p_partkey AS pk, a.p_partkey - b.p_partkey AS pos FROM part a JOIN part b ON a.p_partkey - b.p_partkey BETWEEN 0 AND 2)
"""
# The row kept for equal designations is the smallest, field by field.
_FDA_SQL = f"""{_DESIG_SQL},
fi AS (SELECT pk AS entity, generic, text, date, min(status) = 'Designated/FDA Approved for Orphan Indication' AS top, 'umls' AS via, 0 AS pos FROM d WHERE marked GROUP BY ALL),
fk AS (SELECT pk, generic, text, date, min(status) = 'Designated/FDA Approved for Orphan Indication' AS top FROM d GROUP BY ALL),
fn AS (SELECT pk, count(*) AS n FROM fk GROUP BY pk),
fr AS (SELECT nm.* FROM nm JOIN fn USING (pk) WHERE entity NOT IN (SELECT entity FROM fi)),
fda AS MATERIALIZED (SELECT entity, generic, text, date, top, via FROM fi UNION ALL SELECT entity, generic, text, date, top, 'name' FROM fr JOIN fk USING (pk))
"""
_EMA_SQL = """
ek AS (SELECT pk, number, generic, text, arg_min(date, (date, status)) AS date, arg_min(status, (date, status)) = 'Positive' AS top FROM d GROUP BY ALL),
en AS (SELECT pk, count(*) AS n FROM ek GROUP BY pk),
er AS (SELECT nm.* FROM nm JOIN en USING (pk)),
ema AS MATERIALIZED (SELECT entity, number, generic, text, date, top FROM er JOIN ek USING (pk))
"""


def _list_sql(table: str) -> str:
    return f"""SELECT entity, count(*) AS designations, count(*) FILTER (WHERE top) AS approved,
      string_agg(generic || '/' || text || '/' || date, '|' ORDER BY rn) FILTER (WHERE rn <= 15) AS listed
      FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY top DESC, date DESC, generic, text) AS rn FROM {table}) GROUP BY entity"""


def _shown(d):
    rows = F.transform("listed", lambda r: F.concat_ws("/", r["generic"], r["text"], r["date"]))
    return d.select("entity", "designations", "approved", F.array_join(rows, "|").alias("listed"))


def _fda(spark, sf):
    ids, names = _designation_entities(spark, sf)
    return designations.fda_match(ids, names, _designation_rows(spark, sf))


def _ema(spark, sf):
    return designations.ema_match(_designation_entities(spark, sf)[1], _designation_rows(spark, sf))


@query("fda_match", f"WITH {_FDA_SQL} {_list_sql('fda')}")
def _(spark, sf):
    return _shown(_fda(spark, sf))


@query("fda_match_source", f"WITH {_FDA_SQL} SELECT entity, max(via) AS matched_via FROM fda GROUP BY entity")
def _(spark, sf):
    return _fda(spark, sf).select("entity", "matched_via")


@query("ema_match", f"WITH {_DESIG_SQL}, {_EMA_SQL} {_list_sql('ema')}")
def _(spark, sf):
    return _shown(_ema(spark, sf))


@query("merge_designations", f"""WITH {_FDA_SQL}, {_EMA_SQL},
fl AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY top DESC, date DESC, generic, text) AS rn FROM fda),
el AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY top DESC, date DESC, generic, text) AS rn FROM ema),
b AS (SELECT entity, 'fda' AS agency, CASE WHEN top THEN 0 ELSE 2 END AS tier, generic, text, date FROM fl
  UNION ALL SELECT entity, 'ema', CASE WHEN top THEN 1 ELSE 2 END, generic, text, date FROM el),
t AS (SELECT entity, string_agg(date, '|' ORDER BY tier, date DESC, generic, text) FILTER (WHERE rn <= 20) AS dates FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY tier, date DESC, generic, text) AS rn FROM b) GROUP BY entity),
f AS (SELECT entity, count(*) AS fc, count(*) FILTER (WHERE top) AS approved FROM fda GROUP BY entity), m AS (SELECT entity, count(*) AS ec FROM ema GROUP BY entity)
SELECT entity, coalesce(fc, 0) + coalesce(ec, 0) AS designations, coalesce(fc, 0) AS fda_count, coalesce(ec, 0) AS ema_count, coalesce(approved, 0) AS approved,
  CASE WHEN fc > 0 AND ec > 0 THEN 'fda-oopd+ema' WHEN ec > 0 THEN 'ema' ELSE 'fda-oopd' END AS source, dates FROM f FULL JOIN m USING (entity) JOIN t USING (entity)""")
def _(spark, sf):
    d = designations.all_designations(*_designation_entities(spark, sf), _designation_rows(spark, sf))
    dates = F.array_join(F.transform("listed", lambda r: r["date"]), "|")
    return d.select("entity", "designations", "fda_count", "ema_count", "approved", "source", dates.alias("dates"))


# ---- associations ------------------------------------------------------------


def _customer_years(spark, sf):
    """Nodes are customer-years; an entity (nation) owns those of its customers."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
    node = F.concat_ws("-", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string"))
    rows = o.withColumn("node", node)
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    ids = rows.join(c, "o_custkey").groupBy(F.col("o_custkey").alias("entity"), "node").agg(F.year(F.min("o_orderdate")).alias("pos"))
    return ids, rows


_CY = "o_custkey || '-' || year(o_orderdate)"


@query("summarise_phenotypes", f"""
WITH n AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL),
c AS (SELECT o_custkey, max(n) AS phenotypes FROM n GROUP BY ALL),
l AS (SELECT o_custkey, lower(o_orderpriority) AS k, min((year(o_orderdate), o_orderkey)) AS spot FROM orders GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY spot) AS rn FROM l)
SELECT o_custkey AS entity, phenotypes, string_agg(k, '|' ORDER BY rn) AS sample FROM c JOIN s USING (o_custkey) WHERE rn <= 3 GROUP BY ALL""")
def _(spark, sf):
    ids, rows = _customer_years(spark, sf)
    assoc = rows.select("node", F.lower("o_orderpriority").alias("label"), F.col("o_orderkey").alias("rank"))
    d = associations.summarise_phenotypes(ids, assoc, 3)
    return d.select("entity", "phenotypes", F.array_join(F.transform("sample", lambda r: r["label"]), "|").alias("sample"))


@query("summarise_models", """
WITH c AS (SELECT o_custkey, count(*) AS models FROM orders GROUP BY ALL),
l AS (SELECT o_custkey, o_orderstatus || substr(o_orderpriority, 1, 1) AS m, min((year(o_orderdate), o_orderkey)) AS spot FROM orders GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY spot) AS rn FROM l)
SELECT o_custkey AS entity, models, string_agg(m, '|' ORDER BY rn) AS listed FROM c JOIN s USING (o_custkey) WHERE rn <= 12 GROUP BY ALL""")
def _(spark, sf):
    ids, rows = _customer_years(spark, sf)
    assoc = rows.select(
        "node", F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("model"),
        F.concat(F.lit("<i>"), "o_orderpriority", F.lit("</i>")).alias("label"), F.lit("t").alias("taxon"), F.col("o_orderkey").alias("rank"),
    )
    d = associations.summarise_models(ids, assoc)
    return d.select("entity", "models", F.array_join(F.transform("listed", lambda r: r["model"]), "|").alias("listed"))


@query("summarise_chemicals", """
WITH li AS (SELECT o_custkey, year(o_orderdate) AS y, l_partkey, l_suppkey, l_returnflag, l_orderkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
f AS (SELECT o_custkey, min(year(o_orderdate)) AS y FROM orders GROUP BY ALL), m AS (SELECT li.* FROM li JOIN f USING (o_custkey, y)),
ch AS (SELECT o_custkey, 'chem ' || l_suppkey % 20 AS name, min(l_returnflag <> 'R') AS late FROM m GROUP BY ALL),
pw AS (SELECT o_custkey, 'path ' || l_partkey % 30 AS name, min(l_orderkey) AS rank FROM m GROUP BY ALL),
ph AS (SELECT o_custkey, 'HP:' || l_partkey % 40 AS id, max(l_quantity) AS freq FROM m GROUP BY ALL),
ca AS (SELECT o_custkey, count(*) AS n, array_to_string((list(name ORDER BY late, name))[1:12], '|') AS s FROM ch GROUP BY ALL),
pa AS (SELECT o_custkey, count(*) AS n, array_to_string((list(name ORDER BY rank, name))[1:8], '|') AS s FROM pw GROUP BY ALL),
ha AS (SELECT o_custkey, count(*) AS n, array_to_string((list(id ORDER BY freq DESC, id))[1:8], '|') AS s FROM ph GROUP BY ALL)
SELECT f.o_custkey AS entity, coalesce(ca.n, 0) AS chemicals_count, coalesce(pa.n, 0) AS pathways_count, coalesce(ha.n, 0) AS phenotypes_count,
  ca.s AS chemicals, pa.s AS pathways, ha.s AS phenotypes FROM f LEFT JOIN ca USING (o_custkey) LEFT JOIN pa USING (o_custkey) LEFT JOIN ha USING (o_custkey)""")
def _(spark, sf):
    ids, rows = _customer_years(spark, sf)
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    j = rows.select("o_orderkey", "node").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    word = lambda p, c, m: F.concat(F.lit(p), (F.col(c) % m).cast("string"))
    entries = associations.annotation_entries(
        word("chem ", "l_suppkey", 20), F.when(F.col("l_returnflag") == "R", "Therapeutic"),
        word("path ", "l_partkey", 30), F.col("l_orderkey"),
        word("HP:", "l_partkey", 40), word("sign ", "l_partkey", 40), F.col("l_quantity"),
    )
    d = associations.summarise_annotations(ids, j.select("node", entries.alias("entries")))
    lists = [
        F.array_join(F.transform(c, lambda r: r[f]), "|").alias(c)
        for c, f in (("chemicals", "name"), ("pathways", "name"), ("phenotypes", "id"))
    ]
    return d.select("entity", "chemicals_count", "pathways_count", "phenotypes_count", *lists)


@query("summarise_drugs", """
WITH li AS (SELECT o_custkey, year(o_orderdate) AS y, l_partkey % 60 AS d, ['PHASE_4','PHASE_3','PHASE_2','PHASE_1','EARLY','NONE'][l_linenumber % 6 + 1] AS stage,
    [4, 3, 2, 1, 0.5, -1][l_linenumber % 6 + 1] AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
f AS (SELECT o_custkey, min(year(o_orderdate)) AS y FROM orders GROUP BY ALL),
b AS (SELECT o_custkey, d, arg_max(stage, r) AS stage, max(r) AS r FROM li JOIN f USING (o_custkey, y) GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY r DESC, 'drug ' || d, 'CH' || d) AS rn FROM b)
SELECT f.o_custkey AS entity, count(d) AS drug_count, string_agg('CH' || d || ':' || stage, '|' ORDER BY rn) FILTER (WHERE rn <= 15) AS drugs
FROM f LEFT JOIN s USING (o_custkey) GROUP BY ALL""")
def _(spark, sf):
    ids, rows = _customer_years(spark, sf)
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    j = rows.select("o_orderkey", "node").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    d = (F.col("l_partkey") % 60).cast("string")
    stages = F.array(*[F.lit(s) for s in ("PHASE_4", "PHASE_3", "PHASE_2", "PHASE_1", "EARLY", "NONE")])
    drugs = j.select(
        "node", F.concat(F.lit("CH"), d).alias("drug"), F.concat(F.lit("drug "), d).alias("name"),
        F.element_at(stages, (F.col("l_linenumber") % 6 + 1).cast("int")).alias("stage"),
    )
    out = associations.summarise_drugs(ids, drugs)
    shown = F.transform("drugs", lambda r: F.concat_ws(":", r["drug"], r["stage"]))
    return out.select("entity", "drug_count", F.array_join(shown, "|").alias("drugs"))


# ---- registries --------------------------------------------------------------


def _records(spark, sf):
    """Documents as registry records: chained by source and length, and by print."""
    d = load(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("rid"), F.concat(F.lit("DOC"), F.col("doc_id").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("nct_id"),
        F.array(F.concat_ws("-", "source", F.col("n_chars").cast("string"))).alias("secondary_ids"),
        F.col("text").alias("title"), F.when(F.col("lang") != "en", F.col("lang")).alias("status"),
        F.lit("other").alias("registry"), F.lit("").alias("url"),
        F.when(F.col("doc_id") % 3 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("conditions"),
        F.when(F.col("doc_id") % 2 == 1, F.col("source")).alias("study_type"),
    )


_COMPONENTS_SQL = f"""
k AS MATERIALIZED (SELECT doc_id AS rid, 's:' || source || '-' || n_chars AS key FROM documents
  UNION SELECT doc_id, 't:' || {S.fingerprint('text')} FROM documents WHERE length({S.fingerprint('text')}) >= 24),
e AS MATERIALIZED (SELECT DISTINCT a.rid AS u, b.rid AS v FROM k a JOIN k b USING (key) WHERE a.rid <> b.rid),
reach AS (SELECT rid AS n, rid AS r FROM (SELECT DISTINCT rid FROM k) UNION SELECT n, e.v FROM reach JOIN e ON e.u = r),
comp AS MATERIALIZED (SELECT n AS rid, min(r) AS cluster FROM reach GROUP BY n)
"""


@query("registry_clusters", f"WITH RECURSIVE {_COMPONENTS_SQL} SELECT rid, cluster FROM comp")
def _(spark, sf):
    return registries.components(registries.record_keys(_records(spark, sf))).select("rid", "cluster")


@query("registry_clusters_over_time", f"WITH RECURSIVE {_COMPONENTS_SQL} SELECT rid, cluster FROM comp")
def _(spark, sf):
    # Three deliveries, each attached to what the ones before left.
    keys = materialize(registries.record_keys(_records(spark, sf)), "keys")
    parts = [keys.where(F.pmod(F.xxhash64("rid"), F.lit(3)) == i) for i in range(3)]
    clusters = registries.components(parts[0]).select("rid", "cluster")
    kept = registries.kept_keys(parts[0], clusters)
    for fresh in parts[1:]:
        clusters, kept = registries.attach(clusters, kept, fresh)
    return clusters


@query("registry_united_ids", f"""WITH RECURSIVE {_COMPONENTS_SQL}
SELECT DISTINCT cluster, source || '-' || n_chars AS other_id FROM comp JOIN documents ON doc_id = rid""")
def _(spark, sf):
    rows = _records(spark, sf)
    clusters = materialize(registries.components(registries.record_keys(rows)), "clusters")
    first = rows.join(clusters, "rid").groupBy("cluster").agg(F.min_by(F.struct("id", "nct_id"), "rid").alias("f"))
    return registries.cluster_ids(rows, clusters, first.select("cluster", "f.*"))


_NAMED_IDS = ", ".join(
    rf"regexp_extract_all(coalesce(text, ''), '{p}')"
    for p in (
        r"(?i)\bNCT\d{8}\b", r"(?i)\bISRCTN\d{8}\b", r"\b\d{4}-\d{6}-\d{2}(?:-\d{2})?\b", r"\b\d{4}-\d{6}-\d{2}\b", r"(?i)\bCTRI/\d{4}/\d{2}/\d{6}\b",
        r"(?i)\bDRKS\d{8}\b", r"(?i)\bjRCT\w+\d+\b", r"(?i)\bChiCTR(?:-[A-Z]+)?-\d+\b", r"(?i)\bACTRN\d{14}\b",
    )
)


@query("registry_dedupe", f"""WITH RECURSIVE
i AS MATERIALIZED (SELECT doc_id AS rid, unnest(list_distinct(flatten([[source || '-' || n_chars], {_NAMED_IDS}]))) AS raw FROM documents),
n AS MATERIALIZED (SELECT doc_id AS rid, nullif(upper(regexp_extract(text, '(?i)\\bNCT\\d{{8}}\\b')), '') AS nct FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, CASE WHEN raw = source || '-' || n_chars THEN raw ELSE upper(raw) END AS other FROM i JOIN documents ON doc_id = rid),
k AS MATERIALIZED (SELECT rid, 's:' || upper(other) AS key FROM s UNION SELECT rid, 'n:' || nct FROM n WHERE nct IS NOT NULL
  UNION SELECT doc_id, 't:' || {S.fingerprint('text')} FROM documents WHERE length({S.fingerprint('text')}) >= 24),
e AS MATERIALIZED (SELECT DISTINCT a.rid AS u, b.rid AS v FROM k a JOIN k b USING (key) WHERE a.rid <> b.rid),
reach AS (SELECT rid AS n, rid AS r FROM (SELECT DISTINCT rid FROM k) UNION SELECT n, e.v FROM reach JOIN e ON e.u = r),
comp AS MATERIALIZED (SELECT n AS rid, min(r) AS cluster FROM reach GROUP BY n),
m AS (SELECT cluster, count(*) AS records, 'DOC' || min(rid) AS id, arg_min(nct, rid) AS nct_id,
  arg_min(lang, rid) FILTER (WHERE lang <> 'en') AS status, arg_min(source, rid) FILTER (WHERE rid % 2 = 1) AS study_type,
  coalesce(arg_min(lang, rid) FILTER (WHERE rid % 3 = 0), '') AS conditions
  FROM comp JOIN documents ON doc_id = rid JOIN n USING (rid) GROUP BY cluster),
u AS (SELECT cluster, string_agg(other, '|' ORDER BY other) AS ids
  FROM (SELECT DISTINCT cluster, other FROM (SELECT rid, other FROM s UNION SELECT rid, nct FROM n WHERE nct IS NOT NULL) JOIN comp USING (rid))
  JOIN m USING (cluster) WHERE other <> id AND other IS DISTINCT FROM nct_id GROUP BY cluster)
SELECT m.*, coalesce(ids, '') AS ids FROM m LEFT JOIN u USING (cluster)""")
def _(spark, sf):
    # Records whose texts name study ids have those too.
    rows = _records(spark, sf).withColumns({
        "nct_id": I.first_nct("title"),
        "secondary_ids": F.array_distinct(F.concat("secondary_ids", I.secondary_ids("title"))),
    })
    d = registries.registry_dedupe(rows)
    return d.select(
        "cluster", "records", "id", "nct_id", "status", "study_type",
        F.coalesce(F.array_join("conditions", ","), F.lit("")).alias("conditions"), F.array_join("secondary_ids", "|").alias("ids"),
    )


@query("split_already_known", """
SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) THEN 'known' ELSE 'novel' END AS side FROM orders""")
def _(spark, sf):
    o = load(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("nct"), F.col("o_custkey").cast("string")).alias("nct_id"),
        F.array(F.concat(F.lit("o "), F.col("o_orderkey").cast("string"))).alias("secondary_ids"),
    )
    by_cust = load(spark, sf, "orders").where("o_custkey % 7 = 0").select(F.concat(F.lit("NCT"), F.col("o_custkey").cast("string")).alias("id"))
    by_order = load(spark, sf, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("id"))
    novel, known = registries.split_already_known(o, by_cust.unionByName(by_order), "o_orderkey")
    return novel.select("o_orderkey", F.lit("novel").alias("side")).unionByName(known.select("o_orderkey", F.lit("known").alias("side")))


@query("route_by_verdict", """
WITH r AS (SELECT source AS entity, doc_id, quality, toxic, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents LEFT JOIN labels USING (doc_id)),
v AS (SELECT entity, CASE WHEN rn > 40 OR quality IS NULL THEN 'uncertain' WHEN quality = 1 AND toxic = 0 THEN 'kept' WHEN quality = 0 AND toxic = 1 THEN 'dropped'
  WHEN toxic = 1 THEN 'parent' ELSE 'uncertain' END AS route FROM r)
SELECT entity, count(*) FILTER (WHERE route = 'kept') AS kept, count(*) FILTER (WHERE route = 'parent') AS parent,
  count(*) FILTER (WHERE route = 'dropped') AS dropped, count(*) FILTER (WHERE route = 'uncertain') AS uncertain FROM v GROUP BY entity""")
def _(spark, sf):
    d = load(spark, sf, "documents").select(F.col("source").alias("entity"), "doc_id")
    lab = load(spark, sf, "labels")
    verdict = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "relevant")
        .when((F.col("quality") == 0) & (F.col("toxic") == 1), "irrelevant")
        .when(F.col("toxic") == 1, "parent-category")
    )
    rows = d.join(lab, "doc_id", "left").select("entity", "doc_id", verdict.alias("verdict"))
    return registries.route_counts(registries.route_by_verdict(rows, "entity", ["doc_id"]), "entity")


# ---- merging and comparing ---------------------------------------------------


@query("merge_candidates", """
WITH a AS (SELECT DISTINCT o_custkey AS k, 'a' AS f FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
b AS (SELECT DISTINCT o_custkey AS k, 'b' AS f FROM orders WHERE o_orderstatus = 'P')
SELECT coalesce(a.k, b.k) AS cust, coalesce(a.f, b.f) AS side, CASE WHEN a.k IS NULL THEN 'broad' WHEN b.k IS NULL THEN 'pipeline' ELSE 'both' END AS source
FROM a FULL JOIN b ON a.k = b.k""")
def _(spark, sf):
    o = load(spark, sf, "orders")
    a = o.where("o_orderdate < timestamp '1996-01-01'").select(F.col("o_custkey").alias("cust"), F.lit("a").alias("side"))
    b = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("cust"), F.lit("b").alias("side"))
    return reconcile.merge_candidates(a, b, "cust", ["side"])


@query("carry_forward", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 9 ELSE quality END AS quality, toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, sf):
    new = load(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, 9).alias("quality"))
    return reconcile.carry_forward(new, load(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"])


@query("align_labels", """
WITH g AS (SELECT p_partkey AS code, p_size, CASE WHEN p_size % 4 = 0 THEN 'Unrelated text' WHEN p_size % 4 = 1 THEN upper(p_name) || ' (x)' ELSE split_part(p_name, ' ', 1) END AS name FROM part)
SELECT CAST(code AS VARCHAR) AS code, problem FROM (
  SELECT code, 'review-incomplete' AS problem FROM g WHERE p_size % 9 = 0
  UNION ALL SELECT code, 'count-mismatch' FROM g WHERE p_size % 9 <> 0 AND p_size % 6 = 1
  UNION ALL SELECT code, 'absent-code' FROM g WHERE p_size % 10 = 0
  UNION ALL SELECT code, 'not-a-usable-row' FROM g WHERE p_size % 10 <> 0 AND p_size % 11 = 0 AND p_size % 2 = 1
  UNION ALL SELECT code, 'label-mismatch' FROM g WHERE p_size % 10 <> 0 AND p_size % 11 <> 0 AND p_size % 4 = 0)""")
def _(spark, sf):
    p = load(spark, sf, "part").withColumn("code", F.col("p_partkey").cast("string"))
    size = F.col("p_size")
    name = F.when(size % 4 == 0, "Unrelated text").when(size % 4 == 1, F.concat(F.upper("p_name"), F.lit(" (x)"))).otherwise(F.substring_index("p_name", " ", 1))
    gold = p.select(
        "code", name.alias("name"), F.when(size % 2 == 0, "umbrella").otherwise("plain").alias("difficulty"),
        F.when(size % 6 == 1, 2).otherwise(1).alias("true_count"), F.array("p_brand").alias("relevant"),
        F.array("p_type").alias("irrelevant"), F.array("p_type").alias("uncertain"), F.when(size % 9 == 0, "  ").otherwise("someone").alias("reviewed_by"),
    )
    known = p.where(size % 10 != 0)
    catalogue = known.where(size % 11 != 0).select("code", F.array("p_name", "p_brand").alias("labels"))
    return reconcile.align_labels(gold, catalogue, known.select("code"))


_VERSIONS = """
b AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderstatus) AS s, round(sum(o_totalprice), 2) AS t FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL),
a AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderstatus) AS s, round(sum(o_totalprice), 2) AS t FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' AND o_custkey % 50 <> 1 GROUP BY ALL)
"""


def _version(spark, sf, before, drop=False):
    o = load(spark, sf, "orders").where(F.col("o_orderdate") < F.lit(before).cast("timestamp"))
    if drop:
        o = o.where("o_custkey % 50 != 1")
    return o.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count("*").alias("n"), F.max("o_orderstatus").alias("s"), F.round(F.sum("o_totalprice"), 2).alias("t")
    )


@query("snapshot_diff", f"""WITH {_VERSIONS}, j AS (SELECT coalesce(a.k, b.k) AS k, a.k AS ak, b.k AS bk, a.n AS an, b.n AS bn, a.s AS sa, b.s AS sb, coalesce(a.k, b.k) % 3 = 0 AS touched FROM a FULL JOIN b ON a.k = b.k)
SELECT k, 'lost' AS change, NULL AS field FROM j WHERE ak IS NULL UNION ALL SELECT k, 'added', NULL FROM j WHERE bk IS NULL
UNION ALL SELECT k, 'changed', 's' FROM j WHERE sa <> sb UNION ALL SELECT k, 'changed', 'n' FROM j WHERE an <> bn AND NOT touched""")
def _(spark, sf):
    before, after = _version(spark, sf, "1998-01-01"), _version(spark, sf, "1999-01-01", True)
    touched = load(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    path = scratch_path(spark, "versions")
    snapshots.write_snapshot(before, path, "1998-01-01", "k")
    snapshots.write_snapshot(after, path, "1999-01-01", "k")
    return snapshots.diff_snapshots(
        spark, path, "1998-01-01", "1999-01-01", "k", ["n", "s", "t"], touched, frozen_if_touched=["s"], derived=["t"]
    )


@query("transitions", """
WITH b AS (SELECT p_partkey AS k, count(l_orderkey) FILTER (WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity >= 45) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
a AS (SELECT p_partkey AS k, count(l_orderkey) FILTER (WHERE l_quantity >= 45) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)
SELECT k, a.n FROM a JOIN b USING (k) WHERE b.n = 0 AND a.n > 0""")
def _(spark, sf):
    p, li = load(spark, sf, "part"), load(spark, sf, "lineitem")

    def counted(test):
        n = li.groupBy(F.col("l_partkey").alias("k")).agg(F.count_if(test).alias("n"))
        return p.select(F.col("p_partkey").alias("k")).join(n, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))

    many = F.col("l_quantity") >= 45
    early = many & (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp"))
    return reconcile.transitions(counted(early), counted(many), "k", "n")
