"""Registry records: clustering by shared keys, and what is already known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions.text import exploded
from ..runtime import broadcast_if_small, discard, materialize
from .ranks import row_index

MAX_ROUNDS = 60


def record_keys(records: DataFrame, title_tokens: int | None = None) -> DataFrame:
    """``(rid, key)``: own id, main-registry id, secondary ids, long title print.

    The print of a long title is hashed, so keys stay short whatever the title.
    """
    print_ = I.title_fingerprint("title", title_tokens)
    keys = F.array_compact(
        F.concat(
            F.array(
                F.concat(F.lit("id:"), I.canonical_id("id")),
                F.when(F.col("nct_id").isNotNull(), F.concat(F.lit("nct:"), I.canonical_id("nct_id"))),
                F.when(F.length(print_) >= 24, F.concat(F.lit("title:"), F.sha2(print_, 256))),
            ),
            F.transform(
                F.coalesce("secondary_ids", F.array().cast("array<string>")),
                lambda s: F.concat(F.lit("sid:"), I.canonical_id(s)),
            ),
        )
    )
    return exploded(records, F.array_distinct(keys), "key", "rid")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step on edges ``u > v``.

    Every node links its larger (or its smaller) neighbours to the smallest node
    it knows. Minima combine before the shuffle; the join back has one row per
    node on one side, so a hub is split like any skewed key.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.join(low, "u").where(F.col("v") > F.col("u"))
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(low, "u")
        out = linked.where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _differ(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of distinct edges differ in any row."""
    sides = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
    return not sides.groupBy("u", "v").agg(F.sum("side").alias("n")).where("n <> 0").isEmpty()


def components(keys: DataFrame, node: str = "rid", key: str = "key") -> DataFrame:
    """``(rid, cluster)``: smallest record reachable over shared keys.

    Records of one key form a star around its smallest record, so a key held by
    very many records adds one edge each, never all pairs. Large and small star
    steps alternate until nothing changes, which takes few rounds even for long
    chains. Each round is a table in the shared folder.
    """
    # Keys can be costly to make and are read for the nodes, the hubs and the edges.
    pairs = materialize(keys.select(F.col(node).alias("n"), F.col(key).alias("k")).distinct(), "keys")
    nodes = pairs.select("n").distinct()
    hubs = pairs.groupBy("k").agg(F.min("n").alias("v"), F.count("*").alias("c")).where("c > 1")
    edges = (
        pairs.join(hubs.select("k", "v"), "k").where("n != v")
        .select(F.col("n").alias("u"), "v").distinct()
    )
    edges = materialize(edges, "components")
    for _ in range(MAX_ROUNDS):
        before = edges
        edges = materialize(_star(_star(before, larger=True), larger=False), "components")
        settled = not _differ(before, edges)
        discard(before)
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    found = edges.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(found, nodes["n"] == found["u"], "left").select(
        F.col("n").alias(node), F.coalesce("v", "n").alias("cluster")
    )


def kept_keys(keys: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(key, cluster)``, one row per key: what later records attach to."""
    return keys.join(clusters, "rid").groupBy("key").agg(F.min("cluster").alias("cluster"))


def attach(clusters: DataFrame, kept: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(clusters, kept)`` after the records of ``fresh`` (``rid, key``) came in.

    ``clusters`` is ``rid, cluster`` and ``kept`` is ``key, cluster`` of all before.
    Components are searched among the new records and the clusters that share a key
    with them, each standing for itself by its smallest record; other clusters are not
    touched. Where a new record bridges clusters they become one, under the smallest
    record of all, so the outcome is that of one run over everything.
    """
    fresh = fresh.select("rid", "key").distinct()
    touched = kept.join(fresh.select("key").distinct(), "key", "left_semi").select(F.col("cluster").alias("rid"), "key")
    found = materialize(components(materialize(fresh.unionByName(touched), "touched")), "attached")
    moved, _ = broadcast_if_small(found.where("rid <> cluster").select(F.col("rid").alias("cluster"), F.col("cluster").alias("into")))

    def renamed(table: DataFrame, column: str) -> DataFrame:
        return table.join(moved, "cluster", "left").select(column, F.coalesce("into", "cluster").alias("cluster"))

    new = found.join(fresh.select("rid").distinct(), "rid", "left_semi")
    after = materialize(renamed(clusters, "rid").unionByName(new), "clusters")
    keys = renamed(kept, "key").unionByName(fresh.join(new, "rid").select("key", "cluster"))
    return after, materialize(keys.groupBy("key").agg(F.min("cluster").alias("cluster")), "kept")


def registry_dedupe(records: DataFrame) -> DataFrame:
    """One row per cluster: the first record, ids united, blank fields filled.

    ``rid`` fixes source order. Fields are filled from the earliest record that
    has one. Everything is an aggregate with partial results except the united
    id list, which is reduced to distinct ids first.
    """
    clusters = components(record_keys(records))
    placed = records.join(clusters, "rid")
    def at(cond):
        return F.when(cond, F.col("rid"))

    filled = placed.groupBy("cluster").agg(
        F.count("*").alias("records"),
        F.min_by("nct_id", at(F.col("nct_id").isNotNull())).alias("nct_id"),
        F.min_by("conditions", at(F.size("conditions") > 0)).alias("conditions"),
        F.min_by("study_type", at(F.col("study_type").isNotNull())).alias("study_type"),
        F.min_by("status", at(F.col("status").isNotNull())).alias("status"),
    )
    # A cluster is named by its first record, so titles take no part in the aggregate.
    first = placed.where("rid = cluster").select("cluster", "id", "title", "registry", "url").dropDuplicates(["cluster"])
    merged = filled.join(first, "cluster")
    united = cluster_ids(records, clusters, merged).groupBy("cluster").agg(F.sort_array(F.collect_list("other_id")).alias("secondary_ids"))
    return merged.join(united, "cluster", "left").select(
        "cluster", "records", "id", "nct_id", "title", "registry", "url", "conditions", "study_type", "status",
        F.coalesce("secondary_ids", F.array().cast("array<string>")).alias("secondary_ids"),
    )


def cluster_ids(records: DataFrame, clusters: DataFrame, merged: DataFrame) -> DataFrame:
    """``(cluster, other_id)``: united ids besides the survivor's own, one per row."""
    ids = F.array_compact(
        F.concat(
            F.coalesce("secondary_ids", F.array().cast("array<string>")),
            F.array(F.when(F.col("nct_id").isNotNull(), I.canonical_id("nct_id"))),
        )
    )
    rows = records.join(clusters, "rid").select("cluster", F.explode(ids).alias("other_id")).distinct()
    own = merged.select("cluster", I.canonical_id("id").alias("own"), I.canonical_id("nct_id").alias("nct"))
    return (
        rows.join(own, "cluster")
        .where((F.col("other_id") != F.col("own")) & ~F.col("other_id").eqNullSafe(F.col("nct")))
        .select("cluster", "other_id")
    )


def split_already_known(records: DataFrame, known: DataFrame, rid: str = "rid") -> tuple[DataFrame, DataFrame]:
    """``(novel, known)`` by main-registry id or any secondary id.

    ``known`` has ``id``.
    """
    ids = F.array_compact(
        F.concat(F.array("nct_id"), F.coalesce("secondary_ids", F.array().cast("array<string>")))
    )
    rows = records.select(rid, F.explode(ids).alias("raw")).select(rid, I.canonical_id("raw").alias("_id"))
    hits = (
        rows.join(known.select(I.canonical_id("id").alias("_id")).distinct(), "_id", "left_semi")
        .select(rid).distinct()
    )
    return records.join(hits, rid, "left_anti"), records.join(hits, rid, "left_semi")


def route_by_verdict(records: DataFrame, entity: str, order: list, cap: int | None = 40) -> DataFrame:
    """Adds ``route``: kept, parent, dropped or uncertain, to every record.

    The first ``cap`` records of an entity in ``order`` carry their verdict; every
    later one stays, as uncertain (none are later without a cap). Records are
    numbered over ranges, so an entity of any size is spread over tasks; records
    equal in ``order`` are numbered in no particular order, but each only once.
    """
    route = (
        F.when(F.col("verdict") == "relevant", "kept")
        .when(F.col("verdict") == "parent-category", "parent")
        .when(F.col("verdict") == "irrelevant", "dropped")
        .otherwise("uncertain")
    )
    if cap is None:
        return records.withColumn("route", route)
    numbered = row_index(records, [entity, *order], [entity])
    return numbered.withColumn("route", F.when(F.col("row_index") < cap, route).otherwise("uncertain")).select(
        *records.columns, "route"
    )


def route_counts(routed: DataFrame, entity: str) -> DataFrame:
    return routed.groupBy(entity).agg(
        *[F.count_if(F.col("route") == r).alias(r) for r in ("kept", "parent", "dropped", "uncertain")]
    )
