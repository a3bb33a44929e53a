"""Evidence and policy joined to entities by identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def evidence_rows(
    entity_keys: DataFrame, evidence: DataFrame, entity: str, key: str, rank: str, symbol: str
) -> DataFrame:
    """``(entity, rank, symbol)``: the best rank over an entity's keys, a row for each symbol tied at it.

    A key's rank is its best row, its symbols are all of its rows. An entity without
    symbols at its best rank has one row with a null symbol, without any evidence a
    null rank too.
    """
    best = evidence.groupBy(key).agg(F.max(rank).alias("rank"))
    symbols = evidence.where(F.col(symbol).isNotNull() & (F.col(symbol) != "")).select(key, F.col(symbol).alias("symbol")).distinct()
    ranked = entity_keys.select(entity, key).distinct().join(best, key)
    top = ranked.groupBy(entity).agg(F.max("rank").alias("rank"))
    tied = ranked.join(top, [entity, "rank"]).join(symbols, key).select(entity, "symbol").distinct()
    return entity_keys.select(entity).distinct().join(top, entity, "left").join(tied, entity, "left").select(entity, "rank", "symbol")


def best_evidence(
    entity_keys: DataFrame, evidence: DataFrame, entity: str, key: str, rank: str, symbol: str, cap: int | None = None
) -> DataFrame:
    """``evidence_rows`` as a sorted array per entity; ``cap`` bounds it."""
    rows = evidence_rows(entity_keys, evidence, entity, key, rank, symbol)
    if cap is not None:
        at = F.row_number().over(W.partitionBy(entity).orderBy("symbol"))
        rows = rows.withColumn("_at", at).where(F.col("_at") <= cap)
    return rows.groupBy(entity).agg(F.max("rank").alias("rank"), F.array_sort(F.collect_list("symbol")).alias("symbols"))


def evidence_class(rank: T.C) -> Column:
    """Class name of a rank; ``None`` without evidence."""
    ladder = F.when(F.lit(False), "")
    for name, r in vocab.EVIDENCE_RANK.items():
        ladder = ladder.when(T.col(rank) == r, name)
    return ladder.otherwise("None")


def evidence_rank(name: T.C) -> Column:
    ladder = F.when(F.lit(False), 0)
    for n, r in vocab.EVIDENCE_RANK.items():
        ladder = ladder.when(T.col(name) == n, r)
    return ladder


def policy_nodes(policy: DataFrame, code_nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes each policy entry stands for: ``(policy_id, node)``.

    By code crosswalk, by equality of a node label with the entry's name or its
    stripped forms, and by the wording table.
    """
    by_code = policy.join(code_nodes, "code").select("policy_id", "node")
    forms = F.array_distinct(
        F.array(
            F.lower("name"),
            F.lower(T.strip(F.regexp_replace("name", r"\s*[—(].*$", ""))),
            F.lower(T.strip(F.regexp_replace("name", r"\s*—.*$", ""))),
        )
    )

    def worded(prefix: str, labels: list[str]) -> Column:
        return F.when(F.exists(forms, lambda f: f.startswith(prefix)), T.words_literal(labels))

    wording = [worded(prefix, names) for prefix, names in vocab.POLICY_ALIASES.items()]
    wanted = F.array_distinct(F.flatten(F.array_compact(F.array(forms, *wording))))
    named = policy.select("policy_id", F.explode(wanted).alias("k"))
    # One node per label: the smallest id stands for the first one read.
    usable = (
        labels.where(~F.col("label").rlike("(?i)^obsolete "))
        .groupBy(F.lower("label").alias("k")).agg(F.min("id").alias("node"))
    )
    return by_code.unionByName(named.join(usable, "k").select("policy_id", "node")).distinct()


def policy_match(
    entities: DataFrame, entity_ids: DataFrame, policy: DataFrame, nodes: DataFrame,
    closure: DataFrame, entitlements: DataFrame,
) -> DataFrame:
    """Direct by code; else through the first linked ancestor.

    The entity's ids are walked in order, nearest ancestor first; its own nodes
    never count. Groups are sorted and distinct, entitlements follow the groups.
    Where every entity has one node, ``graph.nearest`` of the linked nodes will do for
    ``closure``.
    """
    rules = policy.select("policy_id", "code", F.col("name").alias("policy_name"), "group")
    direct = (
        entities.select("entity", "code").join(rules, "code")
        .select("entity", F.lit("direct").alias("via"), F.lit(None).cast("string").alias("ancestor"),
                F.lit(None).cast("string").alias("label"), "group")
    )
    rest = entity_ids.join(direct.select("entity").distinct(), "entity", "left_anti")
    own = rest.select("entity", F.col("node").alias("ancestor"))
    linked = nodes.join(rules, "policy_id").select(
        F.col("node").alias("ancestor"), "policy_id", "policy_name", "group"
    )
    walked = (
        rest.join(closure, "node")
        .join(own, ["entity", "ancestor"], "left_anti")
        .join(linked.select("ancestor").distinct(), "ancestor", "left_semi")
        .groupBy("entity")
        .agg(F.min_by("ancestor", F.struct("pos", "depth", "path")).alias("ancestor"))
    )
    label = linked.groupBy("ancestor").agg(F.min_by("policy_name", "policy_id").alias("label"))
    indirect = (
        walked.join(label, "ancestor").join(linked.select("ancestor", "group"), "ancestor")
        .select("entity", F.lit("parent").alias("via"), "ancestor", "label", "group")
    )
    hits = direct.unionByName(indirect).distinct()
    per_group = hits.join(entitlements, "group", "left")
    packed = per_group.groupBy("entity").agg(
        F.max("via").alias("via"), F.max("ancestor").alias("ancestor"), F.max("label").alias("label"),
        F.array_sort(F.collect_set("group")).alias("groups"),
        F.array_sort(F.collect_set(F.struct("group", "entitlement")))["entitlement"].alias("entitlements"),
    )
    return (
        entities.select("entity").join(packed, "entity", "left")
        .withColumn("listed", F.col("via").isNotNull())
    )


def reconcile_policy(policy: DataFrame, catalogue: DataFrame, claim: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(missing, totals, repeated)``.

    Codes absent from the catalogue, unique codes against the official claim,
    and codes listed more than once.
    """
    coded = policy.where(F.col("code").isNotNull())
    missing = coded.join(catalogue.select("code").distinct(), "code", "left_anti")
    per_code = coded.groupBy("code").agg(F.count("*").alias("listed"))
    totals = per_code.agg(
        F.sum("listed").alias("coded_entries"), F.count("*").alias("unique_codes"),
    ).withColumn("delta", F.col("unique_codes") - claim)
    return missing, totals, per_code.where(F.col("listed") > 1)
