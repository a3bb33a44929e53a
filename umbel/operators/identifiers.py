"""Cross-references and labels of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..runtime import parts_for
from .studies import first_n

BUCKETS = ["mesh", "umls", "omim", "ncit"]


def _parts(entity_ids: DataFrame, nodes: DataFrame, listed: str) -> int:
    """Partitions for the values of ``listed`` over all entities, which are counted by node."""
    held = entity_ids.groupBy("node").agg(F.count("*").alias("n"))
    rows = held.join(nodes.select(F.col("id").alias("node"), F.size(listed).alias("k")), "node").where("k > 0")
    return parts_for(entity_ids.sparkSession, rows.agg(F.sum(F.col("n") * F.col("k"))).first()[0] or 0)


def identifier_rows(entity_ids: DataFrame, nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """``(entity, bucket, value, at)``: each cross-reference of an entity's nodes once.

    ``entity_ids`` has ``entity, node, pos``; ``nodes`` has ``id, xrefs``; ``at`` is
    the place where a value was seen first. One row a value, so an entity with very
    many of them is rows like any other.
    """
    return (
        entity_ids.join(nodes.select(F.col("id").alias("node"), "xrefs"), "node")
        .select("entity", "pos", F.posexplode("xrefs").alias("xpos", "xref"))
        .select(
            "entity", I.xref_bucket("xref").alias("bucket"), I.xref_value("xref").alias("value"),
            F.struct("pos", "xpos").alias("at"),
        )
        .where(F.col("bucket").isNotNull() & (F.col("value") != ""))
        .repartition(parts or _parts(entity_ids, nodes, "xrefs"), "entity", "bucket", "value")
        .groupBy("entity", "bucket", "value")
        .agg(F.min("at").alias("at"))
    )


def _listed(rows: DataFrame, keys: list[str], order: list[str], value: str, cap: int | None) -> DataFrame:
    """``(keys, v)``: values as an array in order, the first ``cap`` if one is given."""
    if cap is not None:
        return first_n(rows, keys, order, cap, [value], "v").select(*keys, F.col(f"v.{value}").alias("v"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, value)))[value].alias("v"))


def collect_identifiers(entity_ids: DataFrame, nodes: DataFrame, cap: int | None = None) -> DataFrame:
    """``identifier_rows`` as arrays by bucket, in first-seen order; ``cap`` bounds each."""
    parts = _parts(entity_ids, nodes, "xrefs")
    rows = identifier_rows(entity_ids, nodes, parts).repartition(parts, "entity")
    lists = _listed(rows, ["entity", "bucket"], ["at"], "value", cap)
    per = lists.groupBy("entity").pivot("bucket", BUCKETS).agg(F.first("v"))
    own = _listed(entity_ids.select("entity", "pos", "node").repartition(parts, "entity").distinct(), ["entity"], ["pos"], "node", cap)
    empty = F.array().cast("array<string>")
    return own.join(per, "entity", "left").select(
        "entity", F.col("v").alias("nodes"), *[F.coalesce(b, empty).alias(b) for b in BUCKETS]
    )


def synonym_rows(entity_ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(entity, synonym, at)``: each exact synonym over an entity's nodes once."""
    return (
        entity_ids.join(nodes.select(F.col("id").alias("node"), "exact_synonyms"), "node")
        .select("entity", "pos", F.posexplode("exact_synonyms").alias("spos", "synonym"))
        .groupBy("entity", "synonym")
        .agg(F.min(F.struct("pos", "spos")).alias("at"))
    )


def collect_exact_synonyms(entity_ids: DataFrame, nodes: DataFrame, cap: int | None = None) -> DataFrame:
    """``synonym_rows`` as arrays in first-seen order; ``cap`` bounds them."""
    lists = _listed(synonym_rows(entity_ids, nodes), ["entity"], ["at"], "synonym", cap)
    return lists.select("entity", F.col("v").alias("synonyms"))


def label_rows(entity_ids: DataFrame, labels: DataFrame) -> DataFrame:
    """``(entity, pos, label)``: descriptor labels of each entity; ``labels`` has ``id, label``.

    Ids look like C or D and digits; labels shorter than three characters are
    dropped; equal labels in any case count once, the first id's spelling stays.
    """
    clean = labels.select(F.upper(T.strip("id")).alias("id"), T.strip("label").alias("label")).where(
        F.length("label") >= 3
    )
    return (
        entity_ids.select("entity", "pos", F.upper(T.strip("id")).alias("id"))
        .where(F.col("id").rlike(r"^[CD]\d+$"))
        .join(clean, "id")
        .groupBy("entity", F.lower("label").alias("k"))
        .agg(F.min(F.struct("pos", "label")).alias("first"))
        .select("entity", "first.pos", "first.label")
    )


def resolve_labels(entity_ids: DataFrame, labels: DataFrame, cap: int | None = None) -> DataFrame:
    """``label_rows`` as arrays in the order of ids; ``cap`` bounds them."""
    lists = _listed(label_rows(entity_ids, labels), ["entity"], ["pos"], "label", cap)
    return lists.select("entity", F.col("v").alias("labels"))


def needs_backfill(ids: T.C, labels: T.C) -> Column:
    """Fewer labels than ids."""
    known = F.coalesce(F.size(T.col(labels)), F.lit(0))
    return (F.size(T.col(ids)) > 0) & (known < F.size(T.col(ids)))


def backfill(df: DataFrame, ids: str, labels: str, fresh: str) -> DataFrame:
    """Outcome per row: filled, unchanged or still empty, with the new labels."""
    same = F.array_sort(F.transform(F.col(labels), F.lower)) == F.array_sort(
        F.transform(F.col(fresh), F.lower)
    )
    outcome = (
        F.when(~needs_backfill(ids, labels), "complete")
        .when(F.size(fresh) == 0, "still-empty")
        .when(same, "unchanged")
        .otherwise("filled")
    )
    return df.withColumn("outcome", outcome).withColumn(
        labels, F.when(F.col("outcome").isin("filled", "still-empty"), F.col(fresh)).otherwise(F.col(labels))
    )
