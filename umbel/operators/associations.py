"""Phenotypes, models, chemicals and drugs joined by node id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..runtime import materialize
from .studies import first_n


def summarise_phenotypes(entity_ids: DataFrame, assoc: DataFrame, sample: int = 5) -> DataFrame:
    """Count is the largest over the entity's ids; labels distinct in any case.

    ``entity_ids``: ``entity, node, pos``; ``assoc``: ``node, label, rank``.
    """
    per_node = assoc.groupBy("node").agg(F.count("*").alias("n"))
    counts = entity_ids.join(per_node, "node", "left").groupBy("entity").agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("phenotypes")
    )
    labels = (
        assoc.where(T.strip("label") != "")
        .groupBy("node", F.lower(T.strip("label")).alias("k"))
        .agg(F.min(F.struct("rank", T.strip("label").alias("label"))).alias("f"))
    )
    seen = (
        entity_ids.join(labels, "node").groupBy("entity", "k")
        .agg(F.min(F.struct("pos", "f")).alias("m"))
        .select("entity", F.col("m.f.label").alias("label"), F.struct("m.pos", "m.f.rank").alias("at"))
    )
    lists = first_n(seen, ["entity"], ["at", "label"], sample, ["label"], "sample")
    return counts.join(lists, "entity", "left")


def summarise_models(entity_ids: DataFrame, assoc: DataFrame, cap: int = 12) -> DataFrame:
    """Count is the sum over ids; models distinct by id, tags stripped.

    ``assoc``: ``node, model, label, taxon, rank``.
    """
    per_node = assoc.groupBy("node").agg(F.count("*").alias("n"))
    counts = entity_ids.join(per_node, "node", "left").groupBy("entity").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("models")
    )
    clean = F.regexp_replace(F.coalesce("label", "model"), "<[^>]+>", "")
    one = assoc.groupBy("node", "model").agg(
        F.min(F.struct("rank", clean.alias("label"), "taxon")).alias("f")
    )
    seen = (
        entity_ids.join(one, "node").groupBy("entity", "model")
        .agg(F.min(F.struct("pos", "f")).alias("m"))
        .select("entity", "model", "m.f.label", "m.f.taxon", F.struct("m.pos", "m.f.rank").alias("at"))
    )
    lists = first_n(seen, ["entity"], ["at", "model"], cap, ["model", "label", "taxon"], "listed")
    return counts.join(lists, "entity", "left")


def first_ids(entity_ids: DataFrame) -> DataFrame:
    """Each entity's first node."""
    return entity_ids.groupBy("entity").agg(F.min_by("node", "pos").alias("node"))


LISTS = {"chemicals": 12, "pathways": 8, "phenotypes": 8}
ENTRY = "array<struct<kind:string,key:string,rank:double,name:string,note:string>>"


def _entry(kind: str, key: Column, rank: Column, name: Column, note: Column, usable: Column) -> Column:
    one = F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), rank.cast("double").alias("rank"), name.alias("name"), note.cast("string").alias("note")
    )
    return F.when(usable, F.array(one)).otherwise(F.array().cast(ENTRY))


def annotation_entries(chemical: Column, evidence: Column, pathway: Column, rank: Column, sign_id: Column, sign: Column, freq: Column) -> Column:
    """The chemical, pathway and phenotype that one record names, as one array of entries.

    Chemicals are the same in any case, therapeutic ones come first; pathways are the
    same in any case, by rank; phenotypes are the same by id, the frequent first.
    Unnamed ones make no entry.
    """
    therapeutic = F.coalesce(evidence.rlike("(?i)therapeutic"), F.lit(False))
    some = lambda c: F.coalesce(T.strip(c) != "", F.lit(False))
    return F.concat(
        _entry("chemicals", F.lower(T.strip(chemical)), F.when(therapeutic, 0).otherwise(1), T.strip(chemical), evidence, some(chemical)),
        _entry("pathways", F.lower(T.strip(pathway)), rank, T.strip(pathway), F.lit(None), some(pathway)),
        _entry("phenotypes", T.strip(sign_id), -F.coalesce(freq, F.lit(-1.0)), T.strip(sign), F.lit(None), some(sign_id) & some(sign)),
    )


def summarise_annotations(entity_ids: DataFrame, records: DataFrame) -> DataFrame:
    """Chemicals, pathways and phenotypes of the entity's first id, in one pass.

    ``records`` has ``node`` and ``entries`` (see ``annotation_entries``). Distinct
    entries are made once for all kinds and written; counts are over all, lists are
    twelve chemicals, eight pathways and eight phenotypes.
    """
    ids = first_ids(entity_ids)
    mine = records.join(ids.select("node").distinct(), "node", "left_semi").select("node", F.explode("entries").alias("e")).select("node", "e.*")
    entries = materialize(
        mine.groupBy("node", "kind", "key").agg(F.min(F.struct("rank", "name", "note")).alias("m")).select("node", "kind", "key", "m.*"),
        "annotations",
    )
    counts = entries.groupBy("node").agg(*[F.count_if(F.col("kind") == kind).alias(f"{kind}_count") for kind in LISTS])
    # Phenotypes of one frequency go by id, the others by name.
    tie = F.when(F.col("kind") == "phenotypes", F.col("key")).otherwise(F.col("name"))
    most = F.create_map(*[F.lit(x) for pair in LISTS.items() for x in pair])
    w = W.partitionBy("node", "kind").orderBy("rank", "tie")
    ranked = entries.withColumn("tie", tie).withColumn("at", F.row_number().over(w)).where(F.col("at") <= max(LISTS.values()))
    ranked = ranked.where(F.col("at") <= F.element_at(most, F.col("kind")))

    def listed(kind: str, *fields: str) -> Column:
        row = F.struct("at", F.col("name"), F.col("note").alias("evidence"), F.col("key").alias("id"))
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, row)))
        return F.when(F.size(rows) > 0, F.transform(rows, lambda r: F.struct(*[r[f].alias(f) for f in fields]))).alias(kind)

    lists = ranked.groupBy("node").agg(listed("chemicals", "name", "evidence"), listed("pathways", "name"), listed("phenotypes", "id", "name"))
    zeros = {f"{kind}_count": F.coalesce(f"{kind}_count", F.lit(0)) for kind in LISTS}
    return ids.join(counts, "node", "left").join(lists, "node", "left").withColumns(zeros)


def summarise_chemicals(
    entity_ids: DataFrame, chemicals: DataFrame, pathways: DataFrame, phenotypes: DataFrame
) -> DataFrame:
    """As ``summarise_annotations``, from three tables, each read once.

    Chemicals: ``node, name, evidence``; pathways: ``node, name, rank``; phenotypes:
    ``node, id, name, freq``.
    """
    none = F.lit(None).cast("string")
    zero = F.lit(0.0)
    rows = [
        chemicals.select("node", annotation_entries(F.col("name"), F.col("evidence"), none, zero, none, none, zero).alias("entries")),
        pathways.select("node", annotation_entries(none, none, F.col("name"), F.col("rank"), none, none, zero).alias("entries")),
        phenotypes.select("node", annotation_entries(none, none, none, zero, F.col("id"), F.col("name"), F.col("freq")).alias("entries")),
    ]
    return summarise_annotations(entity_ids, reduce(DataFrame.unionByName, rows))


def stage_rank(c: T.C):
    ladder = F.when(F.lit(False), 0.0)
    for stage, rank in vocab.STAGE_RANK.items():
        ladder = ladder.when(T.col(c) == stage, rank)
    return ladder.otherwise(-1.0)


def summarise_drugs(entity_ids: DataFrame, drugs: DataFrame, cap: int = 15) -> DataFrame:
    """Drugs of the entity's first id: most advanced stage first, then name.

    ``drugs``: ``node, drug, name, stage`` and optionally ``source_count``, which
    then stands for the count. Only the list is cut at ``cap``; ``drug_count`` is
    over all distinct drugs.
    """
    ids = first_ids(entity_ids)
    one = (
        drugs.where((T.strip("drug") != "") & (T.strip("name") != ""))
        .groupBy("node", T.strip("drug").alias("drug"))
        .agg(F.min(F.struct((-stage_rank("stage")).alias("r"), T.strip("name").alias("name"), "stage")).alias("m"))
        .select("node", "drug", "m.r", "m.name", "m.stage")
    )
    lists = first_n(one, ["node"], ["r", "name", "drug"], cap, ["drug", "name", "stage"], "drugs")
    found = ids.join(lists, "node", "left")
    every = one.groupBy("node").agg(F.count("*").alias("distinct_drugs"))
    found = found.join(every, "node", "left")
    listed = F.coalesce("distinct_drugs", F.lit(0))
    if "source_count" in drugs.columns:
        counts = drugs.groupBy("node").agg(F.max("source_count").alias("source_count"))
        found = found.join(counts, "node", "left")
        listed = F.coalesce("source_count", listed)
    return found.withColumn("drug_count", listed.cast("long")).drop("source_count", "distinct_drugs")
