"""Orphan-drug designations joined to entities by identifier and by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import materialize
from .studies import first_n

LIST_CAP = 15
MERGED_CAP = 20
FIELDS = ["generic", "text", "date", "status"]


def is_approved(status: T.C) -> Column:
    return F.coalesce(T.col(status).rlike("(?i)fda approved for orphan indication"), F.lit(False))


def is_positive(status: T.C) -> Column:
    return F.coalesce(F.lower(T.strip(status)) == "positive", F.lit(False))


def _order(top: str = "top") -> list[Column]:
    return [F.col(top).desc(), F.coalesce("date", F.lit("")).desc(), F.col("generic"), F.col("text")]


def designation_facts(rows: DataFrame, kinds: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """``(kind, tag, ..., rest)``: distinct designations by each way they are found.

    ``kinds`` maps a kind to what its tag is, ``ids`` or ``key``, and to the fields
    that make designations the same; ``rest`` holds the other fields, of the smallest
    of equal designations. Every fact is expanded into its tags and grouped once,
    whatever the number of kinds, and the result is a table in the shared folder:
    what follows reads that, not the facts.
    """
    fields = list(dict.fromkeys(f for _, identity in kinds.values() for f in identity))
    types = {f.name: f.dataType.simpleString() for f in rows.schema["row"].dataType.fields}
    # Fields behind the last listed one decide nothing that is shown.
    last = max(i for i, f in enumerate(types) if f in FIELDS)
    others = list(types)[: last + 1]
    row = F.col("row")

    def tagged(kind: str, tag: Column, identity: tuple[str, ...]) -> Column:
        own = [F.when(F.lit(f in identity), row[f]).alias(f"_{f}") for f in fields]
        rest = F.struct(*[F.when(F.lit(f not in identity), row[f]).alias(f) for f in others])
        return F.struct(F.lit(kind).alias("kind"), tag.alias("tag"), *own, rest.alias("rest"))

    own_type = (
        f"array<struct<kind:string,tag:string,{','.join(f'_{f}:{types[f]}' for f in fields)},"
        f"rest:struct<{','.join(f'{f}:{types[f]}' for f in others)}>>>"
    )
    none, tags = F.array().cast(own_type), []
    for kind, (source, identity) in kinds.items():
        if source == "ids":
            ids = F.filter(F.transform("ids", lambda i: F.upper(T.strip(i))), lambda i: i != "")
            tags.append(F.coalesce(F.transform(ids, lambda i: tagged(kind, i, identity)).cast(own_type), none))
        else:
            tags.append(F.when(F.length("key") >= 4, F.array(tagged(kind, F.col("key"), identity)).cast(own_type)).otherwise(none))
    flat = T.exploded(rows, F.concat(*tags), "t").select("t.*")
    keys = ["kind", "tag", *[f"_{f}" for f in fields]]
    # The smallest is found by sorting, and a number in front decides most comparisons.
    one = flat.groupBy(F.xxhash64(*keys).alias("h"), *keys).agg(F.min("rest").alias("rest"))
    return materialize(one.drop("h"), "designations", by="kind")


def _first_rows(df: DataFrame, keys: list[str], order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each key; tasks forward no more of a key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def _counted(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("top").alias("n_top"))


def _topped(df: DataFrame, keys: list[str], top) -> DataFrame:
    return df.withColumn("top", top(F.col("row.status"))).select(*keys, "top", *[f"row.{f}" for f in FIELDS])


def _entity_ids(entity_ids: DataFrame) -> DataFrame:
    return entity_ids.select("entity", F.upper(T.strip("id")).alias("tag")).where("tag != ''").distinct()


def _by_id(entity_ids: DataFrame, facts: DataFrame, top, cap: int) -> tuple[DataFrame, DataFrame]:
    """Counts and first rows of designations sharing an identifier with the entity; one that several ids share counts once."""
    fields = [c for c in facts.columns if c.startswith("_")]
    found = _entity_ids(entity_ids).join(facts, "tag").groupBy("entity", *fields).agg(F.min("rest").alias("rest"))
    rows = _topped(found.withColumn("row", _row(found)), ["entity"], top)
    return _counted(rows, ["entity"]), _first_rows(rows, ["entity"], _order(), cap)


def _by_name(entity_names: DataFrame, facts: DataFrame, top, cap: int, name_stop: int | None) -> tuple[DataFrame, DataFrame]:
    """Counts and rows of designations whose key equals a name; with ``name_stop`` names are read until so many are found.

    The key is made from the designation's text and the text is part of its
    identity, so different names never share a designation. Counts and first
    rows are therefore made once per key and added up per entity: however many
    entities own a name and however many rows carry it, no more than ``cap`` rows
    of a name meet an entity.
    """
    if "_text" not in facts.columns:
        raise ValueError("the text names the key, so it has to be part of the identity")
    rows = _topped(facts.withColumn("row", _row(facts)), ["tag"], top)
    names = (
        entity_names.select("entity", "pos", T.normalize_term("name").alias("tag"))
        .where(F.length("tag") >= 4)
        .groupBy("entity", "tag").agg(F.min("pos").alias("pos"))
    )
    read = names.join(_counted(rows, ["tag"]), "tag")
    if name_stop is not None:
        # The names of one entity: a short window.
        w = W.partitionBy("entity").orderBy("pos", "tag").rowsBetween(W.unboundedPreceding, -1)
        read = read.withColumn("earlier", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("earlier") < name_stop)
    counts = read.groupBy("entity").agg(F.sum("n").alias("n"), F.sum("n_top").alias("n_top"))
    asked = names if name_stop is None else read
    return counts, asked.select("entity", "tag").join(_first_rows(rows, ["tag"], _order(), cap), "tag").drop("tag")


def _row(facts: DataFrame) -> Column:
    """The designation of a fact: each field is in its identity or in the rest."""
    return F.struct(*[
        (F.coalesce(f"_{f}", f"rest.{f}") if f"_{f}" in facts.columns else F.col(f"rest.{f}")).alias(f) for f in FIELDS
    ])


def _result(found: tuple[DataFrame, DataFrame], agency: str, cap: int) -> DataFrame:
    counts, rows = found
    listed = first_n(rows, ["entity"], _order(), cap, ["top", *FIELDS], "listed")
    return counts.join(listed, "entity", "left").select(
        "entity", F.lit(agency).alias("agency"), "matched_via", F.col("n").alias("designations"), F.col("n_top").alias("approved"), "listed"
    )


FDA_IDENTITY = ("generic", "text", "date")
EMA_IDENTITY = ("number", "generic", "text")


def _kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind).drop("kind")


def _fda(
    entity_ids: DataFrame, entity_names: DataFrame, facts: DataFrame, cap: int, name_stop: int | None
) -> tuple[DataFrame, DataFrame]:
    own = _kind(facts, "fda-id")
    ids, id_rows = _by_id(entity_ids, own, is_approved, cap)
    known = _entity_ids(entity_ids).join(own.select("tag").distinct(), "tag", "left_semi")
    rest = entity_names.join(known.select("entity"), "entity", "left_anti")
    names, name_rows = _by_name(rest, _kind(facts, "fda-name"), is_approved, cap, name_stop)
    counts = ids.withColumn("matched_via", F.lit("umls")).unionByName(names.withColumn("matched_via", F.lit("name")))
    return counts, id_rows.unionByName(name_rows)


def _ema(entity_names: DataFrame, facts: DataFrame, cap: int, name_stop: int | None) -> tuple[DataFrame, DataFrame]:
    counts, rows = _by_name(entity_names, _kind(facts, "ema-name"), is_positive, cap, name_stop)
    return counts.withColumn("matched_via", F.lit("name")), rows


def fda_match(
    entity_ids: DataFrame, entity_names: DataFrame, rows: DataFrame,
    identity: tuple[str, ...] = FDA_IDENTITY, cap: int = LIST_CAP, name_stop: int | None = None,
) -> DataFrame:
    """Per entity: counts over all matches and the first ``cap``, by id or by name.

    All names are read; ``name_stop`` stops once so many designations are found.

    Names count only where no id hits. ``rows`` has ``ids`` (array), ``key``
    (name key) and ``row`` (struct with ``generic, text, date, status``), and is read
    once. Listed: approved first, then newest.
    """
    facts = designation_facts(rows, {"fda-id": ("ids", identity), "fda-name": ("key", identity)})
    return _result(_fda(entity_ids, entity_names, facts, cap, name_stop), "fda", cap)


def ema_match(
    entity_names: DataFrame, rows: DataFrame,
    identity: tuple[str, ...] = EMA_IDENTITY, cap: int = LIST_CAP, name_stop: int | None = None,
) -> DataFrame:
    """As ``fda_match``, by name only; positive first."""
    facts = designation_facts(rows, {"ema-name": ("key", identity)})
    return _result(_ema(entity_names, facts, cap, name_stop), "ema", cap)


def all_designations(
    entity_ids: DataFrame, entity_names: DataFrame, rows: DataFrame,
    cap: int = MERGED_CAP, name_stop: int | None = None,
) -> DataFrame:
    """Both agencies' matches in the same ``rows``, merged; the rows are read once."""
    facts = designation_facts(
        rows, {"fda-id": ("ids", FDA_IDENTITY), "fda-name": ("key", FDA_IDENTITY), "ema-name": ("key", EMA_IDENTITY)}
    )
    found = {
        "fda": _fda(entity_ids, entity_names, facts, cap, name_stop), "ema": _ema(entity_names, facts, cap, name_stop),
    }
    counts, rows = (
        reduce(DataFrame.unionByName, [both[i].withColumn("agency", F.lit(agency)) for agency, both in found.items()]) for i in (0, 1)
    )
    return _merged(counts.withColumnsRenamed({"n": "designations", "n_top": "approved"}), rows, cap)


def merge_designations(fda: DataFrame, ema: DataFrame, cap: int = MERGED_CAP) -> DataFrame:
    """Approved first agency, positive second agency, then the rest, newest first.

    Counts are over all matches. The list is that of all matches too when each
    agency's list was made with at least this ``cap``.
    """
    both = fda.unionByName(ema)
    return _merged(both, both.select("entity", "agency", F.explode("listed").alias("r")).select("entity", "agency", "r.*"), cap)


def _merged(both: DataFrame, rows: DataFrame, cap: int) -> DataFrame:
    """``both`` has an agency's counts of an entity, ``rows`` its first designations."""
    counts = both.groupBy("entity").agg(
        F.sum("designations").alias("designations"),
        F.sum(F.when(F.col("agency") == "fda", F.col("designations")).otherwise(0)).alias("fda_count"),
        F.sum(F.when(F.col("agency") == "ema", F.col("designations")).otherwise(0)).alias("ema_count"),
        F.sum(F.when(F.col("agency") == "fda", F.col("approved")).otherwise(0)).alias("approved"),
    )
    source = (
        F.when((F.col("fda_count") > 0) & (F.col("ema_count") > 0), "fda-oopd+ema")
        .when(F.col("ema_count") > 0, "ema")
        .otherwise("fda-oopd")
    )
    tier = F.when(F.col("top") & (F.col("agency") == "fda"), 0).when(F.col("top"), 1).otherwise(2)
    order = ["tier", F.coalesce("date", F.lit("")).desc(), "generic", "text"]
    lists = first_n(rows.withColumn("tier", tier), ["entity"], order, cap, ["agency", *FIELDS], "listed")
    return counts.withColumn("source", source).join(lists, "entity", "left")
