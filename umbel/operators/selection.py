"""Rankings, samples, work queues and target lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import text as T
from .confidence import zero
from .ranks import row_index


def neglect_ranking(df: DataFrame, n: int = 100, collation: str | None = None) -> DataFrame:
    """Least-studied entities first; equal ones by name, in a collation if one is given."""
    score = S.neglect_score("papers", "recent", "studies", "people", "gene_class")
    return (
        df.where(~F.col("excluded") & (F.col("health") != "broken"))
        .withColumn("score", score)
        .orderBy(F.col("score").desc(), T.display_key("name", collation), "code")
        .limit(n)
    )


def landscape_order(cells: DataFrame, metric: str, kind: str, mode: str = "intensity", collation: str | None = None) -> DataFrame:
    name = T.display_key("name", collation)
    if mode == "alpha":
        return cells.orderBy(name, "code")
    value = F.coalesce(F.col(metric), F.lit(-1))
    return cells.orderBy(value.desc(), S.signal_level(metric, kind).desc(), name, "code")


def seed_hash(seed: T.C | int, *keys: T.C) -> Column:
    """Hex hash that orders rows reproducibly for a seed."""
    first = F.lit(str(seed)) if isinstance(seed, (int, str)) else seed
    return F.md5(F.concat_ws(":", first, *[T.col(k).cast("string") for k in keys]))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows chosen by a seed, the same ones on every run."""
    return df.orderBy(seed_hash(seed, key), key).limit(n)


def hash_sample_per_group(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """Per group the ``n`` rows with the smallest hash of ``group:key``."""
    h = F.md5(F.concat_ws(":", F.col(group).cast("string"), F.col(key).cast("string")))
    w = W.partitionBy(group).orderBy("hash", key)
    return df.withColumn("hash", h).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def global_hash_sample(df: DataFrame, label: str, keys: list[str], n: int = 10) -> DataFrame:
    """The ``n`` rows with the smallest hash over all; see ``enough_rows``."""
    return df.withColumn("hash", seed_hash(label, *keys)).orderBy("hash", *keys).limit(n)


def enough_rows(df: DataFrame, n: int = 10) -> DataFrame:
    return df.agg(F.count("*").alias("available")).withColumn("enough", F.col("available") >= n)


def work_sessions(df: DataFrame, keys: list[str], size: int = 50, label: str = "session") -> DataFrame:
    """Numbers all rows in hash order; session is ``floor(i / size) + 1``."""
    hashed = df.withColumn("hash", seed_hash(label, *keys))
    numbered = row_index(hashed, ["hash", *keys])
    return numbered.withColumn("session", F.floor(F.col("row_index") / size) + 1).drop("total")


def band_positions(cells: DataFrame, level: str, order: list[str]) -> DataFrame:
    """Position of each cell in its level, 0 to 1 in order; 0.5 when alone."""
    placed = row_index(cells, order, [level])
    t = F.when(F.col("total") <= 1, F.lit(0.5)).otherwise(F.col("row_index") / (F.col("total") - 1))
    return placed.withColumn("position", t).drop("row_index", "total")


def priority_queue(
    queue: DataFrame, contaminated: DataFrame, known: DataFrame, limit: int = 150
) -> DataFrame:
    """Queue order first, then contaminated rows by oldest check.

    ``queue`` has ``code, at``; ``contaminated`` has ``code, last_check`` (null
    first). Each code keeps its first place; ``origin`` tells where from.
    """
    first = queue.join(known.select("code").distinct(), "code", "left_semi").select(
        "code", F.lit(0).alias("part"), F.col("at").alias("when"), F.lit("queue").alias("origin")
    )
    second = contaminated.select(
        "code", F.lit(1).alias("part"),
        F.coalesce(F.col("last_check").cast("timestamp"), F.lit(0).cast("timestamp")).alias("when"),
        F.lit("contamination").alias("origin"),
    )
    rows = first.unionByName(second)
    place = F.struct("part", "when", "origin")
    return (
        rows.groupBy("code").agg(F.min(place).alias("p"))
        .select("code", "p.part", "p.when", "p.origin")
        .orderBy("part", "when", F.col("code").cast("long"), "code")
        .limit(limit)
    )


def origin_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("origin").agg(F.count("*").alias("n"))


def zero_refresh_targets(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Measured zeros of sound queries."""
    rows = df.where(zero("studies") & (F.col("health") != "broken"))
    return rows if limit is None else rows.orderBy(F.col("code").cast("long"), "code").limit(limit)


def select_targets(
    df: DataFrame, codes: DataFrame | None = None, start: int = 0, limit: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """``(targets, missing codes)``: a code list, then offset and limit by code."""
    missing = None
    rows = df
    if codes is not None:
        rows = df.join(codes.select("code").distinct(), "code", "left_semi")
        missing = codes.select("code").distinct().join(df.select("code"), "code", "left_anti")
    if start or limit is not None:
        rows = rows.orderBy(F.col("code").cast("long"), "code")
        rows = rows.offset(start) if start else rows
        rows = rows.limit(limit) if limit is not None else rows
    return rows, missing


def gene_pass_targets(df: DataFrame, terms: str, query: str) -> DataFrame:
    """Rows with expansion terms that the stored query does not hold yet."""
    stored = F.coalesce(F.col(query), F.lit(""))
    held = F.forall(F.col(terms), lambda t: stored.contains(F.concat(F.lit('"'), t, F.lit('"'))))
    return df.where((F.size(terms) > 0) & ~held)
