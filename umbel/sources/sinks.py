"""Artifacts, resume and publish checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signals import data_as_of
from ..runtime import side_by_side

SAMPLING = ["mode", "n", "seed"]


def write_artifact(df: DataFrame, path: str) -> None:
    """The corpus as Parquet and as gzip JSON; each commit is all or nothing."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/json")


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/parquet")


def pending(targets: DataFrame, done: DataFrame, key: str = "code") -> DataFrame:
    """Targets not finished yet."""
    return targets.join(done.select(key), key, "left_anti")


def compatible_resume(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Raise when the two one-row sampling records differ."""
    a, b = previous.select(*SAMPLING).first(), current.select(*SAMPLING).first()
    if a is None or a != b:
        raise ValueError(f"resume refused: sampling was {a}, now {b}")
    return current


def publish_counts(df: DataFrame) -> DataFrame:
    """Rows, and measured rows that were not fully scanned."""
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("studies").isNotNull() & ~F.coalesce("fully_scanned", F.lit(False))).alias("incomplete"),
    )


def publish_gate(df: DataFrame, target: int, failed: int = 0) -> DataFrame:
    """The frame itself, or an error that says why it may not be published."""
    row = publish_counts(df).first()
    problems = []
    if failed > 0:
        problems.append(f"{failed} entities failed")
    if row["rows"] != target:
        problems.append(f"{row['rows']} rows, expected {target}")
    if row["incomplete"]:
        problems.append(f"{row['incomplete']} measured rows not fully scanned")
    if problems:
        raise ValueError("not published: " + "; ".join(problems))
    return df


def progress(done: DataFrame, target: int | None = None, usable: DataFrame | None = None) -> DataFrame:
    """``done, target, percent`` to one decimal, at most 100.

    The target is given for a sample or a limit; otherwise it is the corpus.
    """
    counts = done.agg(F.count("*").alias("done"))
    if target is None:
        if usable is None:
            raise ValueError("give a target or the corpus")
        counts = side_by_side(counts, usable.agg(F.count("*").alias("target")))
        counts = counts.withColumn("target", F.greatest("target", "done"))
    else:
        counts = counts.withColumn("target", F.lit(target).cast("long"))
    percent = F.floor(F.col("done") * 1000.0 / F.col("target") + 0.5) / 10.0
    return counts.withColumn("percent", F.when(F.col("target") > 0, F.least(percent, F.lit(100.0))))


def artifact_date(provenance: DataFrame) -> DataFrame:
    """Latest of the three provenance timestamps."""
    return provenance.select(
        data_as_of("last_full_ingest", "last_refresh", "generated_at").alias("data_as_of")
    )


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
