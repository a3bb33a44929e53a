"""Publishing, progress and samples judged by what the write itself has counted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import global_hash_sample

OUTCOME = "version string, rows long, incomplete long, target long, failed long, published boolean, reasons array<string>"


def observed_write(df: DataFrame, path: str, **metrics) -> dict:
    """Write ``df`` and return ``metrics`` over its rows, counted by the same job."""
    seen = Observation()
    df.observe(seen, *[expr.alias(name) for name, expr in metrics.items()]).write.parquet(path)
    return {name: seen.get.get(name) for name in metrics}


def publish(df: DataFrame, path: str, target: int, failed: int = 0) -> DataFrame:
    """Write a version and decide by its own figures; ``OUTCOME``, one row.

    Refused if any entity failed, if rows are missing or too many, or if a measured
    row was not fully scanned. A refused version stays unlisted: ``read_published``
    follows the list of outcomes and takes the last one published.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    found = observed_write(
        df, f"{path}/versions/{version}", rows=F.count(F.lit(1)),
        incomplete=F.count_if(F.col("studies").isNotNull() & ~F.coalesce("fully_scanned", F.lit(False))),
    )
    reasons = [
        reason for reason, bad in (
            ("entities-failed", failed > 0), ("wrong-number-of-rows", found["rows"] != target), ("not-fully-scanned", found["incomplete"] > 0),
        ) if bad
    ]
    outcome = spark.createDataFrame([(version, found["rows"], found["incomplete"], target, failed, not reasons, reasons)], OUTCOME)
    outcome.withColumn("at", F.current_timestamp()).write.mode("append").json(f"{path}/outcomes")
    return outcome


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the version published last."""
    last = spark.read.schema(f"{OUTCOME}, at timestamp").json(f"{path}/outcomes").where("published").orderBy(F.desc("at")).first()
    if last is None:
        raise ValueError(f"nothing published under {path}")
    return spark.read.parquet(f"{path}/versions/{last['version']}")


def append_done(df: DataFrame, path: str, target: int) -> DataFrame:
    """Append finished rows and return ``(added, done, target, percent)``.

    What was added is counted by the write; what was there before stands in the log of
    earlier writes, so the rows already done are not read again.
    """
    spark = df.sparkSession
    added = observed_write(df, f"{path}/rows/batch={uuid.uuid4().hex}", added=F.count(F.lit(1)))["added"]
    log = f"{path}/log"
    spark.createDataFrame([(added,)], "added long").write.mode("append").json(log)
    done = spark.read.schema("added long").json(log).agg(F.sum("added").alias("done"))
    percent = F.floor(F.col("done") * 1000.0 / F.lit(target) + 0.5) / 10.0
    return done.select(
        F.lit(added).alias("added"), "done", F.lit(target).cast("long").alias("target"),
        F.when(F.lit(target > 0), F.least(percent, F.lit(100.0))).alias("percent"),
    )


def write_sample(df: DataFrame, path: str, label: str, keys: list[str], n: int = 10) -> DataFrame:
    """Write a global hash sample and return ``(wanted, drawn, enough)``, counted by the write."""
    drawn = observed_write(global_hash_sample(df, label, keys, n), path, drawn=F.count(F.lit(1)))["drawn"]
    return df.sparkSession.createDataFrame([(n, drawn, drawn >= n)], "wanted long, drawn long, enough boolean")
