"""Dated snapshots with digests: comparing two reads only what differs, listing reads no data.

A snapshot is laid out by buckets of its key. Its manifest has one row per bucket:
how many rows, and a digest, the sum of their hashes, which does not depend on the
order or the files of the rows. Sums of eight buckets each make an upper level, so a
comparison looks at groups first and at the buckets of unequal groups only. Manifests
have as many rows as there are buckets, whatever the size of the data.

Layout under ``path``: ``data/snapshot_date=…/version=…/bucket=…`` and
``manifest/snapshot_date=…``. A date belongs to the writer that creates its claim
first; the file system decides. Data of a writer that lost or died is never listed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..runtime import claim_file, path_exists
from ..operators.reconcile import snapshot_diff

BUCKETS = 64
GROUP = 8
MANIFEST = "version string, columns string, buckets int, key string, bucket int, rows long, digest decimal(38,0), snapshot_date string"


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.lit("bucket"), F.col(key)), F.lit(buckets)).cast("int")


def write_snapshot(df: DataFrame, path: str, date: str, key: str | None = None, buckets: int = BUCKETS) -> None:
    """A dated snapshot of ``df`` by ``key`` (its first column); an existing date is refused.

    Rows are hashed whole, all columns by name, nulls included. The number of
    buckets grows with the data by the caller's choice; snapshots to be compared
    have the same.
    """
    spark, key, version = df.sparkSession, key or df.columns[0], uuid.uuid4().hex
    if path_exists(spark, f"{path}/claims/{date}"):
        raise FileExistsError(f"snapshot {date} exists under {path}")
    data = f"{path}/data/snapshot_date={date}/version={version}"
    laid = df.withColumn("bucket", _bucket(key, buckets)).repartition("bucket")
    laid.write.partitionBy("bucket").parquet(data)
    whole = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), *sorted(c for c, t in df.dtypes if t in ("double", "float", "string")))
    digests = spark.read.schema(laid.schema).parquet(data).groupBy("bucket").agg(
        F.count("*").alias("rows"), F.sum(whole.cast("decimal(38,0)")).alias("digest")
    )
    if not claim_file(spark, f"{path}/claims/{date}"):
        raise FileExistsError(f"snapshot {date} was written by another under {path}")
    digests.select(
        F.lit(version).alias("version"), F.lit(df.schema.json()).alias("columns"), F.lit(buckets).alias("buckets"), F.lit(key).alias("key"), "bucket", "rows", "digest"
    ).unionByName(
        # An empty snapshot has a row too.
        spark.createDataFrame([(version, df.schema.json(), buckets, key, -1, 0)], "version string, columns string, buckets int, key string, bucket int, rows long").withColumn("digest", F.lit(0).cast("decimal(38,0)"))
    ).coalesce(1).write.parquet(f"{path}/manifest/snapshot_date={date}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("basePath", f"{path}/manifest").parquet(f"{path}/manifest")


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """``(snapshot_date, rows)``, newest first, from the manifests alone."""
    return manifest(spark, path).groupBy("snapshot_date").agg(F.sum("rows").alias("rows")).orderBy(F.col("snapshot_date").desc())


def read_snapshot(spark: SparkSession, path: str, date: str, buckets: list[int] | None = None) -> DataFrame:
    """Rows of one date, of the given buckets only if any are given."""
    made = manifest(spark, path).where(F.col("snapshot_date") == date).first()
    if made is None:
        raise ValueError(f"no snapshot {date} under {path}")
    folder = f"{path}/data/snapshot_date={date}/version={made['version']}"
    rows = spark.read.schema(StructType.fromJson(json.loads(made["columns"])).add("bucket", IntegerType())).parquet(folder)
    return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest date."""
    newest = list_snapshots(spark, path).first()
    if newest is None:
        raise ValueError(f"no snapshot under {path}")
    return read_snapshot(spark, path, newest["snapshot_date"])


def changed_buckets(spark: SparkSession, path: str, before: str, after: str) -> list[int]:
    """Buckets whose digests or numbers of rows differ; groups of buckets are compared first."""
    both = manifest(spark, path).where(F.col("snapshot_date").isin(before, after))
    heads = both.where("bucket = -1").select("buckets", "key").distinct().collect()
    if len(heads) != 1:
        raise ValueError(f"snapshots {before} and {after} are not laid out alike: {heads}")
    side = F.when(F.col("snapshot_date") == after, 1).otherwise(-1)
    signed = both.where("bucket >= 0").select(
        F.floor(F.col("bucket") / GROUP).alias("group"), "bucket", (side * F.col("rows")).alias("rows"), (side * F.col("digest")).cast("decimal(38,0)").alias("digest")
    )

    def unequal(rows: DataFrame, level: str) -> DataFrame:
        return rows.groupBy(level).agg(F.sum("rows").alias("r"), F.sum("digest").alias("d")).where("r <> 0 or d <> 0").select(level)

    groups = unequal(signed, "group")
    return sorted(r["bucket"] for r in unequal(signed.join(F.broadcast(groups), "group", "left_semi"), "bucket").collect())


def diff_snapshots(
    spark: SparkSession, path: str, before: str, after: str, key: str, fields: list[str],
    touched: DataFrame | None = None, frozen_if_touched: list[str] | None = None, derived: list[str] | None = None,
) -> DataFrame:
    """``reconcile.snapshot_diff`` of two dates over the buckets that differ, and no others."""
    buckets = changed_buckets(spark, path, before, after)
    a, b = (read_snapshot(spark, path, date, buckets) for date in (before, after))
    return snapshot_diff(a, b, key, fields, touched, frozen_if_touched, derived)
