"""Live-check events to a refresh queue.

The feed is a directory of JSON lines. State lives in the queue table, not in
the stream: every micro-batch is reduced to the last event per code and merged
by event time, so replaying a batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import scratch_path

# Kinds that queue a code, and the windows in days.
QUEUE_KINDS = ["refresh-queue", "live-check"]
WINDOW_DAYS = 14
STALE_DAYS = 30

EVENT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("ranAt", T.StringType()),
        T.StructField("at", T.StringType()),
        T.StructField("orphaCode", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("publishedTotal", T.StringType()),
        T.StructField("liveTotal", T.StringType()),
        T.StructField("publishedAsOf", T.StringType()),
    ]
)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Streaming read of the feed; malformed lines are dropped."""
    return spark.readStream.schema(EVENT).option("mode", "DROPMALFORMED").json(path)


def live_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)`` live checks: kind, numeric code, numeric totals."""
    number = r"^-?\d+(\.\d+)?$"
    ok = F.coalesce(
        (F.col("kind") == "live-check")
        & F.col("orphaCode").rlike(r"^\d+$")
        & F.col("publishedTotal").rlike(number)
        & F.col("liveTotal").rlike(number),
        F.lit(False),
    )
    valid = events.where(ok).select(
        F.col("orphaCode").alias("code"),
        F.col("publishedTotal").cast("double").cast("long").alias("published_total"),
        F.col("liveTotal").cast("double").cast("long").alias("live_total"),
        F.try_to_timestamp(F.coalesce("ranAt", "at")).alias("at"),
    )
    return valid, events.where(~ok)


def reason(live: Column, published: Column, checked: Column, now: Column) -> Column:
    """Why a code joins the queue; null when it need not."""
    stale = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(checked) > STALE_DAYS * 86400, F.lit(False))
    return (
        F.when(published.isNull(), F.lit(None).cast("string"))
        .when(~live.eqNullSafe(published), "live-delta")
        .when(checked.isNull(), "missing-last-check")
        .when(stale, "stale-check")
    )


def queue_reasons(events: DataFrame, published: DataFrame) -> DataFrame:
    """Stream-static join with the published table: ``code, published, last_check``."""
    rows = events.join(published.select("code", "published", "last_check"), "code")
    why = reason(F.col("live_total"), F.col("published"), F.col("last_check"), F.col("at"))
    return rows.withColumn("reason", why).where(F.col("reason").isNotNull())


def refresh_queue(events: DataFrame, as_of: Column, kinds: list[str] | None = None, days: int = WINDOW_DAYS) -> DataFrame:
    """Distinct codes, last event wins, in order of that event (batch form).

    Events older than the window are dropped; undated ones stay. ``events`` has
    ``kind, code, at, seq``; ``seq`` is arrival order.
    """
    recent = F.col("at").isNull() | (F.col("at") >= as_of - F.make_interval(days=F.lit(days)))
    return (
        events.where(F.col("kind").isin(kinds or QUEUE_KINDS) & F.col("code").rlike(r"^\d+$") & recent)
        .groupBy("code")
        .agg(F.max("seq").alias("seq"), F.max_by("at", "seq").alias("at"), F.max_by("reason", "seq").alias("reason"))
        .orderBy("seq")
    )


def last_per_code(batch: DataFrame) -> DataFrame:
    """Last dated event per code; equal times are settled by reason."""
    best = F.max(F.struct("at", "reason", "live_total", "published_total"))
    return batch.where(F.col("at").isNotNull()).groupBy("code").agg(best.alias("b")).select("code", "b.*")


def _versions(spark: SparkSession, table: str) -> list[tuple[int, str, str]]:
    """``(number, batch, folder)`` of the complete versions of a queue, oldest first.

    A version is a folder ``v=<number>.<query>.<batch>``.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        folder = status.getPath().toString()
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")):
            number, batch = folder.rsplit("=", 1)[1].split(".", 1)
            found.append((int(number), batch, folder))
    return sorted(found)


def _drop_versions(spark: SparkSession, folders: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_queue(spark: SparkSession, table: str) -> DataFrame:
    versions = _versions(spark, table)
    if not versions:
        raise ValueError(f"no queue at {table}")
    return spark.read.parquet(versions[-1][2])


def merge_into_queue(table: str, days: int = WINDOW_DAYS, as_of: Column | None = None, keep: int = 2):
    """``foreachBatch`` function: merge the micro-batch into the queue table.

    A batch writes the next version, named after its query and batch id; a replay
    finds the newest version named so and leaves it. Another query, whose ids begin
    anew, merges into the same table. The merge compares event times, so neither
    order of arrival nor a second reading matters. Codes whose last event left the
    window are dropped; the window ends at the newest event that is not after
    ``as_of`` (now, by default), so an event dated in the future moves nothing.
    Versions before the last ``keep`` are removed.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        name, versions = f"{query}.{batch_id}", _versions(spark, table)
        if versions and versions[-1][1] == name:
            return
        merged = last_per_code(batch)
        if versions:
            current = spark.read.parquet(versions[-1][2])
            merged = last_per_code(merged.unionByName(current.select(*merged.columns)))
        limit = as_of if as_of is not None else F.current_timestamp()
        newest = merged.where(F.col("at") <= limit).agg(F.max("at").alias("m"))
        since = newest.select(F.col("m") - F.make_interval(days=F.lit(days))).scalar()
        number = versions[-1][0] + 1 if versions else 0
        kept = merged.where(since.isNull() | (F.col("at") >= since))
        kept.write.mode("overwrite").parquet(f"{table}/v={number}.{name}")
        _drop_versions(spark, [folder for *_, folder in versions[: max(len(versions) + 1 - keep, 0)]])

    return run


def run_refresh(
    spark: SparkSession, feed: str, published: DataFrame, table: str, rejects: str, checkpoint: str | None = None
):
    """Start both queries over the feed; each stops once the feed is read.

    With ``checkpoint`` a second run reads only what is new; without one it reads
    the whole feed again and merges it once more, to the same queue.
    """
    valid, bad = live_events(read_feed(spark, feed))
    place = checkpoint or scratch_path(spark, "refresh")
    queue = (
        queue_reasons(valid, published).writeStream.foreachBatch(merge_into_queue(table))
        .option("checkpointLocation", f"{place}/queue").trigger(availableNow=True).start()
    )
    rejected = (
        bad.writeStream.format("json").option("path", rejects)
        .option("checkpointLocation", f"{place}/rejects").trigger(availableNow=True).start()
    )
    return queue, rejected
