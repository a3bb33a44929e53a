"""Session settings and the few places where a plan is cut or a side is sized."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

# A side is broadcast only when its measured bytes stay under this bound.
BROADCAST_BYTES = 64 * 1024 * 1024

# Rows that a task sorts or groups, where the rows of a step are counted beforehand.
TASK_ROWS = 1_000_000

_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(app: str = "umbel", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a missing setting is an error, since a machine-local folder would be
    lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """In a session of one machine, the rows of a scan dealt to all cores.

    A small file often has one row group, and then one task has all its rows however
    many splits the file is cut into. On a cluster tables have many row groups and the
    scan stays as it is.
    """
    context = scan.sparkSession.sparkContext
    return scan.repartition(context.defaultParallelism) if re.match(r"local(\[|$)", context.master) else scan


def materialize(df: DataFrame, label: str = "stage", by: str | None = None) -> DataFrame:
    """Cut lineage: write a table to the shared folder and read it back.

    Survives the loss of any executor, and gives the optimiser real sizes for
    what follows. ``by`` names a column whose values get folders of their own.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def bucketed(df: DataFrame, key: str, label: str = "artifact", buckets: int | None = None) -> DataFrame:
    """``df`` as a table laid out by ``key``: joins and groupings by it move the other side only.

    As many buckets as shuffle partitions unless given; the files are in the shared
    folder, the name is in the session's catalogue.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    parts = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for that many rows: the session's number, or more, so that a task's share does not grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def discard(table: DataFrame) -> None:
    """Remove a table ``materialize`` made, once nothing will read it any more."""
    path = getattr(table, "_scratch_path", None)
    if path is not None:
        place, files = _file(table.sparkSession, path)
        files.delete(place, True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Jobs run inside remove their shuffle files as they end.

    Else the files stay until the driver happens to collect its garbage, which a long
    chain of small jobs may not bring about for minutes. What a job wrote or returned
    is whole by then; a frame that is run twice makes its shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _file(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    place, files = _file(spark, path)
    return files.exists(place)


def claim_file(spark: SparkSession, path: str) -> bool:
    """Create an empty file; of several callers, on any driver, one gets true."""
    place, files = _file(spark, path)
    try:
        return files.createNewFile(place)
    except Py4JJavaError as failed:
        if "FileAlreadyExists" in str(failed):
            return False
        raise


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: text as it is, 16 for each field, nested fields as JSON text."""
    size = F.lit(16 * len(df.columns))
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return size


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows, by one aggregate."""
    return int(df.agg(F.sum(row_bytes(df)).alias("b")).first()["b"] or 0)


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """``(side, fits)``: a broadcast hint only when the measured size fits.

    The caller joins either way; past the limit the join shuffles and adaptive
    skew handling splits hot keys.
    """
    if measured_bytes(df) <= (BROADCAST_BYTES if limit is None else limit):
        return F.broadcast(df), True
    return df, False


def broadcast_slices(df: DataFrame, key: str, limit: int | None = None) -> list[DataFrame]:
    """The rows of a table in slices that each fit a broadcast; one slice if all fits.

    For joins against a side that must not move: it is scanned once a slice. Slices
    are cut by the hash of ``key`` (distinct values, or nearly) and their sizes are
    measured again, so each hint is backed by its own figure.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    total = measured_bytes(df)
    if total <= limit:
        return [F.broadcast(df)]
    held, parts = materialize(df, "slices"), 1 + total // limit
    while True:
        cut = held.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(parts)))
        largest = cut.groupBy("slice").agg(F.sum(row_bytes(held)).alias("b"), F.count("*").alias("n")).agg(
            F.max(F.when(F.col("n") > 1, F.col("b")))
        ).first()[0]
        if largest is None or largest <= limit:
            break
        parts *= 2
    kept = materialize(cut, "slices", by="slice")
    discard(held)
    return [F.broadcast(kept.where(F.col("slice") == i).drop("slice")) for i in range(parts)]


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row frames as one wide row: a union and a max, no join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
