"""Substring search over a written index of character trigrams.

Postings say which entities have a trigram in a name, a synonym or a code. A needle
is contained only where all its trigrams are, so the entities of its rarest ones are
intersected and the needle is looked for in the few labels that are left. Needles are
answered many at a time: the postings' folders of their trigrams are read, and no
others, and so are the labels' folders of the candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import TASK_ROWS, broadcast_if_small, discard, materialize, parts_for

SIZE = 3
BUCKETS = 64
# Trigrams of a needle that are looked up, the rarest first.
LOOKED_UP = 4


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters; a shorter text has none."""
    last = F.length(text) - size + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, size))
    return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, count: int, path: str, buckets: int, *order: str) -> None:
    """A folder a bucket, in as many files as ``count`` rows ask for: one task sorts no more of them as they grow."""
    pieces = -(-4 * count // (buckets * TASK_ROWS)) or 1
    parts = max(parts_for(rows.sparkSession, count), buckets * pieces)
    dealt = rows.repartition(parts, "bucket", F.pmod(F.xxhash64(*order), F.lit(pieces)))
    dealt.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)


def build_index(entities: DataFrame, path: str, code: str = "code", name: str = "name", synonyms: str = "synonyms", buckets: int = BUCKETS) -> None:
    """Write postings, their frequencies and labels of ``entities`` under ``path``.

    Labels are lower-cased names and synonyms, and the code as it is. Pairs of
    characters have postings too, and single ones of codes, for short needles. Null
    labels have none.
    """
    texts = F.concat(
        F.array(F.struct(F.lit("code").alias("field"), F.col(code).alias("text"))),
        F.transform(F.concat(F.array(name), F.coalesce(synonyms, F.array().cast("array<string>"))), lambda t: F.struct(F.lit("label").alias("field"), F.lower(t).alias("text"))),
    )
    rows = entities.select(F.col(code).alias("code"), F.explode(F.array_distinct(texts)).alias("t")).select("code", "t.field", "t.text").where("text is not null")
    spark, rows = entities.sparkSession, materialize(rows, "labels")
    _write(rows.withColumn("bucket", _bucket("code", buckets)), rows.count(), f"{path}/labels", buckets, "code")
    discard(rows)
    labels = spark.read.parquet(f"{path}/labels")
    # Two runs begin at about every character.
    count = 2 * (labels.agg(F.sum(F.length("text"))).first()[0] or 0)
    single = F.when(F.col("field") == "code", _grams(F.col("text"), 1)).otherwise(F.array().cast("array<string>"))
    held = labels.select("code", "field", "text").repartition(parts_for(spark, count), "code")
    grams = held.select("code", "field", F.explode(F.concat(_grams(F.col("text"), SIZE), _grams(F.col("text"), 2), single)).alias("gram")).distinct()
    _write(grams.withColumn("bucket", _bucket("gram", buckets)), count, f"{path}/postings", buckets, "gram", "code")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("field", "gram").agg(F.count("*").alias("n")).write.parquet(f"{path}/frequencies")


def search(spark: SparkSession, path: str, needles: DataFrame, q: str = "q", buckets: int = BUCKETS) -> DataFrame:
    """``(q, code)`` for each needle and every entity it is found in.

    Needles are trimmed and lower-cased; in codes a leading ``orpha`` and its colon
    are left off. Needles of less than two characters find nothing.
    """
    typed = F.lower(F.trim(F.col(q)))
    bare = F.when(typed.startswith("orpha"), F.regexp_replace(typed, "^orpha:?", "")).otherwise(typed)
    asked = needles.select(F.col(q).alias("q"), typed.alias("typed"), bare.alias("bare")).where(F.length("typed") >= 2).distinct()
    parts = asked.select("q", F.explode(F.array(
        F.struct(F.lit("label").alias("field"), F.col("typed").alias("needle")), F.struct(F.lit("code").alias("field"), F.col("bare").alias("needle"))
    )).alias("p")).select("q", "p.*")
    length = F.length("needle")
    runs = F.when(length >= SIZE, _grams(F.col("needle"), SIZE)).when(length == 2, _grams(F.col("needle"), 2)).otherwise(_grams(F.col("needle"), 1))
    grams = parts.select("q", "field", "needle", F.explode(runs).alias("gram"))
    counted = grams.join(spark.read.parquet(f"{path}/frequencies"), ["field", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("n", "gram"))), 1, LOOKED_UP)
    chosen = counted.groupBy("q", "field", "needle").agg(rarest.alias("g"))
    wanted = materialize(
        chosen.select("q", "field", "needle", F.size("g").alias("k"), F.explode("g").alias("g")).select("q", "field", "needle", "k", "g.gram", "g.n").withColumn("bucket", _bucket("gram", buckets)), "needles"
    )
    parts = parts_for(spark, wanted.agg(F.sum("n")).first()[0] or 0)
    side, _ = broadcast_if_small(wanted.drop("n"))
    postings = spark.read.parquet(f"{path}/postings")
    hits = postings.join(side, ["bucket", "gram", "field"]).repartition(parts, "q", "field", "needle", "code")
    held = hits.groupBy("q", "field", "needle", "k", "code").agg(F.count("*").alias("n"))
    near = materialize(held.where("n = k").select("q", "field", "needle", "code").withColumn("bucket", _bucket("code", buckets)), "candidates")
    few, fits = broadcast_if_small(near)
    labels = spark.read.parquet(f"{path}/labels")
    sides = (labels, few) if fits else (x.repartition(parts, "bucket", "code", "field") for x in (labels, few))
    found = reduce(lambda a, b: a.join(b, ["bucket", "code", "field"]), sides).where(F.col("text").contains(F.col("needle"))).select("q", "code")
    # A prefix alone leaves nothing to look for, and every code has that.
    prefixes = F.explode(F.array(F.lit("orpha"), F.lit("orpha:"))).alias("typed")
    every = labels.where("field = 'code'").select("code", prefixes).join(F.broadcast(asked.where("bare = ''").select("q", "typed")), "typed")
    return found.unionByName(every.select("q", "code")).repartition(parts, "q", "code").distinct()


def first_found(found: DataFrame, limit: int = 12) -> DataFrame:
    """``(q, rank, code)``: the first codes of each needle in numeric order."""
    w = W.partitionBy("q").orderBy(F.expr("try_cast(code as bigint)"), "code")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
