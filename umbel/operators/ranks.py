"""Global ranks, quantiles and row numbers without a window over all rows.

Rows are range-partitioned by their order and written with the number of their
range. Range totals are a short table (one row per range and group), so their
running sum is small; a window keyed by group and range does the rest. The number
of ranges is the number of shuffle partitions, so it grows with the job, and no
task ever holds a whole group, however hot it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize


def _in_ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Rows with the number of their range, ``part``, in the given order.

    Written once: range bounds come from a sample, and the totals and the window
    below must see the same ranges.
    """
    return materialize(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")


def _offsets(ranged: DataFrame, amount: str, groups: list[str]) -> DataFrame:
    """Running total before each range and the total, per group."""
    totals = ranged.groupBy(*groups, "part").agg(F.sum(amount).alias("part_total"))
    w = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    earlier = w.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *groups,
        "part",
        F.coalesce(F.sum("part_total").over(earlier), F.lit(0)).alias("offset"),
        F.sum("part_total").over(w).alias("total"),
    )


def running_before(
    df: DataFrame, order: Sequence[Column | str], amount: str, groups: Sequence[str] = ()
) -> DataFrame:
    """Adds ``before`` (sum of ``amount`` over earlier rows) and ``total``.

    Per group when ``groups`` are given. The order must be total: equal rows
    would fall on either side of a range.
    """
    groups = list(groups)
    ranged = _in_ranges(df, order)
    w = W.partitionBy(*groups, "part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(amount).over(w), F.lit(0))
    joined = ranged.withColumn("inner_before", inner).join(_offsets(ranged, amount, groups), [*groups, "part"])
    return joined.withColumn("before", F.col("offset") + F.col("inner_before")).drop(
        "part", "offset", "inner_before"
    )


def row_index(df: DataFrame, order: Sequence[Column | str], groups: Sequence[str] = ()) -> DataFrame:
    """Adds the zero-based ``row_index`` in the given total order and ``total``."""
    one = df.withColumn("one", F.lit(1).cast("long"))
    return running_before(one, order, "one", groups).withColumnRenamed("before", "row_index").drop("one")


def value_ranks(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value: ``ties``, ``before`` (rows below), ``total``.

    Counting per value first means only distinct values are ranked, and the rows
    themselves are read a single time.
    """
    groups = list(groups)
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("ties"))
    )
    return running_before(counted, [value, *groups], "ties", groups)


def percentile_rank(
    df: DataFrame, value: str, gate: Column, out: str, ranks: DataFrame | None = None
) -> DataFrame:
    """Share of gated rows below, plus half the ties, 0-100 to one decimal.

    Null outside the gate. Values are joined back by equality, so a value held
    by very many rows costs one row on the ranked side.
    """
    gated = gate & F.col(value).isNotNull()
    if ranks is None:
        ranks = value_ranks(df.where(gated).select(value), value)
    share = (F.col("before") + F.col("ties") * 0.5) / F.col("total")
    table = ranks.select(
        F.col(value).alias("_v"), (F.floor(share * 1000 + 0.5) / 10.0).alias("_p")
    )
    keyed = df.withColumn("_k", F.when(gated, F.col(value)))
    return (
        keyed.join(table, keyed["_k"] == table["_v"], "left")
        .withColumn(out, F.col("_p"))
        .drop("_k", "_v", "_p")
    )


def _at(index: Column, value: str) -> Column:
    """Value at a zero-based position of the sorted rows."""
    return F.min(F.when(F.col("before") + F.col("ties") > index, F.col(value)))


def distribution(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Quartiles by linear interpolation, share of zeros and n.

    Exact: reads the values at the two positions around each quartile from the
    ranked table, so no task collects the column. An empty ungrouped input gives
    one row of zeros.
    """
    groups = list(groups)
    ranked = value_ranks(df.select(*groups, value), value, groups)
    spots = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    parts = []
    for name, q in spots.items():
        pos = (F.col("total") - 1) * q
        parts += [
            _at(F.floor(pos), value).alias(f"{name}_lo"),
            _at(F.ceil(pos), value).alias(f"{name}_hi"),
        ]
    parts += [
        F.max("total").alias("n"),
        F.sum(F.when(F.col(value) == 0, F.col("ties")).otherwise(0)).alias("zeros"),
    ]
    wide = ranked.groupBy(*groups).agg(*parts) if groups else ranked.agg(*parts)
    cols = []
    for name, q in spots.items():
        pos = (F.col("n") - 1) * q
        w = pos - F.floor(pos)
        mixed = F.col(f"{name}_lo") * (1 - w) + F.col(f"{name}_hi") * w
        cols.append(F.coalesce(mixed, F.lit(0.0)).cast("double").alias(name))
    return wide.select(
        *groups,
        *cols,
        F.coalesce(F.col("zeros") / F.col("n"), F.lit(0.0)).alias("share_zero"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
    )
