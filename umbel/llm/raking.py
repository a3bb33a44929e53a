"""Mixing documents to target weights by iterative proportional fitting.

Token weights are summed per cell, a combination of the dimensions' values (source,
language, topic). Raking scales the cells to each dimension's target shares in turn
until all hold at once; every round is a join of the cells with sums by one
dimension. A document's probability is its cell's factor, scaled so that the sample
has a stated share of all tokens at least, more if no factor passes one then. A cell
scarcer than its target stays whole and the rest of its target is raked over the
others, so a rare value does not decide how much is kept. No document is needed
twice. The draw is a hash of the document's id, so it repeats exactly.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize

ROUNDS = 40
TOLERANCE = 1e-4
MISSING = "?"
# Share of all tokens a mixture keeps at least.
KEEP = 0.25
# Cells that are raked as arrays: 40 bytes each beside their names.
CELLS = 50_000
# A fit with a larger gap is reported.
REPORTED = 0.01


def word_count(text: Column) -> Column:
    """Runs of other characters than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from the looks of a text: tabular, loud, marked up, long or plain."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.instr(t, " | ") > 0, "tabular").when(F.instr(t, "!!") > 0, "loud")
        .when(F.instr(t, "###") > 0, "marked").when(F.length(t) > 4000, "long").otherwise("plain")
    )


def even_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """``value, share``: the tokens of each value to a power below one, as shares. Evens a mixture out."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    lifted = sums.select("value", F.pow("tokens", F.lit(power)).alias("w"))
    total = lifted.agg(F.sum("w")).first()[0] or 1.0
    return lifted.select("value", (F.col("w") / total).alias("share"))


def within_supply(shares: DataFrame, cells: DataFrame, dimension: str, kept: float) -> DataFrame:
    """``shares`` of which none asks for more than its value's tokens are of ``kept`` tokens; the others grow alike."""
    supply = cells.groupBy(dimension).agg((F.sum("tokens") / kept).alias("most"))
    rows = materialize(shares.join(supply, dimension), "supply")
    level = 1.0
    while True:
        full = F.col("most") <= level * F.col("s")
        r = rows.agg(F.sum(F.when(full, F.col("most"))).alias("whole"), F.sum(F.when(~full, F.col("s"))).alias("open")).first()
        if not r["open"]:
            break
        raised = (1.0 - (r["whole"] or 0.0)) / r["open"]
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return rows.select(dimension, F.least("most", F.lit(level) * F.col("s")).alias("s"))


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE,
    keep: float | None = None, collected: int = CELLS,
) -> tuple[DataFrame, float]:
    """``(cells with weight, largest gap)``; weights sum to one.

    Up to ``collected`` cells, counted, are raked as arrays on the driver (a few MB);
    more as tables, by the same steps.

    ``cells`` has the dimensions of ``targets`` and ``tokens``; a target is
    ``value, share``. Values without a target get weight zero; targets without
    tokens are left out and the others scaled up. When targets contradict each
    other or the empty cells, the fit stops after ``rounds`` and the gap tells.
    With ``keep`` no cell weighs more than its tokens are of that share of all
    tokens; targets beyond what their value has are cut to it, the others scaled up,
    and the gap is against these.
    """
    dims = list(targets)
    live = cells.where("tokens > 0")
    for d in dims:
        live = live.join(targets[d].where("share > 0").select(F.col("value").alias(d)), d, "left_semi")
    live = materialize(live, "cells")
    total = live.agg(F.sum("tokens")).first()[0] or 1
    shares = {}
    for d in dims:
        present = targets[d].where("share > 0").join(live.select(F.col(d).alias("value")).distinct(), "value", "left_semi")
        rows = materialize(present.select(F.col("value").alias(d), F.col("share").alias("s")), "shares")
        whole = rows.agg(F.sum("s")).first()[0] or 1.0
        rows = rows.withColumn("s", F.col("s") / whole)
        shares[d] = rows if keep is None else within_supply(rows, live, d, keep * total)
    if live.count() <= collected:
        return _rake_rows(live, shares, rounds, tolerance, None if keep is None else keep * total)
    current = live.withColumn("weight", F.col("tokens").cast("double"))
    current, gap, last = current.withColumn("weight", F.col("weight") / total), float("inf"), None
    for _ in range(rounds):
        for d in dims:
            sums = current.groupBy(d).agg(F.sum("weight").alias("now")).join(shares[d], d).select(
                d, (F.col("s") / F.col("now")).alias("f")
            )
            scaled = F.col("weight") * F.col("f")
            if keep is not None:
                scaled = F.least(scaled, F.col("tokens") / (keep * total))
            current = current.join(sums, d).withColumn("weight", scaled).drop("f")
        # A round is a table: the next one starts from rows, not from a longer plan.
        current = materialize(current, "raked")
        if last is not None:
            discard(last)
        last = current
        gaps = [
            current.groupBy(d).agg(F.sum("weight").alias("now")).join(shares[d], d).select(
                F.abs(F.col("now") / F.col("s") - 1).alias("gap")
            )
            for d in dims
        ]
        gap = reduce(DataFrame.unionAll, gaps).agg(F.max("gap")).first()[0]
        if gap is None or gap < tolerance:
            break
    return current, gap or 0.0


def _rake_rows(live: DataFrame, shares: dict[str, DataFrame], rounds: int, tolerance: float, kept: float | None) -> tuple[DataFrame, float]:
    """The rounds of ``rake`` over collected cells; ``kept`` is the number of tokens to keep."""
    cells = live.toArrow()
    tokens = cells.column("tokens").to_numpy().astype(np.float64)
    weight, gap, marginals = tokens / (tokens.sum() or 1.0), 0.0, []
    for d, table in shares.items():
        wanted = {r[d]: r["s"] for r in table.collect()}
        values = {v: i for i, v in enumerate(wanted)}
        marginals.append((np.array([values[v] for v in cells.column(d).to_pylist()], np.int64), np.array(list(wanted.values()), np.float64)))
    for _ in range(rounds if len(tokens) else 0):
        for of, share in marginals:
            now = np.bincount(of, weight, minlength=len(share))
            weight = weight * np.divide(share, now, out=np.zeros_like(share), where=now > 0)[of]
            if kept is not None:
                weight = np.minimum(weight, tokens / kept)
        gap = max(float(np.abs(np.bincount(of, weight, minlength=len(share)) / share - 1).max()) for of, share in marginals)
        if gap < tolerance:
            break
    made = cells.append_column("weight", pa.array(weight))
    return live.sparkSession.createDataFrame(made), gap


def mix(
    docs: DataFrame, dimensions: dict[str, Column], targets: dict[str, DataFrame] | None = None, power: float = 0.7,
    tokens: Column | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP,
) -> DataFrame:
    """``docs`` with ``mix_tokens, mix_probability, mix_kept`` for every row.

    ``dimensions`` names the marginals; without ``targets`` each is evened out by
    ``power``. The kept tokens are ``keep`` of all tokens with a target, in
    expectation, or more where that needs no document twice; a fit that ends with a
    gap is warned of. A null value is a value of its own (``?``). A document without
    tokens has no weight to mix and stays, with probability one. Rows of one id are
    drawn alike; a null id is drawn by its text.
    """
    count = tokens if tokens is not None else word_count(F.col(text_col))
    named = docs.withColumn("mix_tokens", F.coalesce(count.cast("long"), F.lit(0)))
    for d, value in dimensions.items():
        named = named.withColumn(f"mix_{d}", F.coalesce(value.cast("string"), F.lit(MISSING)))
    keys = [f"mix_{d}" for d in dimensions]
    cells = materialize(named.groupBy(*keys).agg(F.sum("mix_tokens").alias("tokens")), "mix_cells")
    wanted = {k: (targets[d] if targets else even_targets(cells, k, power)) for d, k in zip(dimensions, keys)}
    raked, gap = rake(cells, wanted, keep=keep)
    if gap > REPORTED:
        warnings.warn(f"raked mixture: shares miss their targets by up to {gap:.3g} of a target", stacklevel=2)
    factor = raked.select(*keys, (F.col("weight") / F.col("tokens")).alias("factor"))
    top = factor.agg(F.max("factor")).first()[0] or 1.0
    scale = max(1.0 / top, keep * (raked.agg(F.sum("tokens")).first()[0] or 0))
    # A cell kept whole is so despite rounding.
    p = F.col("factor") * scale
    chances = materialize(factor.select(*keys, F.when(p >= 1.0 - 1e-12, 1.0).otherwise(p).alias("chance")), "chances")
    drawn = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col), F.lit(seed))).otherwise(F.xxhash64(F.col(text_col), F.lit(seed)))
    place = F.pmod(drawn, F.lit(1 << 53)) / float(1 << 53)
    chance = F.when(F.col("mix_tokens") == 0, 1.0).otherwise(F.coalesce("chance", F.lit(0.0)))
    return named.join(chances, keys, "left").withColumn("mix_probability", chance).withColumn(
        "mix_kept", place < F.col("mix_probability")
    ).drop("chance", *keys)


def by_source_language_topic(docs: DataFrame, power: float = 0.7) -> DataFrame:
    """``mix`` over the source, language and topic of ``documents``."""
    return mix(docs, {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"))}, power=power)
