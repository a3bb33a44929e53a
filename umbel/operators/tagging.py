"""Dictionary phrases tagged in text: longest first, no overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .match import anchored_slices, over_slices

_SPANS = "array<struct<start:int,size:int,term:string>>"


def _take(state: Column, hit: Column) -> Column:
    """One step over the hits of a text: a hit is taken where it is still free.

    A hit that overlaps the one before it of the same term is passed over, taken
    or not.
    """
    end = hit["start"] + hit["size"]
    again = (state["term"] == hit["term"]) & (hit["start"] < state["until"])
    busy = F.exists(state["spans"], lambda s: (s["start"] < end) & (hit["start"] < s["start"] + s["size"]))
    own = F.array(F.struct(hit["start"].alias("start"), hit["size"].alias("size"), hit["term"].alias("term")))
    return F.struct(
        hit["term"].alias("term"),
        F.when(again, state["until"]).otherwise(end).alias("until"),
        F.when(again | busy, state["spans"]).otherwise(F.concat(state["spans"], own)).alias("spans"),
    )


def dictionary_tags(docs: DataFrame, dictionary: DataFrame, doc: str, text: str, term: str = "term") -> DataFrame:
    """``(doc, start, size, term)`` by token position.

    Terms meet a text through their anchor token, which also gives the place; the
    text is compared there, in the scan, and does not move. Hits of a text that
    overlap, one after the other, form a run; only inside a run can one hit keep
    another out, so a run at a time is folded in order of length, term and place.
    """
    terms = dictionary.select(T.normalize_term(term).alias("term")).where("term != ''").distinct()
    texts = docs.select(F.col(doc).alias("doc"), T.normalize_term(text).alias("text"))
    tokens = F.split("text", " ")
    placed = texts.select("doc", tokens.alias("tokens")).select("doc", "tokens", F.posexplode("tokens").alias("at", "anchor"))
    parts = F.split("term", " ")
    start = F.col("at") - F.col("shift")

    def hits(side: DataFrame) -> DataFrame:
        side = F.broadcast(
            side.select("term", "anchor", parts.alias("parts"), (F.array_position(parts, F.col("anchor")) - 1).cast("int").alias("shift"))
        )
        found = placed.join(side, "anchor").where(start >= 0).where(F.slice("tokens", start + 1, F.size("parts")) == F.col("parts"))
        return found.select("doc", start.alias("start"), F.size("parts").alias("size"), "term")

    found = over_slices(anchored_slices(texts, terms), hits)
    # A text's hits, bounded by the text; the runs need the same partitioning.
    before = W.partitionBy("doc").orderBy("start", "size", "term").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy("doc").orderBy("start", "size", "term").rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.col("start") + F.col("size")).over(before)
    runs = found.withColumn("fresh", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(0))).withColumn("run", F.sum("fresh").over(so_far))
    hit = F.struct((-F.length("term")).alias("n"), "term", "start", "size")
    listed = runs.groupBy("doc", "run").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    empty = F.struct(F.lit("").alias("term"), F.lit(0).alias("until"), F.array().cast(_SPANS).alias("spans"))
    folded = F.aggregate("hits", empty, _take, lambda state: state["spans"])
    return listed.select("doc", F.explode(folded).alias("s")).select("doc", "s.start", "s.size", "s.term")
