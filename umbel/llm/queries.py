"""Queries of the llm operators on the driver tables, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch_path
from . import attribution, kneser_ney, latent, packing, raking, simhash, site_templates, spelling, suffixes, tokenfiles, topk, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokenfiles.encode_documents(table(spark, sf_dir, "documents"), path)
    return tokenfiles.read_documents(spark, path, digest=True)


@query("op2_token_attribution")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(table(spark, sf_dir, "documents"), attribution.quarters(F.col("text")), rule="most")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op8_threshold_top_k", TOP_K_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query("op10_repeated_strings")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


@query("op6_kneser_ney_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_toxicity_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_site_templates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = site_templates.main_text(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op7_latent_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_raked_mixture")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = raking.by_source_language_topic(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "mix_tokens", "mix_probability", "mix_kept")


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spelling.word_counts(table(spark, sf_dir, "documents"), least=7, slip=31)
    return spelling.group_variants(counted.where("n >= 2"), times=10)


@query("op11_best_fit_shards")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return packed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op13_whitened_components")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"), components=16)
