"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import bpe, brown, checks, crf, divergence, hnsw, langid, licences, packing, quality, sharding, simhash, trees, trie

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {"op12_source_divergence": checks.SOURCE_DIVERGENCE, "op13_prefix_trie": checks.PREFIX_TRIE}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_robust_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"))


@query
def op2_hypergeometric_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shuffle_into_shards(table(spark, sf, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_covering_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_retrieval_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@query
def op7_segmented_language(spark: SparkSession, sf: str) -> DataFrame:
    found = langid.identify(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", F.col("language")["held_out"].alias("held_out"), F.col("language")["found"]["lang_pred"].alias("lang_pred"), F.col("language")["found"]["score"].alias("score"))


@query
def op8_speculative_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"))


@query
def op9_sharded_hnsw(spark: SparkSession, sf: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op3_brown_classes(spark: SparkSession, sf: str) -> DataFrame:
    return brown.score(table(spark, sf, "documents"))


@query
def op4_licence_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: a source's folder has one per language, and in it folders of 1000 neighbouring ids."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 1000), F.concat(F.col("doc_id"), F.lit(".txt")))
    return licences.scan(table(spark, sf, "documents"), path, keep=("doc_id",))


@query
def op5_crf_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return crf.main_text(table(spark, sf, "pages"))


@query
def op11_boosted_quality(spark: SparkSession, sf: str) -> DataFrame:
    return trees.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op12_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


@query
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.nodes(table(spark, sf, "conversations"))
