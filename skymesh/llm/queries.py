"""The registered corpus queries; each applies its operator to its whole table."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymesh.llm import archive, decontaminate, langid, mixing, neardup, quality, recompression, suffix, tokens, toxicity, trie, urls, variants
from skymesh.llm.frames import documents
from skymesh.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op3_substring_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(documents(spark, sf_dir))


@query
def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.converted(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("record_id", "target_uri", "date", "refers_to_record")


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir))


@query
def op7_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


@query
def op8_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.languages(docs, langid.learn(docs))


@query
def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


@query
def op10_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = quality.quality(documents(spark, sf_dir))
    return own.withColumns({c: F.round(c, 6) for c in ("js_chars", "js_words")})


@query
def op11_gram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(documents(spark, sf_dir))


@query
def op12_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.binary_ids(documents(spark, sf_dir), importlib.import_module("public_tokenizers").path("byte_bpe_50k.json"))


@query
def op13_euler_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("enter_at", "exit_at")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)
