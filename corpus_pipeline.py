"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Toxic documents go, one document of each near-duplicate group stays (five-word shingles, similarity 0.8),
strings of 100 bytes that occur earlier go, contaminated documents go, and what is left is mixed to target
weights.  No SQL gives the rows of ``run``: toxicity and the mix come from a fitted model and a schedule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymesh.llm import decontaminate, mixing, neardup, suffix, toxicity
from skymesh.llm.frames import documents, written

ORACLE_SQL = None


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for those with one of ``ids`` (doc_id)."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.acceptable(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = neardup.near_duplicates(docs, size=5, similar=80)
    return without(docs, groups.filter("not kept"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    other = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = suffix.remove_repeats(docs, text=True, carry=tuple(other))
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return out.select(*(new.get(f.name, F.col(f"carried.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema))


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [("toxicity", not_toxic), ("near_duplicates", one_of_each), ("suffix_array_dedup", without_repeats), ("decontamination", not_contaminated), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
