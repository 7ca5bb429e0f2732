"""Documents to shards: language, near duplicates, benchmark items, source weights, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textinsight.llm import language_id
from textinsight.llm.common import materialize
from textinsight.llm.decontamination import contaminated
from textinsight.llm.mixing import mix_sources
from textinsight.llm.sharding import hilbert_shards
from textinsight.llm.simhash import near_duplicates
from textinsight.session import small_side

LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones; ``und`` and doubtful ones go.

    A missing ``lang`` is filled with the prediction.
    """
    found = language_id.predict_language(docs, language_id.fit(docs))
    kept = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: of the smallest id, null last.

    A document is its id and its text, so texts that share an id are told apart, and of rows that agree in both
    one stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    groups = materialize(near_duplicates(docs.withColumn("_key", key), "_key").select("_key", "component_id"))
    first = F.col("_key").eqNullSafe(F.col("component_id"))
    named = [F.col("_key.id").alias("_gone"), F.col("_key.text_hash").alias("_hash")]
    gone = materialize(groups.filter(~first).select(*named).distinct())
    same = docs["doc_id"].eqNullSafe(F.col("_gone")) & (F.xxhash64(docs["text"]) == F.col("_hash"))
    kept = docs.join(small_side(gone), same, "left_anti")
    twice = materialize(groups.filter(first).groupBy(*named).count().filter("count > 1").drop("count"))
    if twice.isEmpty():
        return kept
    again = kept.join(small_side(twice), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small_side(twice), same, "left_anti").unionByName(again)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    held = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = materialize(held.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct())
    same = docs["doc_id"].eqNullSafe(F.col("_gone")) & (F.xxhash64(docs["text"]) == F.col("_hash"))
    return docs.join(small_side(gone), same, "left_anti")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them; sources that are even enough stay as they are."""
    return mix_sources(docs, max_exponent=1.0).select(docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mixture."""
    return hilbert_shards(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("sharding", sharded),
]
# The language stage is a trained model, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
