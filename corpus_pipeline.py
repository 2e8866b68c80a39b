"""The corpus pipeline: documents through five operators, each stage a Parquet table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm import common, decontaminate, langid, ngram_join, packing, pii


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of at least a half."""
    return langid.keep_languages(docs, least=0.5)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join, that of least doc_id; documents without links, words or doc_id all stay.

    Rows are told apart by doc_id and text, so a doc_id with two texts that link with nothing keeps both; of rows alike in both one stays.
    """
    found = ngram_join.ngram_jaccard_join(docs, width=5, percent=75)
    rows = found.select("doc_id", F.col("text_key").alias("_key"), "component_id", "component_class", "n_shingles")
    least = Window.partitionBy("component_class", "doc_id").orderBy("_key")
    # texts of the least doc_id that are linked with each other: one of them stays
    same = rows.where("component_id = doc_id and n_shingles > 0").distinct().withColumn("_rank", F.row_number().over(least)).where("_rank > 1")
    gone = rows.where("component_id <> doc_id").select("doc_id", "_key").union(same.select("doc_id", "_key")).distinct()
    one = docs.where("doc_id is not null").withColumn("_key", F.xxhash64("text"))
    if not one.groupBy("doc_id", "_key").count().where("count > 1").isEmpty():
        rest = F.struct(*(c for c in one.columns if c not in ("text", "_key")))
        # of rows alike in both, the same one in each run: that whose other columns come first as JSON
        one = one.groupBy("doc_id", "_key").agg(F.min_by(F.struct(*docs.columns), F.to_json(rest)).alias("_row")).select("_row.*", "_key")
    return one.join(gone, ["doc_id", "_key"], "left_anti").select(*docs.columns).union(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10, gram=5)
    bad = found.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_key"]), "left_anti")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or each piece of one that is too long, goes in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", decontamination),
    ("pii", private_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the language model and the network; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.as_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
