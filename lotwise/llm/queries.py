"""The queries of this subpackage: one thin function for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, langid, media_tiff, minmax_dedup, ngram_join, packing, pii, quality, ranked, shingle_sql, substring_dedup, token_count, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_docs(spark, sf_dir), _labels(spark, sf_dir), threshold=0.3)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_docs(spark, sf_dir), width=5, percent=75).select("doc_id", "n_shingles", "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op_result(pii.find_pii(_docs(spark, sf_dir)))


def op4_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_tiff.text_media(_docs(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_docs(spark, sf_dir), least=50)


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_docs(spark, sf_dir), tokenizer="byte_bpe_50k.json", limit=1024)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_docs(spark, sf_dir), _labels(spark, sf_dir), threshold=0.7)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10, gram=5).drop("text_key")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_docs(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.minmax_dedup(_docs(spark, sf_dir), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_docs(spark, sf_dir), "byte_bpe_50k.json", "piece_bpe_32k.model")


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of every document's TIFF."""
    files = media_tiff.texts_to_tiff(_docs(spark, sf_dir), "doc_id", "text")
    return media_tiff.tiff_pages(files).withColumn("pixels", F.crc32("pixels")).withColumnRenamed("pixels", "pixels_crc32")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID where all four sources of evidence speak: web pages with their declared language, address and host."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return langid.language_id(langid.page_texts(pages)).withColumnRenamed("doc_id", "page_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"tiff_pages": tiff_pages, "page_language": page_language}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": shingle_sql.components(width=5, percent=75),
        "op11_minhash_near_dedup": shingle_sql.components(width=3, percent=85, more=", doc_id = component_id as kept"),
        "op13_ranked_lexical_search": ranked.SEARCH_SQL,
    }
