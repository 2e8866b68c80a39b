"""Streaming forms of the incremental steps: exactly-once skips, windowed evidence, and an upsert into a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Each key once within the watermark: what a ledger of recent keys does in batches. State is bounded by the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_maxima(stream: DataFrame, at: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Best score of each label in each window of event time."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), "label").agg(F.max("score").alias("top"), F.count("*").alias("n")).select("window.start", "label", "top", "n")


def latest_rows(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The table that upsert_batches keeps: of each bucket its newest version (older than `before`, if given). Buckets' versions are folders, so others aren't read."""
    rows = spark.read.option("basePath", path).parquet(path)
    rows = rows if before is None else rows.where(F.col("version") < before)
    # one row for each bucket
    newest = rows.select("bucket", "version").distinct().groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi").drop("version", "bucket")


def upsert_batches(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = 64):
    """A query that keeps the latest row of each key. Keys are dealt into buckets by hash; a micro-batch writes a new version of the buckets that it touches, and no others.

    A batch that is run again writes the same versions again, from the same older ones, so replays change nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        try:
            old = latest_rows(spark, path, number)
        except AnalysisException:  # nothing was written yet
            old = None
        rows = batch
        if old is not None:
            # at most one row for each bucket
            touched = F.broadcast(batch.select(bucket.alias("_b")).distinct())
            rows = old.withColumn("_b", bucket).join(touched, "_b", "left_semi").select(*batch.columns).unionByName(batch)
        others = [c for c in batch.columns if c != key]
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order, F.xxhash64(*others))).alias("r")).select(key, "r.*")
        latest.select(*batch.columns).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
