"""JSON document sets as tables: whole files of a list, or of an object that wraps one, with a version check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_list(spark: SparkSession, path: str, ddl: str, wrapped: str | None = None, version: int | None = None) -> DataFrame:
    """Rows of JSON files that hold a list of objects, or an object with the list under `wrapped`; a wrong schema_version is an error.

    Each file is read whole, as JSON documents are; a missing list gives no rows, and so does a file that isn't JSON: `unread` tells which. Only the list's fields in ddl are kept.
    """
    return parsed(spark.read.text(path, wholetext=True), ddl, wrapped, version)


def parsed(texts: DataFrame, ddl: str, wrapped: str | None = None, version: int | None = None) -> DataFrame:
    """As read_list, for documents in the column `value`."""
    bare = F.from_json("value", f"array<struct<{ddl}>>")
    if wrapped is None:
        return texts.select(F.explode(bare).alias("r")).select("r.*")
    whole = F.from_json("value", f"schema_version int, `{wrapped}` array<struct<{ddl}>>")
    is_list = F.ltrim("value").startswith("[")
    rows = F.when(is_list, bare).otherwise(whole[wrapped])
    if version is not None:
        rows = F.when(~is_list & (F.coalesce(whole["schema_version"], F.lit(-1)) != version), F.raise_error(F.lit("unsupported schema version"))).otherwise(rows)
    return texts.select(F.explode(rows).alias("r")).select("r.*")


def unread(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the files below a path that aren't JSON, which read_list gives no rows of."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.trim(F.decode("content", "UTF-8"))
    sound = F.when(text.startswith("["), F.from_json(text, "array<string>").isNotNull()).otherwise(F.from_json(text, "map<string,string>").isNotNull())
    return files.where(~F.coalesce(sound, F.lit(False))).select("path", F.lit("invalid_json").alias("error"))


def item_images(spark: SparkSession, path: str, suffix: str = ".jpg") -> DataFrame:
    """(item_id, images): the files `<item_id>_*` below a path, by name as text, so that _10 comes before _2."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*_*{suffix}").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    return files.groupBy(F.regexp_extract("name", "^(.*?)_", 1).alias("item_id")).agg(F.array_sort(F.collect_list("name")).alias("images"))


def write_features(features: DataFrame, path: str) -> None:
    """Key points (reference, point, x, y, descriptor) as one table, sorted by reference, so that a reference's are read alone."""
    features.repartitionByRange("reference").sortWithinPartitions("reference", "point").write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str, references: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if references is None else rows.where(F.col("reference").isin(*references))


def write_list(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of all files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def migrated_ledger(rows: DataFrame) -> DataFrame:
    """Ledger rows of the first version in the form of the second: a hash of 'legacy', no result hash."""
    have = rows.columns
    return rows.withColumns({"listing_hash": F.coalesce("listing_hash", F.lit("legacy")) if "listing_hash" in have else F.lit("legacy"), "result_hash": F.col("result_hash") if "result_hash" in have else F.lit(None).cast("string")})
