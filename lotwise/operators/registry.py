"""Registers of models, annotations and references as keyed tables: upserts, guards, promotion and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .tables import reasons, replaced

METRICS = ("map50", "precision", "recall")


def _must(test: Column, value: Column, message: Column) -> Column:
    return F.when(test, value).otherwise(F.raise_error(message))


# --- models ---


def absolute_faults(least: dict[str, float]) -> Column:
    """Which of a model's metrics (columns) are under their minimum, comma-joined."""
    return reasons(**{k: F.coalesce(F.col(k), F.lit(0.0)) < v for k, v in least.items()})


def relative_faults(rows: DataFrame, least_gain: float = 0.02, least_precision: float = 0.0, least_recall: float = 0.0, tradeoff: float = 0.05) -> DataFrame:
    """rows of candidates (METRICS, active_ and METRICS, promotable) with the deltas to six places, faults and promote.

    A gain of `tradeoff` in map50 excuses losses of precision and recall. Without an active model its metrics are null and count as 0.
    """
    out = rows.withColumns({f"delta_{k}": F.round(F.coalesce(k, F.lit(0.0)) - F.coalesce(f"active_{k}", F.lit(0.0)), 6) for k in METRICS})
    gain = F.col("delta_map50")
    faults = reasons(
        candidate_failed_absolute_thresholds=~F.coalesce("promotable", F.lit(False)),
        insufficient_map50_gain=gain < least_gain,
        precision_regression=(gain < tradeoff) & (F.col("delta_precision") < least_precision),
        recall_regression=(gain < tradeoff) & (F.col("delta_recall") < least_recall),
    )
    return out.withColumn("faults", faults).withColumn("promote", F.col("faults") == "")


def promotion_step(promote: Column, automatic: Column) -> Column:
    """What follows from a comparison: promoted, approval_required if promotion isn't automatic, or rejected."""
    return F.when(promote & automatic, "promoted").when(promote, "approval_required").otherwise("rejected")


def registered(models: DataFrame, new: DataFrame) -> DataFrame:
    """Models (name, ...) with new ones in place of those of their name."""
    return replaced(models, new, "name")


def find_by_name(rows: DataFrame, name: str, key: str = "name") -> DataFrame:
    """The one row of a name; the job fails if there is none."""
    found = rows.where(F.col(key) == name)
    one = found.agg(F.count("*").alias("_n")).select(_must(F.col("_n") > 0, F.col("_n"), F.lit(f"no {key} {name}")).alias("_n"))
    return found.join(F.broadcast(one), F.col("_n") > 0).drop("_n")


def promoted(models: DataFrame, name: str) -> DataFrame:
    """models (name, promotable, active) with one made the active one; the job fails if it isn't registered or didn't pass its thresholds."""
    total = Window.partitionBy()
    there = F.max((F.col("name") == name).cast("int")).over(total)
    passed = F.max(((F.col("name") == name) & F.coalesce("promotable", F.lit(False))).cast("int")).over(total)
    active = F.when(there == 0, F.raise_error(F.lit("Model not registered"))).when(passed == 0, F.raise_error(F.lit("Model did not pass promotion thresholds"))).otherwise(F.col("name") == name)
    return models.withColumn("active", active.cast("boolean"))


def rolled_back(deployment: DataFrame, reason: str) -> DataFrame:
    """Deployment settings (mode, rollback_reason, ...) set back to the fallback."""
    return deployment.withColumns({"mode": F.lit("fallback"), "rollback_reason": F.lit(reason)})


def integrity(models: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """models (name, weights, sha256) with `fault`: what is wrong with a model's file (path, sha256 as found), null if nothing is."""
    path = F.when(F.col("weights").startswith("/") | F.lit(root == ""), F.col("weights")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("weights")))
    found = files.select(F.col("path").alias("_path"), F.col("sha256").alias("_found"))
    out = models.withColumn("_path", path).join(found, "_path", "left")
    fault = F.when(F.col("_found").isNull(), "weights_missing").when(F.coalesce("sha256", F.lit("")) == "", "sha256_missing").when(F.col("sha256") != F.col("_found"), "sha256_mismatch")
    return out.withColumn("fault", fault).drop("_path", "_found")


# --- settings ---


def setting_faults(required: DataFrame, files: DataFrame) -> DataFrame:
    """(path, fault) of required files (path) among those that there are (path, value: their text): missing, not JSON, or without a version."""
    out = required.select("path").join(files.select("path", "value"), "path", "left")
    fields = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    fault = F.when(F.col("value").isNull(), "missing").when(F.col("path").endswith(".json") & fields.isNull(), "invalid_json").when(F.col("path").endswith(".json") & ~F.map_contains_key(fields, "schema_version"), "missing_schema_version")
    return out.select("path", fault.alias("fault")).where("fault is not null")


def setting_values_faults(shards: Column, most_shards: Column, retention: Column, ratios: list[Column]) -> Column:
    """What is wrong with settings' values, comma-joined in a fixed order."""
    total = sum(ratios[1:], ratios[0])
    return reasons(default_shards_exceeds_maximum=shards > most_shards, invalid_retention_days=retention < 1, dataset_ratios_must_sum_to_one=F.abs(total - 1.0) > 1e-6)


# --- annotations ---


def image_key(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 20)


def with_images(images: DataFrame, new: DataFrame, source: str = "listing") -> DataFrame:
    """images (image_id, path, item_id, source, annotations, status) and those of new (path, item_id) that aren't there yet, without annotations."""
    kind = images.schema["annotations"].dataType.simpleString()
    fresh = new.select(image_key(F.col("path")).alias("image_id"), "path", "item_id", F.lit(source).alias("source"), F.array().cast(kind).alias("annotations"), F.lit("unlabeled").alias("status"))
    return images.unionByName(fresh.dropDuplicates(["image_id"]).join(images, "image_id", "left_anti"))


def with_boxes(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """images with boxes (image_id, pos, label, x1, y1, x2, y2, confidence) added to their annotations in order of pos; the job fails on a box without area."""
    area = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    own = F.struct("label", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("confidence"))
    sound = boxes.select("image_id", F.struct("pos", _must(area, own, F.lit("box must have positive area")).alias("a")).alias("p"))
    lists = sound.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["a"]).alias("_more"))
    out = images.join(lists, "image_id", "left")
    return out.withColumns({"annotations": F.when(F.col("_more").isNull(), F.col("annotations")).otherwise(F.concat("annotations", "_more")), "status": F.when(F.col("_more").isNull(), F.col("status")).otherwise("labeled")}).drop("_more")


def annotation_faults(images: DataFrame, classes: tuple[str, ...], files: DataFrame) -> DataFrame:
    """(image_id, fault): images (image_id, path, annotations) without a file (path), and annotations of an unknown class or without area."""
    there = images.join(files.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    missing = there.where("_there is null").select("image_id", F.concat(F.lit("missing_image:"), "path").alias("fault"))
    each = images.select("image_id", F.explode("annotations").alias("a"))
    unknown = each.where(~F.col("a.label").isin(*classes)).select("image_id", F.concat(F.lit("unknown_class:"), "a.label").alias("fault"))
    invalid = each.where("a.x2 <= a.x1 or a.y2 <= a.y1").select("image_id", F.concat(F.lit("invalid_box:"), "image_id").alias("fault"))
    return missing.union(unknown).union(invalid)


# --- references ---


def with_references(references: DataFrame, new: DataFrame, policy: DataFrame) -> DataFrame:
    """references (id, model, model_key, source_type, source, trust, approved, revision) with new ones (model, source_type, source, approved, revision) in place of those of their id.

    policy is (source_type, trust, manual): where approval by a person is asked for, the job fails on a reference that hasn't got it; an unknown source type fails too.
    """
    key = X.model_key(F.col("model"))
    own = new.join(F.broadcast(policy), "source_type", "left")
    sure = F.when(F.col("trust").isNull(), F.raise_error(F.concat(F.lit("unknown source type "), "source_type"))).when(F.col("manual") & ~F.col("approved"), F.raise_error(F.concat("source_type", F.lit(" references require approval")))).otherwise(F.lit(True))
    rows = own.select(X.short_id(key, F.col("source_type"), F.col("source")).alias("id"), "model", key.alias("model_key"), "source_type", "source", "trust", sure.cast("boolean").alias("approved"), "revision")
    return replaced(references, rows.dropDuplicates(["id"]), "id")


def with_regions(boards: DataFrame, regions: DataFrame) -> DataFrame:
    """boards (model_key, regions: map of names to polygons) with regions (model_key, name, polygon) written over those of their name; boards without any are as before."""
    news = regions.groupBy("model_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "polygon")))).alias("_new"))
    out = boards.join(news, "model_key", "left")
    kept = F.map_filter("regions", lambda k, _: ~F.map_contains_key(F.col("_new"), k))
    return out.withColumn("regions", F.when(F.col("_new").isNull(), F.col("regions")).otherwise(F.map_concat(kept, "_new"))).drop("_new")


# --- galleries ---


def embedded(listings: DataFrame, galleries: DataFrame) -> DataFrame:
    """listings (id, ...) with `gallery`, a struct of their gallery's row (id, title, urls, description), null where there is none."""
    own = galleries.select("id", F.struct("title", "urls", "description").alias("gallery"))
    return listings.join(own, "id", "left")


def extracted(listings: DataFrame) -> DataFrame:
    """The reverse: (id, title, urls, description) of each listing's gallery, empty where there is none."""
    g = lambda c, none: F.coalesce(F.col(f"gallery.{c}"), none).alias(c)
    return listings.select("id", g("title", F.lit("")), g("urls", F.array().cast("array<string>")), g("description", F.lit("")))


def rotations(scores: DataFrame) -> DataFrame:
    """(item_id, rotation, score, rank): orientations of each item by score; of equals the smaller turn first."""
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "rotation")
    return scores.select("item_id", "rotation", "score", F.row_number().over(w).alias("rank"))
