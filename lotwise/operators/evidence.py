"""Detections to states: filters, per-group fusion, and ordered decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T


@dataclass(frozen=True)
class Fusion:
    """Weights and thresholds of evidence fusion."""

    additional: float = 0.35
    bonus: float = 0.08
    strong: float = 0.58
    moderate: float = 0.46
    margin: float = 0.10
    cooler_single: float = 0.58
    cooler_multi: float = 0.52
    override: float = 0.50
    override_margin: float = 0.05
    damage_images: int = 2
    overlap: float = 0.35


def box() -> Column:
    return F.struct("x1", "y1", "x2", "y2")


def geometry_filter(d: DataFrame, width: float, height: float, least: float = 0.0008, most: float = 0.65, by_label: dict[str, float] | None = None, capped: tuple[tuple[str, ...], float, float, float] | None = None) -> DataFrame:
    """Boxes whose share of the image lies between their label's least share and the most; those of `capped` labels have at most a share of its width, of its height, and of its area."""
    ratio = G.area(box()) / (width * height)
    floor = F.lit(least)
    for label, value in (by_label or {}).items():
        floor = F.when(F.col("label") == label, max(value, least)).otherwise(floor)
    fits = (ratio >= floor) & (ratio <= most)
    if capped:
        labels, wide, high, large = capped
        fits = fits & (~F.col("label").isin(*labels) | ((F.col("x2") - F.col("x1") <= wide * width) & (F.col("y2") - F.col("y1") <= high * height) & (ratio <= large)))
    return d.where(fits)


def class_threshold(d: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Detections whose score reaches their label's threshold; thresholds (label, threshold) is a small table."""
    return d.join(thresholds, "label").where("score >= threshold").drop("threshold")


def maxima(d: DataFrame) -> DataFrame:
    """(item_id, label, top): best score of each label."""
    return d.groupBy("item_id", "label").agg(F.max("score").alias("top"))


def best_detection(d: DataFrame) -> DataFrame:
    """The best detection of each item, image and label, the first of equals."""
    w = Window.partitionBy("item_id", "image_index", "label").orderBy(F.desc("score"), "pos")
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def evidence(d: DataFrame, f: Fusion = Fusion()) -> DataFrame:
    """(item_id, label, score, max_score, distinct_images, detections): best image plus a share of the others and a bonus for each up to two."""
    images = d.groupBy("item_id", "label", "image_index").agg(F.max("score").alias("m"), F.count("*").alias("n"))
    # one deal by item serves this aggregate, those by item after it, and joins by item
    images = images.repartition("item_id")
    per = images.groupBy("item_id", "label").agg(F.max("m").alias("max_score"), F.sum("m").alias("total"), F.count("*").alias("distinct_images"), F.sum("n").alias("detections"))
    rest = F.col("distinct_images") - 1
    more = F.when(rest > 0, f.additional * (F.col("total") - F.col("max_score")) / F.greatest(rest, F.lit(1)) + f.bonus * F.least(F.lit(2), rest)).otherwise(F.lit(0.0))
    return per.select("item_id", "label", F.least(F.lit(1.0), F.col("max_score") + more).alias("score"), "max_score", "distinct_images", "detections")


def cue_fusion(ev: DataFrame, d: DataFrame, cues: tuple[str, ...]) -> DataFrame:
    """(item_id, cue_score, cue_images): several weak cues that support each other, from their evidence."""
    images = d.where(F.col("label").isin(*cues)).groupBy("item_id").agg(F.countDistinct("image_index").alias("cue_images"))
    s = ev.where(F.col("label").isin(*cues)).groupBy("item_id").agg(F.max("score").alias("top"), F.sum("score").alias("total"), F.count("*").alias("n"))
    rest = F.col("n") - 1
    score = F.col("top") + F.when(rest > 0, 0.18 * (F.col("total") - F.col("top")) / F.greatest(rest, F.lit(1)) + 0.05 * F.least(F.lit(2), rest)).otherwise(F.lit(0.0)) + F.when(F.col("cue_images") > 1, 0.05 * F.least(F.lit(2), F.col("cue_images") - 1)).otherwise(F.lit(0.0))
    return s.join(images, "item_id").select("item_id", F.least(F.lit(1.0), score).alias("cue_score"), "cue_images")


def labelled(ev: DataFrame, roles: dict[str, str]) -> DataFrame:
    """One row for each item: score and images of each role's label, 0 where there is none, and `maxima`, the best score of every label it has."""
    out = [F.coalesce(F.max(F.when(F.col("label") == label, F.col(c))), F.lit(zero)).alias(f"{role}_{name}") for role, label in roles.items() for c, name, zero in (("score", "score", 0.0), ("distinct_images", "images", 0))]
    return ev.groupBy("item_id").agg(*out, F.map_from_entries(F.collect_list(F.struct("label", "max_score"))).alias("maxima"))


def points(state: Column) -> Column:
    """What a state adds to an item's score."""
    return F.when(state == "cooler_attached_cpu_highly_likely", 100).when(state == "visible_cpu_likely", 80).when(state == "empty_socket_likely", -100).when(state == "socket_cover_likely", -60).otherwise(0)


def clip_state(cooler: Column, cpu: Column, empty: Column, cover: Column, ram: Column, nvme: Column) -> Column:
    """struct(state, score) of one detector's maxima, in four ordered branches; memory and drives add to the score."""
    state = F.when((cooler >= 0.62) & (cooler > F.greatest(empty, cover) + 0.08), "cooler_attached_cpu_highly_likely").when((cpu >= 0.68) & (cpu > empty + 0.08), "visible_cpu_likely").when((empty >= 0.66) & (empty > cpu + 0.08), "empty_socket_likely").when(cover >= 0.66, "socket_cover_likely").otherwise("unclear")
    score = points(state) + F.when(ram >= 0.60, 35).otherwise(0) + F.when(nvme >= 0.60, 25).otherwise(0)
    return F.struct(state.alias("state"), score.alias("score"))


# What the first classifier says of a gallery, and what text in an image stands for a processor.
VERDICTS = {"installed": "CPU visible/likely installed", "empty": "Empty socket visible", "cover": "Socket cover visible", "cooler": "Cooler present; CPU not directly visible", "": "Unclear"}
CPU_TEXT = r"(?i)\b(INTEL|RYZEN|CORE\s*I[3579]|AMD)\b"


def gallery_verdict(images: DataFrame, sure: float = 0.58, cooler: float = 0.60) -> DataFrame:
    """(item_id, verdict, installed, empty, cover, cooler, cpu_text) of images (item_id, installed, empty, cover, cooler, text): the best score of each kind, and the first verdict that holds.

    A processor's name in any image's text counts like a processor that is seen. Null scores count as 0, null texts say nothing.
    """
    kinds = ("installed", "empty", "cover", "cooler")
    best = images.groupBy("item_id").agg(*(F.coalesce(F.max(k), F.lit(0.0)).alias(k) for k in kinds), F.coalesce(F.bool_or(F.col("text").rlike(CPU_TEXT)), F.lit(False)).alias("cpu_text"))
    verdict = F.when(F.col("cpu_text") | (F.col("installed") >= sure), VERDICTS["installed"]).when(F.col("empty") >= sure, VERDICTS["empty"]).when(F.col("cover") >= sure, VERDICTS["cover"]).when(F.col("cooler") >= cooler, VERDICTS["cooler"]).otherwise(VERDICTS[""])
    return best.select("item_id", verdict.alias("verdict"), *(F.round(k, 3).alias(k) for k in kinds), "cpu_text")


def damage_gate(ev: DataFrame, labels: tuple[str, ...], strong: float = 0.58, images: int = 2) -> DataFrame:
    """(item_id, damage_score, damage_labels): the best score and all labels, sorted, of damage that is sure enough in enough images."""
    sure = ev.where(F.col("label").isin(*labels) & (F.col("score") >= strong) & (F.col("distinct_images") >= images))
    return sure.groupBy("item_id").agg(F.max("score").alias("damage_score"), F.array_sort(F.collect_set("label")).alias("damage_labels"))


def context_adjusted(rows: DataFrame, title: str = "title", weak_empty: float = 0.46, cover_as_empty: float = 0.50, cooler_confidence: float = 0.62, least_cooler: float = 0.0, accept: float = 0.58) -> DataFrame:
    """States, reasons and reviews corrected by what the title says: a cooler in the title, Intel's weak empty sockets, AMD's covers.

    rows has cpu_state, cpu_confidence, value_score, review_reasons, needs_review, exposed_score (an Intel socket's contacts), empty_score (an empty AMD socket) and cover_score.
    """
    state, t, sure = F.col("cpu_state"), F.col(title), F.col("cpu_confidence")
    why = F.coalesce("review_reasons", F.array().cast("array<string>"))
    platform, unclear = T.platform_hint(t), state == "unclear"
    branch = (
        F.when(T.mentions_cooler(t) & unclear & (sure >= least_cooler), 1)
        .when((platform == "intel") & unclear & (F.col("exposed_score") >= weak_empty), 2)
        .when((platform == "amd") & (state == "socket_cover_likely") & (F.col("cover_score") >= cover_as_empty) & (F.col("empty_score") < F.col("cover_score")), 3)
        .otherwise(0)
    )
    b = F.col("_b")
    note = F.when(b == 1, "cooler_supported_by_listing_title").when(b == 2, "intel_empty_socket_supported_by_platform_context").when(b == 3, "amd_socket_cover_reinterpreted_as_empty_socket")
    return rows.withColumn("_b", branch).withColumns({
        "cpu_state": F.when(b == 1, "cooler_attached_cpu_highly_likely").when(b > 1, "empty_socket_likely").otherwise(state),
        "cpu_confidence": F.when(b == 1, F.greatest(sure, F.lit(cooler_confidence))).when(b == 2, F.col("exposed_score")).when(b == 3, F.col("cover_score")).otherwise(sure),
        "value_score": F.col("value_score") + F.when(b == 1, 100).when(b == 2, -100).when(b == 3, -40).otherwise(0),
        "review_reasons": F.when((b == 1) | (b == 2), T.edited(why, ("socket_state_unclear",), note)).otherwise(T.edited(why, (), note)),
        "needs_review": F.when(b == 2, F.col("exposed_score") < accept).when(b > 0, True).otherwise(F.col("needs_review")),
    }).drop("_b")


def label_gaps(d: DataFrame) -> DataFrame:
    """(item_id, n, gap_mean, gap_cv) of the spaces between boxes in order of x1."""
    w = Window.partitionBy("item_id").orderBy("x1", "pos")
    gaps = d.withColumn("gap", F.col("x1") - F.lag("x1").over(w))
    mean = F.avg("gap")
    return gaps.groupBy("item_id").agg(F.count("*").alias("n"), mean.alias("gap_mean"), F.when(mean > 0, F.stddev_pop("gap") / mean).alias("gap_cv"))
