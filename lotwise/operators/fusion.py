"""The fused decision on a listing: wholes that their parts corroborate, evidence of labels, ordered branches, damage and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.shared import as_table
from . import evidence as E

# Labels of detections by what they tell, the combinations of parts that make a cooler sure, states, reasons, points.
COOLERS = ("intel_stock_cooler", "amd_wraith_cooler", "tower_cpu_cooler", "aio_pump_block")
COOLER_PARTS = ("cpu_fan_hub", "cpu_fan_blades", "heatsink_fin_stack", "cooler_heatpipes")
COOLER_COMBINATIONS = (("cpu_fan_hub", "cpu_fan_blades"), ("heatsink_fin_stack", "cooler_heatpipes"), ("cpu_fan_blades", "heatsink_fin_stack"))
INSTALLED = ("cpu_installed",)
EMPTY = ("empty_lga_socket", "empty_amd_socket", "exposed_lga_contact_field", "lga_center_rectangle", "open_lga_retention_frame")
EMPTY_CUES = ("empty_lga_socket", "exposed_lga_contact_field", "lga_center_rectangle", "open_lga_retention_frame")
COVER = ("socket_cover",)
DAMAGE = ("bent_socket_pins", "burn_damage", "cracked_pcb")
CUE_LABEL = "empty_lga_visual_cues"
COOLER_STATE, CPU_STATE, EMPTY_STATE, COVER_STATE, UNCLEAR = "cooler_attached_cpu_highly_likely", "visible_cpu_likely", "empty_socket_likely", "socket_cover_likely", "unclear"
REASONS = {
    "rejected": "uncorroborated_cooler_detections_rejected", "empty": "cooler_evidence_rejected_by_empty_socket", "cover": "cooler_evidence_rejected_by_socket_cover",
    "conflict": "conflicting_socket_evidence", "unclear": "socket_state_unclear", "damage": "possible_physical_damage",
}
POINTS = {"ram_dimm": 35, "nvme_ssd": 25, "damage": -100}

ROLES = {"cooler": COOLERS, "installed": INSTALLED, "empty": EMPTY, "cover": COVER}


def _cells(b: Column, size: float) -> Column:
    """The grid cells that a box touches."""
    along = lambda low, high: F.sequence(F.floor(low / size), F.floor(F.greatest(low, high) / size))
    return F.flatten(F.transform(along(b["x1"], b["x2"]), lambda x: F.transform(along(b["y1"], b["y2"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def corroborated(d: DataFrame, wholes: tuple[str, ...] = COOLERS, parts: tuple[str, ...] = COOLER_PARTS, combinations: tuple[tuple[str, ...], ...] = COOLER_COMBINATIONS, least: float = 0.35, cell: float = 256.0) -> DataFrame:
    """d (item_id, image_index, pos, label, score, x1, y1, x2, y2) with `accepted` for wholes: whether the parts that overlap it, in the same image and by the least share of
    the smaller box, have all labels of one of the combinations. For other detections it is null.

    Wholes and parts meet by item, image and grid cell, so that an image of many detections is many groups; what comes out of it is a set of labels for each whole.
    A box without all its corners, or without area, overlaps nothing. pos tells detections of an item apart. Repeated rows of one pos have one answer.
    """
    where = lambda labels: d.where(F.col("label").isin(*labels)).withColumn("_b", E.box()).withColumn("_c", F.explode(_cells(F.col("_b"), cell)))
    a = where(wholes).select("item_id", "pos", F.col("image_index").alias("_i"), "_b", "_c")
    b = where(parts).select(F.col("item_id").alias("_item"), F.col("image_index").alias("_j"), F.col("_b").alias("_p"), F.col("_c").alias("_d"), F.col("label").alias("_part"))
    met = a.join(b, (F.col("item_id") == F.col("_item")) & F.col("_i").eqNullSafe(F.col("_j")) & (F.col("_c") == F.col("_d")) & (G.overlap_smaller(F.col("_b"), F.col("_p")) >= least))
    sets = met.groupBy("item_id", "pos").agg(F.collect_set("_part").alias("_parts"))
    complete = [F.size(F.array_except(F.array(*map(F.lit, c)), F.col("_parts"))) == 0 for c in combinations]
    sure = sets.where(complete[0] if len(complete) == 1 else F.array_contains(F.array(*complete), True)).select(F.col("item_id").alias("_item"), F.col("pos").alias("_pos"), F.lit(True).alias("_sure"))
    # only wholes meet what was found; nothing else is dealt out
    whole = F.coalesce(F.col("label").isin(*wholes), F.lit(False))
    asked = d.where(whole).join(sure, (F.col("item_id") == F.col("_item")) & (F.col("pos") == F.col("_pos")), "left")
    return asked.withColumn("accepted", F.coalesce("_sure", F.lit(False))).drop("_item", "_pos", "_sure").union(d.where(~whole).withColumn("accepted", F.lit(None).cast("boolean")))


def four(c: Column) -> Column:
    """c to four places."""
    return F.round(c * 10_000) / 10_000


def label_evidence(d: DataFrame, f: E.Fusion = E.Fusion()) -> DataFrame:
    """Evidence of each label, rounded to four places, which is what decisions go by."""
    return E.evidence(d, f).withColumns({c: four(F.col(c)) for c in ("score", "max_score")})


def wide_evidence(checked: DataFrame, f: E.Fusion = E.Fusion()) -> DataFrame:
    """One row for each item of d with `accepted` (see corroborated); rejected wholes, and detections without a label or score, are no evidence.

    Of each role the score of its best label and how many images that one is in (of equal scores, the more images), 0 if it has none. Cues of an empty socket are fused, and
    take the empty role's place where they score more. `maxima` has each label's score, `damage_labels` (sorted) and `damage_score` what damage is sure enough in enough images.
    """
    # the best of each label in each image, settled once for all that is asked of it
    checked = as_table(checked.groupBy("item_id", "image_index", "label", "accepted").agg(F.max("score").alias("score"), F.count("*").alias("n")), "best")
    kept = checked.where(F.coalesce("accepted", F.lit(True)) & F.col("label").isNotNull() & F.col("score").isNotNull())
    ev = label_evidence(kept, f)
    is_ = lambda labels: F.col("label").isin(*labels)
    best = {role: F.max(F.when(is_(labels), F.struct("score", "distinct_images"))) for role, labels in ROLES.items()}
    hurt = is_(DAMAGE) & (F.col("score") >= f.strong) & (F.col("distinct_images") >= f.damage_images)
    cue = F.when(is_(EMPTY_CUES), F.col("score"))
    found = ev.groupBy("item_id").agg(
        *(x.alias(f"_{role}") for role, x in best.items()),
        F.max(cue).alias("_top"), F.sum(cue).alias("_total"), F.count(cue).alias("_cues"),
        F.coalesce(F.max(F.when(F.col("label") == "ram_dimm", F.col("score"))), F.lit(0.0)).alias("ram_score"),
        F.coalesce(F.max(F.when(F.col("label") == "nvme_ssd", F.col("score"))), F.lit(0.0)).alias("nvme_score"),
        F.array_sort(F.collect_list(F.when(hurt, F.col("label")))).alias("damage_labels"), F.coalesce(F.max(F.when(hurt, F.col("score"))), F.lit(0.0)).alias("damage_score"),
        F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("maxima"),
    )
    images = kept.where(is_(EMPTY_CUES)).select("item_id", "image_index").distinct().groupBy("item_id").agg(F.count("*").alias("_images"))
    counted = lambda test: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0)))
    items = checked.groupBy("item_id").agg(counted(F.col("accepted")).alias("accepted"), counted(~F.col("accepted")).alias("rejected"), F.coalesce(F.max(F.when(~F.col("accepted"), F.col("score"))), F.lit(0.0)).alias("rejected_score"))
    out = items.join(found, "item_id", "left").join(images, "item_id", "left")
    out = out.withColumns({f"{role}_{name}": F.coalesce(F.col(f"_{role}.{c}"), F.lit(zero)) for role in ROLES for name, c, zero in (("score", "score", 0.0), ("images", "distinct_images", 0))})
    more = lambda n: F.least(F.lit(2), n - 1)
    rest = F.when(F.col("_cues") > 1, 0.18 * (F.col("_total") - F.col("_top")) / F.greatest(F.col("_cues") - 1, F.lit(1)) + 0.05 * more(F.col("_cues"))).otherwise(F.lit(0.0))
    # least() passes over nulls: an item without cues has no score of them
    fused = F.when(F.col("_cues") > 0, F.least(F.lit(1.0), F.col("_top") + rest + F.when(F.col("_images") > 1, 0.05 * more(F.col("_images"))).otherwise(F.lit(0.0))))
    out = out.withColumn("_fused", fused).withColumn("cues_lead", F.coalesce(F.col("_fused") > F.col("empty_score"), F.lit(False)))
    none = F.create_map().cast("map<string,double>")
    out = out.withColumns({
        "empty_score": F.when(F.col("cues_lead"), four(F.col("_fused"))).otherwise(F.col("empty_score")),
        "empty_images": F.when(F.col("cues_lead"), F.col("_images")).otherwise(F.col("empty_images")),
        "maxima": F.when(F.col("cues_lead"), F.map_concat("maxima", F.create_map(F.lit(CUE_LABEL), four(F.col("_fused"))))).otherwise(F.coalesce("maxima", none)),
        "damage_labels": F.coalesce(F.array_compact("damage_labels"), F.array().cast("array<string>")),
    } | {c: F.coalesce(c, F.lit(0.0)) for c in ("damage_score", "ram_score", "nvme_score")})
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def decided(wide: DataFrame, f: E.Fusion = E.Fusion()) -> DataFrame:
    """wide_evidence's rows with cpu_state, cpu_confidence, review_reasons, needs_review, damaged and value_score, in ten ordered branches."""
    c, i, e, v = (F.col(f"{k}_score") for k in ROLES)
    conflict = (i >= f.moderate) & (e >= f.moderate) & (F.abs(i - e) < f.margin)
    branches = [
        ((e >= f.override) & (e >= i + f.override_margin), EMPTY_STATE, e),
        ((v >= f.override) & (v >= i + f.override_margin), COVER_STATE, v),
        (conflict, UNCLEAR, F.greatest(i, e)),
        ((c >= f.cooler_single) & (F.col("cooler_images") >= 1), COOLER_STATE, c),
        ((i >= f.strong) & (i >= e + f.margin), CPU_STATE, i),
        ((e >= f.strong) & (e >= i + f.margin), EMPTY_STATE, e),
        ((c >= f.cooler_multi) & (F.col("cooler_images") >= 2), COOLER_STATE, c),
        ((i >= f.moderate) & (F.col("installed_images") >= 2) & (i >= e + f.margin), CPU_STATE, i),
        ((e >= f.moderate) & (F.col("empty_images") >= 2) & (e >= i + f.margin), EMPTY_STATE, e),
    ]
    number = F.coalesce(*(F.when(test, k) for k, (test, _, _) in enumerate(branches)), F.lit(len(branches)))
    pick = lambda place, default: F.coalesce(*(F.when(F.col("_branch") == k, x[place] if isinstance(x[place], Column) else F.lit(x[place])) for k, x in enumerate(branches)), default)
    out = wide.withColumn("_branch", number).withColumns({"cpu_state": pick(1, F.lit(UNCLEAR)), "cpu_confidence": four(pick(2, F.greatest(c, i, e, v))), "damaged": F.size("damage_labels") > 0})
    b = F.col("_branch")
    said = {
        "rejected": (F.col("rejected") > 0) & (F.col("accepted") == 0), "empty": (b == 0) & (c >= f.moderate), "cover": (b == 1) & (c >= f.moderate),
        "conflict": b == 2, "unclear": b == len(branches), "damage": F.col("damaged"),
    }
    out = out.withColumn("review_reasons", F.array_compact(F.array(*(F.when(test, REASONS[k]) for k, test in said.items()))))
    extra = lambda test, k: F.when(test, POINTS[k]).otherwise(0)
    score = E.points(F.col("cpu_state")) + extra(F.col("ram_score") >= f.moderate, "ram_dimm") + extra(F.col("nvme_score") >= f.moderate, "nvme_ssd") + extra(F.col("damaged"), "damage")
    return out.withColumns({"value_score": score, "needs_review": F.size("review_reasons") > 0}).drop("_branch")


def fused_decision(d: DataFrame, f: E.Fusion = E.Fusion()) -> DataFrame:
    """One row for each item of detections d (item_id, image_index, pos, label, score, x1, y1, x2, y2): its state, how sure it is, and why it should be looked at.

    Coolers that no combination of parts corroborates are left out; an item of nothing else is unclear. Null images are one image; rows without an item_id
    are left out; other columns are left aside; an empty table gives an empty one.
    """
    d = d.where("item_id is not null").select("item_id", "image_index", "pos", "label", "score", "x1", "y1", "x2", "y2")
    return decided(wide_evidence(corroborated(d, least=f.overlap), f), f)
