"""Decisions about boards: identification, price intervals, references, layouts, segment pairs and slot banks.

Everything but `ransac_homographies` is expressions, joins, windows and grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .oriented import Clash, suppressed
from .references import euclid, four_point, verification


def _first_true(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds, null if none does."""
    return F.coalesce(*(F.when(test, value) for test, value in cases))


def single_pass_state(wide: DataFrame, least: float = 0.45, margin: float = 0.08, part: float = 0.38) -> DataFrame:
    """cpu_state, cpu_confidence, review_reasons, value_score from maxima of cooler, installed, empty, cover, damage, ram and nvme over all images at once."""
    c, i, e, v, d = (F.col(k) for k in ("cooler", "installed", "empty", "cover", "damage"))
    state = _first_true([
        (c >= least, F.lit("cooler_attached_cpu_highly_likely")),
        ((i >= least) & (i >= e + margin), F.lit("visible_cpu_likely")),
        ((e >= least) & (e >= i + margin), F.lit("empty_socket_likely")),
        (v >= least, F.lit("socket_cover_likely")),
    ])
    out = wide.withColumn("cpu_state", F.coalesce(state, F.lit("unclear")))
    s = F.col("cpu_state")
    sure = F.when(s == "cooler_attached_cpu_highly_likely", c).when(s == "visible_cpu_likely", i).when(s == "empty_socket_likely", e).when(s == "socket_cover_likely", v).otherwise(F.greatest(c, i, e, v))
    border = F.abs(i - e) + F.greatest(i, e)
    reasons = F.array_compact(F.array(
        F.when(s == "unclear", "socket_state_unclear"),
        F.when((border >= 0.35) & (border < 0.60), "borderline_socket_evidence"),
        F.when(d >= part, "possible_physical_damage"),
    ))
    points = F.when(s == "cooler_attached_cpu_highly_likely", 100).when(s == "visible_cpu_likely", 80).when(s == "empty_socket_likely", -100).when(s == "socket_cover_likely", -60).otherwise(0)
    extra = F.when(F.col("ram") >= part, 35).otherwise(0) + F.when(F.col("nvme") >= part, 25).otherwise(0) - F.when(d >= part, 100).otherwise(0)
    return out.withColumns({"cpu_confidence": sure, "review_reasons": reasons, "value_score": points + extra})


def resolved_identification(rows: DataFrame) -> DataFrame:
    """text, confidence, source, stated_text and confirmation from what a listing says and what its images show; all null if neither names a model.

    rows has listing_raw, listing_key, listing_score, visual_raw, visual_key, visual_score, agreement and conflict: what was read, the catalog's nearest
    model and how near it is, how well both agree, and whether they exclude each other. Other columns stay.
    """
    usable = lambda kind: F.when(F.col(f"{kind}_raw").isNull() | (F.col(f"{kind}_score") >= 0.60), F.col(f"{kind}_key"))
    out = rows.withColumns({"_l": usable("listing"), "_v": usable("visual")})
    raw, listed, seen, ls, vs = (F.col(k) for k in ("listing_raw", "_l", "_v", "listing_score", "visual_score"))
    stated, shown = listed.isNotNull() & (ls >= 0.82), seen.isNotNull() & (vs >= 0.82)
    agree = ~F.col("conflict") & (F.col("agreement") >= 0.82)

    def answer(text: Column, confidence: Column, source: str, said: Column, confirmation: str) -> Column:
        return F.struct(text.alias("text"), confidence.alias("confidence"), F.lit(source).alias("source"), said.alias("stated_text"), F.lit(confirmation).alias("confirmation"))

    least = lambda most, value: F.least(F.lit(most), value)
    both = stated & seen.isNotNull() & (vs >= 0.75)
    unlisted = raw.isNotNull() & listed.isNull()
    nothing = F.lit(None).cast("string")
    found = _first_true([
        (both & agree, answer(listed, least(0.995, 0.88 + 0.08 * ls + 0.04 * vs), "listing_confirmed", raw, "visual_agreement")),
        (both, answer(listed, least(0.90, ls), "listing_conflict", raw, "visual_conflict")),
        (stated, answer(listed, least(0.94, 0.82 + 0.12 * ls), "listing_probable", raw, "not_visually_confirmed")),
        (unlisted & shown, answer(seen, least(0.94, vs), "visually_identified", raw, "listing_uncatalogued_or_incomplete")),
        (unlisted, answer(raw, F.lit(0.72), "listing_uncatalogued", raw, "catalog_missing")),
        (shown, answer(seen, least(0.94, vs), "visually_identified", nothing, "listing_missing_model")),
    ])
    return out.withColumn("_a", found).select(*rows.columns, "_a.*")


def market_interval(rows: DataFrame, overhead: float = 60.0) -> DataFrame:
    """value, profit and max_bid, each at low, median and high, from the prices of board and CPU (structs low, median, high; null: 0).

    The CPU counts only if the reasons say that there is one. Bids leave room for shipping and a fixed overhead.
    """
    has = F.coalesce(F.arrays_overlap("reasons", F.array(F.lit("cpu_visible"), F.lit("cooler_attached"))), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = rows
    for k in ("low", "median", "high"):
        value = zero(F.col("board")[k]) + F.when(has, zero(F.col("cpu")[k])).otherwise(F.lit(0.0))
        out = out.withColumn(f"value_{k}", value).withColumns({
            f"profit_{k}": F.col(f"value_{k}") - zero(F.col("acquisition_cost")),
            f"max_bid_{k}": F.greatest(F.lit(0.0), F.col(f"value_{k}") - zero(F.col("shipping")) - overhead),
        })
    return out


def best_references(images: DataFrame, references: DataFrame, match, most: int = 12) -> DataFrame:
    """(item_id, reference, score, good, inlier_ratio, status, evaluated): of each item the approved reference of its model that one of its images (item_id, model, v) matches best.

    references (reference, model, v, approved) come in the order of `reference`; of a model the first `most` are looked at, and of those only approved ones
    count. So a model brings one row of bounded size to the join, and an image meets its references within its row. match(v, w) is a struct (score, good,
    inlier_ratio). Ties: the smallest reference. evaluated is how many matches were tried.
    """
    place = F.row_number().over(Window.partitionBy("model").orderBy("reference"))
    few = references.withColumn("_n", place).where(F.col("_n") <= most)
    by_model = few.groupBy("model").agg(F.collect_list(F.when(F.col("approved"), F.struct("reference", F.col("v").alias("w")))).alias("refs"))
    matched = images.join(by_model, "model", "left")

    def tried(r: Column) -> Column:
        m = match(F.col("v"), r["w"])
        return F.struct(m["score"].alias("score"), (-r["reference"]).alias("back"), m["good"].alias("good"), m["inlier_ratio"].alias("inlier_ratio"))

    near = F.transform(F.coalesce("refs", F.array()), tried)
    own = matched.select("item_id", F.col("refs").isNotNull().alias("known"), F.array_max(near).alias("best"), F.size(near).alias("n"))
    best = own.groupBy("item_id").agg(F.max("best").alias("best"), F.bool_or("known").alias("known"), F.sum("n").alias("evaluated"))
    score = F.coalesce(F.col("best.score"), F.lit(0.0))
    status = verification(F.col("known"), score, F.col("best.good"), F.col("best.inlier_ratio"))
    return best.select("item_id", (-F.col("best.back")).alias("reference"), score.alias("score"), "best.good", "best.inlier_ratio", status.alias("status"), "evaluated")


def candidate_manifest(queue: DataFrame, approved: DataFrame, source_type: str = "verified_listing") -> DataFrame:
    """(model, source_type, source, source_item_id): each image of the queue's items that are approved by id."""
    chosen = queue.join(approved.select("item_id").distinct(), "item_id", "left_semi")
    return chosen.select("model", F.lit(source_type).alias("source_type"), F.explode("listing_images").alias("source"), F.col("item_id").alias("source_item_id"))


def distinct_boxes(d: DataFrame, threshold: float = 0.45, most: int = 20) -> DataFrame:
    """Greedy suppression whatever the label, within each item and image; the best `most` boxes stay. That bound is the feature."""
    clash = Clash(("x1", "y1", "x2", "y2"), overlap=threshold, at_least=True)
    return suppressed(d, ["item_id", "image_index"], [F.desc("score"), F.col("pos")], clash, most)


def cpu_region(x1: Column, y1: Column, x2: Column, y2: Column, dimm_x: Column, pcie_y: Column, ports: float = 0.065) -> Column:
    """Where on a board to look for its CPU, as a box: left of the memory slots and above the expansion slots, where those are known."""
    w, h = x2 - x1, y2 - y1
    left, top = x1 + w * max(ports, 0.12), y1 + h * 0.05
    right = F.least(F.coalesce(dimm_x, x1 + w * 0.76) - w * 0.035, x1 + w * 0.72)
    bottom = F.least(F.coalesce(pcie_y, y1 + h * 0.58) - h * 0.035, y1 + h * 0.58)
    right = F.when(right <= left, x1 + w * 0.68).otherwise(right)
    bottom = F.when(bottom <= top, y1 + h * 0.52).otherwise(bottom)
    return F.struct(left.alias("x1"), top.alias("y1"), right.alias("x2"), bottom.alias("y2"))


def layout_errors(x16: Column, x1: Column, dimms: Column, rear: Column, socket: Column, n_x16: Column, n_x1: Column, n_dimm: Column) -> Column:
    """What is wrong with a layout, in a fixed order.

    x16, x1 and dimms are arrays of structs (label, polygon), rear and socket polygons, all in shares of the board; null or empty where there are none. The
    counts are what is expected; null or 0: not stated.
    """
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    none = lambda a: a.isNull() | (F.size(a) == 0)
    off = lambda a, n: (F.coalesce(n, F.lit(0)) != 0) & (size(a) != n)
    expected = lambda a, n, what: F.when(off(a, n), F.format_string(f"expected %d {what} slots, found %d", n, size(a)))
    slots = F.array_compact(F.flatten(F.array_compact(F.array(x16, x1))))
    centers = F.transform(slots, lambda s: G.centroid(s["polygon"]))
    mean = lambda k: F.aggregate(centers, F.lit(0.0), lambda s, c: s + c[k]) / F.size(centers)
    some = F.size(slots) > 0
    labels = F.transform(dimms, lambda s: F.coalesce(s["label"], F.lit("")))
    order = F.transform(F.sequence(F.lit(1), F.least(F.size(dimms), F.lit(4))), lambda k: F.concat(F.lit("DIMM"), k.cast("string")))
    return F.array_compact(F.array(
        F.when(none(x16), "at least one PCIe x16 slot is required"),
        expected(x1, n_x1, "PCIe x1"),
        expected(x16, n_x16, "PCIe x16"),
        expected(dimms, n_dimm, "DIMM"),
        F.when(none(rear), "rear I/O rectangle is required"),
        F.when(none(socket), "CPU socket polygon is required"),
        F.when(~none(rear) & some, F.when(G.centroid(rear)["x"] <= mean("x"), "rear I/O must be to the right of the PCIe bank in canonical orientation")),
        F.when(some, F.when((mean("x") > 0.55) | (mean("y") > 0.62), "PCIe bank must occupy the upper-left canonical board region")),
        F.when(~none(dimms), F.when(labels != order, "DIMM slots must be ordered from CPU outward as DIMM1..DIMM4")),
    ))


def segment_pairs(lines: DataFrame, angle: float = 4.5, longer: float = 1.35, overlap: float = 0.72, apart: tuple[float, float] = (4.0, 34.0), aspect: float = 4.0) -> DataFrame:
    """(item_id, a, b, angle, length, width, score): pairs of segments (item_id, id, x1, y1, x2, y2) of one image that may be the long edges of a slot.

    The join compares the segments of one image, a bounded number. Darkness of what lies between, which needs pixels, isn't part of the score.
    """
    swap = (F.col("x2") < F.col("x1")) | ((F.col("x2") == F.col("x1")) & (F.col("y2") < F.col("y1")))
    ends = {f"{c}{k}": F.when(swap, F.col(f"{c}{3 - k}")).otherwise(F.col(f"{c}{k}")) for c in "xy" for k in (1, 2)}
    lines = lines.select("item_id", "id", *(v.alias(k) for k, v in ends.items()))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    lines = lines.withColumn("len", F.sqrt(dx * dx + dy * dy)).where("len > 0").withColumns({"ux": dx / F.col("len"), "uy": dy / F.col("len"), "deg": F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))})
    a, b = lines.alias("a"), lines.alias("b")
    c = lambda n: F.col(n)
    turn = F.pmod(F.abs(c("a.deg") - c("b.deg")), F.lit(180.0))
    along = lambda s, k: c(f"{s}.x{k}") * c("a.ux") + c(f"{s}.y{k}") * c("a.uy")
    shared = F.least(along("a", 2), F.greatest(along("b", 1), along("b", 2))) - F.greatest(along("a", 1), F.least(along("b", 1), along("b", 2)))
    short, long = F.least(c("a.len"), c("b.len")), F.greatest(c("a.len"), c("b.len"))
    part = F.greatest(F.lit(0.0), shared) / short
    middle = lambda k: (c(f"b.{k}1") + c(f"b.{k}2") - c(f"a.{k}1") - c(f"a.{k}2")) / 2
    width = F.abs(middle("y") * c("a.ux") - middle("x") * c("a.uy"))
    pairs = a.join(b, (c("a.item_id") == c("b.item_id")) & (c("a.id") < c("b.id")) & (F.least(turn, 180 - turn) <= angle) & (long / F.greatest(F.lit(1.0), short) <= longer))
    pairs = pairs.select(c("a.item_id").alias("item_id"), c("a.id").alias("a"), c("b.id").alias("b"), ((c("a.deg") + c("b.deg")) / 2).alias("angle"), part.alias("part"), (short * part).alias("length"), width.alias("width"), ((long - short) / long).alias("uneven"))
    pairs = pairs.where((F.col("part") >= overlap) & F.col("width").between(*apart)).withColumn("aspect", F.col("length") / F.col("width")).where(F.col("aspect") >= aspect)
    score = 0.35 * F.least(F.lit(1.0), F.col("aspect") / 12) + 0.25 * F.col("part") + 0.15 * (1 - F.col("uneven"))
    return pairs.select("item_id", "a", "b", "angle", "length", "width", score.alias("score"))


def slot_banks(members: DataFrame, width: float, height: float) -> DataFrame:
    """(bank, n, dimm_score, pcie_score, label): whether a group of parallel slots (bank, pos, length, width, cx, cy, angle, x1, y1, x2, y2) is a bank of memory or
    expansion slots, by number, regularity and place on the image."""
    own = Window.partitionBy("bank")
    turn = F.radians(F.avg("angle").over(own))
    spread = F.col("cy") * F.cos(turn) - F.col("cx") * F.sin(turn)
    m = members.withColumn("_o", spread).withColumn("_gap", F.col("_o") - F.lag("_o").over(own.orderBy("_o", "pos"))).withColumn("_m", F.percentile("length", 0.5).over(own))
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    uneven = lambda k, by: F.stddev_pop(k) / F.greatest(F.lit(1e-6), by)
    s = m.groupBy("bank").agg(
        F.count("*").alias("n"),
        uneven("length", F.avg("length")).alias("length_cv"),
        uneven("width", F.avg("width")).alias("width_cv"),
        F.coalesce(uneven("_gap", F.percentile("_gap", 0.5)), F.lit(1.0)).alias("gap_cv"),
        ((F.min("x1") + F.max("x2")) / (2 * width)).alias("x"),
        ((F.min("y1") + F.max("y2")) / (2 * height)).alias("y"),
        (share(F.col("length") >= F.col("_m") * 0.82) + share(F.col("length") <= F.col("_m") * 0.62)).alias("mixed"),
    )
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    even = lambda k, most: F.greatest(F.lit(0.0), 1 - F.col(k) / most)
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    dimm = 0.28 * F.greatest(F.lit(0.0), 1 - F.abs(n - 4) / 3) + 0.24 * even("length_cv", 0.35) + 0.16 * even("width_cv", 0.45) + 0.20 * even("gap_cv", 0.55) + 0.12 * unit((x - 0.42) / 0.38)
    pcie = 0.22 * unit((n - 2) / 4) + 0.18 * even("gap_cv", 0.80) + 0.22 * unit((0.58 - x) / 0.45) + 0.12 * unit((0.72 - y) / 0.55) + 0.14 * F.least(F.lit(1.0), F.col("mixed")) + 0.12 * even("width_cv", 0.65)
    label = F.when((F.col("dimm_score") >= 0.58) & (F.col("dimm_score") > F.col("pcie_score") + 0.08), "dimm_bank").when(F.col("pcie_score") >= 0.50, "pcie_bank").otherwise("unknown")
    return s.select("bank", "n", dimm.alias("dimm_score"), pcie.alias("pcie_score")).withColumn("label", label)


def ransac_homographies(pairs: DataFrame, reach: float = 5.0, rounds: int = 200, seed: int = 5) -> DataFrame:
    """(id, h, n, inliers): the homography that most point pairs (id, sx, sy, tx, ty) of an image pair agree with, and how many do; h is null with fewer than four.

    Four pairs at a time give a candidate, a block of candidates as stacked systems; the best one is fitted again to all that it maps within `reach`. A group is
    the matches of two images, bounded by their numbers of features. Seeded, so that a task that is run again gives the same.
    """

    def solve(s: np.ndarray, t: np.ndarray) -> np.ndarray:
        one, zero = np.ones((len(s), 1)), np.zeros((len(s), 3))
        p = np.hstack([s, one])
        a = np.vstack([np.hstack([p, zero, -t[:, :1] * p]), np.hstack([zero, p, -t[:, 1:] * p])])
        return np.linalg.svd(a)[2][-1]

    def errors(h: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        q = np.hstack([s, np.ones((len(s), 1))]) @ h.reshape(3, 3).T
        with np.errstate(all="ignore"):
            e = np.hypot(*(q[:, :2] / q[:, 2:] - t).T)
        return np.where(np.isfinite(e), e, np.inf)

    def run(rows: pa.Table) -> pa.Table:
        both = np.column_stack([rows.column(c).cast(pa.float64()).to_numpy() for c in ("sx", "sy", "tx", "ty")])
        both = both[np.lexsort(both.T[::-1])]
        s, t = both[:, :2], both[:, 2:]
        best, inside = None, np.zeros(len(s), bool)
        rng = np.random.default_rng(seed)
        for i in range(0, rounds if len(s) >= 4 else 0, 64):
            # four places each, all different; a block of candidates is solved and tried at once
            pick = np.argpartition(rng.random((min(64, rounds - i), len(s))), 3, axis=1)[:, :4]
            h, sure = four_point(s[pick], t[pick])
            q = np.hstack([s, np.ones((len(s), 1))]) @ h.reshape(-1, 3, 3).transpose(0, 2, 1)
            with np.errstate(all="ignore"):
                e = np.hypot(*np.moveaxis(q[..., :2] / q[..., 2:] - t, -1, 0))
            near = np.isfinite(e) & (e <= reach) & sure[:, None]
            k = int(near.sum(axis=1).argmax())
            if near[k].sum() > inside.sum():
                best, inside = h[k], near[k]
        if best is not None and inside.sum() >= 4:
            again = solve(s[inside], t[inside])
            near = errors(again, s, t) <= reach
            if near.sum() >= inside.sum():
                best, inside = again, near
        out = None if best is None or abs(best[-1]) < 1e-12 else (best / best[-1]).tolist()
        found = [rows.column("id").combine_chunks()[:1], pa.array([out], pa.list_(pa.float64())), pa.array([len(s)], pa.int64()), pa.array([int(inside.sum())], pa.int64())]
        return pa.table(found, ["id", "h", "n", "inliers"])

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.select("id", "sx", "sy", "tx", "ty").groupBy("id").applyInArrow(run, f"id {kind}, h array<double>, n long, inliers long")
