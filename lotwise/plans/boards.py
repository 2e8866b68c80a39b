"""Queries on identification, price intervals, references, layouts, segments and slot banks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boards as B
from ..operators import references as R
from ..operators import sets as S
from .queries import _EMB, DET, detections, features, query, r6

_ROLES = {"cooler": "cooler", "installed": "visible_cpu", "empty": "empty_socket", "cover": "socket_cover", "damage": "bent_pins", "ram": "socket_cover", "nvme": "visible_cpu"}
_WIDE = ", ".join(f"coalesce(max(CASE WHEN label = '{x}' THEN score END), 0) AS {n}" for n, x in _ROLES.items())


@query(f"""WITH {DET}, w AS (SELECT item_id, {_WIDE} FROM det GROUP BY item_id),
s AS (SELECT *, CASE WHEN cooler >= 0.45 THEN 'cooler_attached_cpu_highly_likely' WHEN installed >= 0.45 AND installed >= empty + 0.08::double THEN 'visible_cpu_likely'
 WHEN empty >= 0.45 AND empty >= installed + 0.08::double THEN 'empty_socket_likely' WHEN cover >= 0.45 THEN 'socket_cover_likely' ELSE 'unclear' END AS cpu_state, abs(installed - empty) + greatest(installed, empty) AS border FROM w)
SELECT item_id, cpu_state, round(CASE cpu_state WHEN 'cooler_attached_cpu_highly_likely' THEN cooler WHEN 'visible_cpu_likely' THEN installed WHEN 'empty_socket_likely' THEN empty WHEN 'socket_cover_likely' THEN cover ELSE greatest(cooler, installed, empty, cover) END, 6) AS cpu_confidence,
 concat_ws(',', CASE WHEN cpu_state = 'unclear' THEN 'socket_state_unclear' END, CASE WHEN border >= 0.35 AND border < 0.60 THEN 'borderline_socket_evidence' END, CASE WHEN damage >= 0.38 THEN 'possible_physical_damage' END) AS reasons,
 CASE cpu_state WHEN 'cooler_attached_cpu_highly_likely' THEN 100 WHEN 'visible_cpu_likely' THEN 80 WHEN 'empty_socket_likely' THEN -100 WHEN 'socket_cover_likely' THEN -60 ELSE 0 END
 + CASE WHEN ram >= 0.38 THEN 35 ELSE 0 END + CASE WHEN nvme >= 0.38 THEN 25 ELSE 0 END - CASE WHEN damage >= 0.38 THEN 100 ELSE 0 END AS value_score FROM s""")
def single_pass_state(t):
    w = S.maxima_wide(detections(t), "item_id", _ROLES)
    return B.single_pass_state(w).select("item_id", "cpu_state", *r6("cpu_confidence"), F.concat_ws(",", "review_reasons").alias("reasons"), "value_score")


_ID = """r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS raw, CASE WHEN p_partkey % 4 > 0 AND p_partkey % 9 > 0 THEN p_brand END AS lk, CASE WHEN p_partkey % 4 > 0 AND p_partkey % 9 > 0 THEN 0.5::double + (p_partkey * 37 % 64) / 128.0::double ELSE 0 END AS ls,
 CASE WHEN p_partkey % 3 > 0 THEN p_type END AS vraw, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS vk, CASE WHEN p_partkey % 3 > 0 THEN 0.5::double + (p_partkey * 23 % 64) / 128.0::double ELSE 0 END AS vs, (p_partkey * 11 % 128) / 64.0::double AS agreement, p_partkey % 5 = 0 AS conflict FROM part),
u AS (SELECT *, CASE WHEN raw IS NULL OR ls >= 0.6 THEN lk END AS l, CASE WHEN vraw IS NULL OR vs >= 0.6 THEN vk END AS v FROM r),
b AS (SELECT *, CASE WHEN l IS NOT NULL AND ls >= 0.82 THEN CASE WHEN v IS NOT NULL AND vs >= 0.75 THEN CASE WHEN NOT conflict AND agreement >= 0.82 THEN 1 ELSE 2 END ELSE 3 END WHEN raw IS NOT NULL AND l IS NULL THEN CASE WHEN v IS NOT NULL AND vs >= 0.82 THEN 4 ELSE 5 END WHEN v IS NOT NULL AND vs >= 0.82 THEN 6 END AS k FROM u)"""


@query(f"WITH {_ID} SELECT p_partkey, CASE WHEN k <= 3 THEN l WHEN k IN (4, 6) THEN v WHEN k = 5 THEN raw END AS text, round(CASE k WHEN 1 THEN least(0.995, 0.88 + 0.08 * ls + 0.04 * vs) WHEN 2 THEN least(0.9, ls) WHEN 3 THEN least(0.94, 0.82 + 0.12 * ls) WHEN 4 THEN least(0.94, vs) WHEN 5 THEN 0.72::double WHEN 6 THEN least(0.94, vs) END, 6) AS confidence, ['listing_confirmed', 'listing_conflict', 'listing_probable', 'visually_identified', 'listing_uncatalogued', 'visually_identified'][k] AS source, CASE WHEN k < 6 THEN raw END AS stated_text, ['visual_agreement', 'visual_conflict', 'not_visually_confirmed', 'listing_uncatalogued_or_incomplete', 'catalog_missing', 'listing_missing_model'][k] AS confirmation FROM b")
def identification(t):
    k = F.col("p_partkey")
    listed, seen, keyed = k % 4 > 0, k % 3 > 0, (k % 4 > 0) & (k % 9 > 0)
    near = lambda by: 0.5 + (k * by % 64) / 128.0
    rows = t("part").select(
        "p_partkey",
        F.when(listed, F.col("p_name")).alias("listing_raw"), F.when(keyed, F.col("p_brand")).alias("listing_key"), F.when(keyed, near(37)).otherwise(0.0).alias("listing_score"),
        F.when(seen, F.col("p_type")).alias("visual_raw"), F.when(seen, F.col("p_type")).alias("visual_key"), F.when(seen, near(23)).otherwise(0.0).alias("visual_score"),
        (k * 11 % 128 / 64.0).alias("agreement"), (k % 5 == 0).alias("conflict"),
    )
    return B.resolved_identification(rows).select("p_partkey", "text", *r6("confidence"), "source", "stated_text", "confirmation")


_POINTS = (("low", 0.5), ("median", 0.75), ("high", 1.25))


@query("SELECT p_partkey, " + ", ".join(f"round(v{i}, 6) AS value_{k}, round(v{i} - cost, 6) AS profit_{k}, round(greatest(0, v{i} - ship - 60), 6) AS max_bid_{k}" for i, (k, _) in enumerate(_POINTS)) + " FROM (SELECT p_partkey, p_size * 16.0::double AS cost, p_size * 2.0::double AS ship, " + ", ".join(f"p_retailprice * {x}::double + CASE WHEN p_size % 3 < 2 AND p_partkey % 7 > 0 THEN p_size * {x}::double ELSE 0 END AS v{i}" for i, (_, x) in enumerate(_POINTS)) + " FROM part)")
def market_interval(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    prices = lambda c: F.struct(*((c * x).alias(n) for n, x in _POINTS))
    reasons = F.when(size % 3 == 0, F.array(F.lit("cpu_visible"))).when(size % 3 == 1, F.array(F.lit("ram_visible"), F.lit("cooler_attached"))).otherwise(F.array(F.lit("ram_visible")))
    rows = t("part").select("p_partkey", prices(F.col("p_retailprice")).alias("board"), F.when(k % 7 > 0, prices(size)).alias("cpu"), reasons.alias("reasons"), (size * 16.0).alias("acquisition_cost"), (size * 2.0).alias("shipping"))
    return B.market_interval(rows).select("p_partkey", *r6(*(f"{what}_{n}" for n, _ in _POINTS for what in ("value", "profit", "max_bid"))))


@query(f"""WITH {_EMB}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY id) AS n FROM e WHERE model % 3 > 0) WHERE n <= 8), i AS (SELECT id // 3 AS item_id, model, v FROM e),
p AS (SELECT item_id, f.id AS reference, f.id IS NOT NULL AS known, f.id % 2 = 0 AND (f.model % 7 <> 1) AS approved, 1 / (1 + list_distance(i.v, f.v)) + 0.1 AS score, len(list_filter(range(1, len(i.v) + 1), lambda k: abs(i.v[k] - f.v[k]) < 0.1)) AS good, len(list_filter(range(1, len(i.v) + 1), lambda k: (i.v[k] > 0) = (f.v[k] > 0))) / len(i.v) AS inlier_ratio FROM i LEFT JOIN f USING (model)),
b AS (SELECT item_id, bool_or(known) AS known, count(*) FILTER (WHERE approved) AS evaluated, max(struct_pack(score := score, back := -reference, good := good, inlier_ratio := inlier_ratio)) FILTER (WHERE approved) AS m FROM p GROUP BY 1)
SELECT item_id, -m.back AS reference, round(coalesce(m.score, 0), 4) AS score, m.good AS good, round(m.inlier_ratio, 4) AS inlier_ratio, CASE WHEN NOT known THEN 'no_reference' WHEN m.good >= 18 AND m.inlier_ratio >= 0.32 AND m.score >= 0.58 THEN 'reference_confirmed' WHEN coalesce(m.score, 0) < 0.42 THEN 'reference_conflict' ELSE 'reference_uncertain' END AS status, evaluated FROM b""")
def best_reference(t):
    """Each item's best approved reference and what it says: components that are near count as good matches, those of one sign as inliers."""
    e = features(t)
    refs = e.where("model % 3 > 0").select(F.col("id").alias("reference"), "model", "v", ((F.col("id") % 2 == 0) & (F.col("model") % 7 != 1)).alias("approved"))
    images = e.select(F.expr("id div 3").alias("item_id"), "model", "v")

    def match(v, w):
        count = lambda test: F.size(F.filter(F.zip_with(v, w, lambda x, y: test(x.cast("double"), y.cast("double"))), lambda hit: hit))
        good = count(lambda x, y: F.abs(x - y) < 0.1)
        inliers = count(lambda x, y: (x > 0) == (y > 0)) / F.size(v)
        return F.struct((1 / (1 + R.euclid(v, w)) + 0.1).alias("score"), good.alias("good"), inliers.alias("inlier_ratio"))

    found = B.best_references(images, refs, match, most=8)
    return found.select("item_id", "reference", F.round("score", 4).alias("score"), F.col("good").cast("long").alias("good"), F.round("inlier_ratio", 4).alias("inlier_ratio"), "status", "evaluated")


@query("SELECT p_brand AS model, 'verified_listing' AS source_type, concat(p_partkey, '_', n, '.jpg') AS source, p_partkey AS source_item_id FROM part, range(1, 4) r(n) WHERE n <= p_partkey % 4 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def candidate_manifest(t):
    k = F.col("p_partkey")
    images = F.transform(F.when(k % 4 > 0, F.sequence(F.lit(1), (k % 4).cast("int"))).otherwise(F.array().cast("array<int>")), lambda n: F.concat(k.cast("string"), F.lit("_"), n.cast("string"), F.lit(".jpg")))
    queue = t("part").select(k.alias("item_id"), F.col("p_brand").alias("model"), images.alias("listing_images"))
    return B.candidate_manifest(queue, t("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("item_id")))


@query("SELECT item_id, coalesce(board, own) AS model, status, concat('\"', coalesce(board, own), '\" motherboard official product image') AS first_query, status <> 'no_reference' AS human_review FROM (SELECT cast(c_custkey AS varchar) AS item_id, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS own, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS board, ['no_reference', 'reference_conflict', 'reference_confirmed', 'model_unknown'][c_nationkey % 4 + 1] AS status FROM customer) WHERE coalesce(board, own) IS NOT NULL AND status IN ('no_reference', 'reference_conflict', 'reference_uncertain')")
def gap_queue(t):
    c = t("customer")
    item = F.col("c_custkey").cast("string").alias("item_id")
    status = F.get(F.array(*map(F.lit, ("no_reference", "reference_conflict", "reference_confirmed", "model_unknown"))), (F.col("c_nationkey") % 4).cast("int"))
    verified = c.select(item, F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("model"), status.alias("status"), F.lit(0.5).alias("identity_score"))
    identified = c.select(item, F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("board"))
    return R.gap_queue(verified, identified).select("item_id", "model", "status", F.get("queries", F.lit(0)).alias("first_query"), "human_review")


@query()
def distinct_boxes(t):
    return B.distinct_boxes(detections(t), 0.45, 20).select("item_id", "image_index", "pos")


@query(f"""WITH {DET}, c AS (SELECT pos, x1, y1, x2 - x1 AS w, y2 - y1 AS h, CASE WHEN pos % 3 > 0 THEN x1 + (x2 - x1) * (pos % 5) / 4 END AS dx, CASE WHEN pos % 2 > 0 THEN y1 + (y2 - y1) * (pos % 7) / 8 END AS py FROM det),
e AS (SELECT *, x1 + w * 0.12::double AS l, y1 + h * 0.05::double AS t, least(coalesce(dx, x1 + w * 0.76::double) - w * 0.035::double, x1 + w * 0.72::double) AS r, least(coalesce(py, y1 + h * 0.58::double) - h * 0.035::double, y1 + h * 0.58::double) AS b FROM c)
SELECT pos, round(l, 6) AS x1, round(t, 6) AS y1, round(CASE WHEN r <= l THEN x1 + w * 0.68::double ELSE r END, 6) AS x2, round(CASE WHEN b <= t THEN y1 + h * 0.52::double ELSE b END, 6) AS y2 FROM e""")
def cpu_region(t):
    x1, y1, x2, y2, pos = (F.col(k) for k in ("x1", "y1", "x2", "y2", "pos"))
    dimm = F.when(pos % 3 > 0, x1 + (x2 - x1) * (pos % 5) / 4)
    pcie = F.when(pos % 2 > 0, y1 + (y2 - y1) * (pos % 7) / 8)
    return detections(t).select("pos", B.cpu_region(x1, y1, x2, y2, dimm, pcie).alias("r")).select("pos", "r.*").select("pos", *r6("x1", "y1", "x2", "y2"))


_SLOT = "count(*) FILTER (WHERE label = '{0}') AS {1}"
_IN = "label IN ('visible_cpu', 'cooler')"


@query(f"""WITH {DET}, g AS (SELECT item_id, {_SLOT.format('visible_cpu', 'a')}, {_SLOT.format('cooler', 'b')}, {_SLOT.format('empty_socket', 'd')}, {_SLOT.format('bent_pins', 'cpu')}, arg_min((x1 + x2) / 512, pos) FILTER (WHERE label = 'socket_cover') AS io,
 avg((x1 + x2) / 512) FILTER (WHERE {_IN}) AS mx, avg((y1 + y2) / 512) FILTER (WHERE {_IN}) AS my, count(*) FILTER (WHERE label = 'empty_socket' AND pos % 3 = 0) AS odd FROM det GROUP BY item_id)
SELECT item_id, concat_ws('; ', CASE WHEN a = 0 THEN 'at least one PCIe x16 slot is required' END, CASE WHEN b <> 1 THEN concat('expected 1 PCIe x1 slots, found ', b) END, CASE WHEN a <> 2 THEN concat('expected 2 PCIe x16 slots, found ', a) END,
 CASE WHEN io IS NULL THEN 'rear I/O rectangle is required' END, CASE WHEN cpu = 0 THEN 'CPU socket polygon is required' END, CASE WHEN io <= mx THEN 'rear I/O must be to the right of the PCIe bank in canonical orientation' END,
 CASE WHEN mx > 0.55 OR my > 0.62 THEN 'PCIe bank must occupy the upper-left canonical board region' END, CASE WHEN d > 0 AND (odd > 0 OR d > 4) THEN 'DIMM slots must be ordered from CPU outward as DIMM1..DIMM4' END) AS errors FROM g""")
def layout_errors(t):
    at = lambda x, y: F.struct((F.col(x) / 256).alias("x"), (F.col(y) / 256).alias("y"))
    polygon = F.array(at("x1", "y1"), at("x2", "y1"), at("x2", "y2"), at("x1", "y2"))
    slots = lambda label: F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("pos", "polygon"))))
    named = lambda c: F.transform(c, lambda s, k: F.struct(F.when(s["pos"] % 3 > 0, F.concat(F.lit("DIMM"), (k + 1).cast("string"))).alias("label"), s["polygon"].alias("polygon")))
    names = {"x16": "visible_cpu", "x1": "cooler", "dimms": "empty_socket", "rear": "socket_cover", "socket": "bent_pins"}
    g = detections(t).withColumn("polygon", polygon).groupBy("item_id").agg(*(slots(x).alias(k) for k, x in names.items()))
    one = lambda k: F.get(F.col(k), F.lit(0))["polygon"]
    errors = B.layout_errors(named(F.col("x16")), named(F.col("x1")), named(F.col("dimms")), one("rear"), one("socket"), F.lit(2), F.lit(1), F.lit(None).cast("int"))
    return g.select("item_id", F.concat_ws("; ", errors).alias("errors"))


@query(f"""WITH {DET}, l AS (SELECT item_id, pos, x1, y1, x2, y1 + (y2 - y1) / 32 AS y2 FROM det), s AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len, (degrees(atan2(y2 - y1, x2 - x1)) + 180) % 180 AS deg FROM l), u AS (SELECT *, (x2 - x1) / len AS ux, (y2 - y1) / len AS uy FROM s),
p AS (SELECT a.item_id, a.pos AS a, b.pos AS b, (a.deg + b.deg) / 2 AS angle, least(a.len, b.len) AS short, greatest(a.len, b.len) AS long, a.x1 * a.ux + a.y1 * a.uy AS p1, a.x2 * a.ux + a.y2 * a.uy AS p2, b.x1 * a.ux + b.y1 * a.uy AS q1, b.x2 * a.ux + b.y2 * a.uy AS q2,
 abs((b.y1 + b.y2 - a.y1 - a.y2) / 2 * a.ux - (b.x1 + b.x2 - a.x1 - a.x2) / 2 * a.uy) AS width FROM u a JOIN u b ON a.item_id = b.item_id AND a.pos < b.pos WHERE abs(a.deg - b.deg) <= 4.5),
o AS (SELECT *, greatest(0, least(p2, greatest(q1, q2)) - greatest(p1, least(q1, q2))) / short AS part FROM p WHERE long / greatest(1, short) <= 1.35)
SELECT item_id, a, b, round(angle, 6) AS angle, round(short * part, 6) AS length, round(width, 6) AS width, round(0.35 * least(1, short * part / width / 12) + 0.25 * part + 0.15 * (1 - (long - short) / long), 6) AS score FROM o WHERE part >= 0.72 AND width BETWEEN 4 AND 34 AND short * part / width >= 4""")
def segment_pairs(t):
    lines = detections(t).select("item_id", F.col("pos").alias("id"), "x1", "y1", "x2", (F.col("y1") + (F.col("y2") - F.col("y1")) / 32).alias("y2"))
    return B.segment_pairs(lines).select("item_id", "a", "b", *r6("angle", "length", "width", "score"))


@query(f"""WITH {DET}, m AS (SELECT item_id, pos, x2 - x1 AS len, y2 - y1 AS wid, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, pos % 5 AS angle, x1, y1, x2, y2 FROM det),
o AS (SELECT *, cy * cos(radians(ang)) - cx * sin(radians(ang)) AS o FROM (SELECT *, avg(angle) OVER (PARTITION BY item_id) AS ang, median(len) OVER (PARTITION BY item_id) AS med FROM m)),
g AS (SELECT *, o - lag(o) OVER (PARTITION BY item_id ORDER BY o, pos) AS gap FROM o),
s AS (SELECT item_id, count(*) AS n, stddev_pop(len) / avg(len) AS lcv, stddev_pop(wid) / avg(wid) AS wcv, coalesce(stddev_pop(gap) / greatest(1e-6, median(gap)), 1) AS gcv, (min(x1) + max(x2)) / 400.0::double AS x, (min(y1) + max(y2)) / 400.0::double AS y, avg(CASE WHEN len >= med * 0.82::double THEN 1 ELSE 0 END) + avg(CASE WHEN len <= med * 0.62::double THEN 1 ELSE 0 END) AS mixed FROM g GROUP BY item_id),
r AS (SELECT item_id, n, 0.28 * greatest(0, 1 - abs(n - 4) / 3) + 0.24 * greatest(0, 1 - lcv / 0.35) + 0.16 * greatest(0, 1 - wcv / 0.45) + 0.2 * greatest(0, 1 - gcv / 0.55) + 0.12 * greatest(0, least(1, (x - 0.42) / 0.38)) AS ds,
 0.22 * greatest(0, least(1, (n - 2) / 4)) + 0.18 * greatest(0, 1 - gcv / 0.8) + 0.22 * greatest(0, least(1, (0.58 - x) / 0.45)) + 0.12 * greatest(0, least(1, (0.72 - y) / 0.55)) + 0.14 * least(1, mixed) + 0.12 * greatest(0, 1 - wcv / 0.65) AS ps FROM s)
SELECT item_id AS bank, n, round(ds, 6) AS dimm_score, round(ps, 6) AS pcie_score, CASE WHEN ds >= 0.58 AND ds > ps + 0.08 THEN 'dimm_bank' WHEN ps >= 0.5 THEN 'pcie_bank' ELSE 'unknown' END AS label FROM r""")
def slot_banks(t):
    half = lambda a, b: (F.col(a) + F.col(b)) / 2
    m = detections(t).select(F.col("item_id").alias("bank"), "pos", (F.col("x2") - F.col("x1")).alias("length"), (F.col("y2") - F.col("y1")).alias("width"), half("x1", "x2").alias("cx"), half("y1", "y2").alias("cy"), (F.col("pos") % 5).alias("angle"), "x1", "y1", "x2", "y2")
    return B.slot_banks(m, 200.0, 200.0).select("bank", "n", *r6("dimm_score", "pcie_score"), "label")


@query()
def ransac_homography(t):
    far = F.when(F.col("pos") % 6 == 5, 90.0).otherwise(0.0)
    pairs = detections(t).select(F.expr("pos div 24").alias("id"), F.col("x1").alias("sx"), F.col("y1").alias("sy"), (F.col("x1") * 1.1 + F.col("y1") * 0.2 + 5 + far).alias("tx"), (F.col("y1") * 0.9 - F.col("x1") * 0.1 + 7).alias("ty"))
    return B.ransac_homographies(pairs).select("id", "n", "inliers")
