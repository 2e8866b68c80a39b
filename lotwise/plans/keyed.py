"""Queries on registers, annotations, references, galleries, settings, identifiers and JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import registry as N
from ..operators import tables as B
from ..sources import documents as D
from .queries import DET, detections, query, trained_models


@query("SELECT p_brand AS name, p_brand = 'Brand#7' AS active FROM part GROUP BY 1")
def model_registry(t):
    """Models registered once more under their names, and one of them made the active one."""
    m = trained_models(t).select("name", "map50", F.lit(True).alias("promotable"))
    again = m.where("name < 'Brand#2'").withColumn("map50", F.lit(0.9))
    return N.promoted(N.registered(m, again), "Brand#7").select("name", "active")


@query("SELECT r_regionkey, 'fallback' AS mode, 'drift' AS rollback_reason FROM region")
def rollback(t):
    return N.rolled_back(t("region").select("r_regionkey", F.lit("auto").alias("mode"), F.lit(None).cast("string").alias("rollback_reason")), "drift")


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'weights_missing' WHEN 1 THEN 'sha256_missing' WHEN 2 THEN 'sha256_mismatch' END AS fault FROM supplier")
def model_integrity(t):
    k = F.col("s_suppkey")
    path = F.concat(F.lit("weights/"), k.cast("string"), F.lit(".pt"))
    digest = F.sha2(k.cast("string"), 256)
    models = t("supplier").select("s_suppkey", path.alias("weights"), F.when(k % 5 == 1, "").when(k % 5 == 2, F.lit("0")).otherwise(digest).alias("sha256"))
    files = t("supplier").where("s_suppkey % 5 <> 0").select(F.concat(F.lit("/models/"), path).alias("path"), digest.alias("sha256"))
    return N.integrity(models, files, "/models").select("s_suppkey", "fault")


@query("SELECT concat('config/', n_name, '.json') AS path, CASE n_nationkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'missing_schema_version' END AS fault FROM nation WHERE n_nationkey % 4 < 3")
def setting_faults(t):
    k = F.col("n_nationkey") % 4
    path = F.concat(F.lit("config/"), "n_name", F.lit(".json"))
    files = t("nation").where(k > 0).select(path.alias("path"), F.when(k == 1, "{broken").when(k == 2, '{"retention_days": 30}').otherwise('{"schema_version": 1}').alias("value"))
    return N.setting_faults(t("nation").select(path.alias("path")), files)


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 32 THEN 'default_shards_exceeds_maximum' END, CASE WHEN p_partkey % 30 < 1 THEN 'invalid_retention_days' END, CASE WHEN p_partkey % 3 <> 0 THEN 'dataset_ratios_must_sum_to_one' END) AS faults FROM part")
def setting_values(t):
    rest = F.when(F.col("p_partkey") % 3 == 0, 0.15).otherwise(0.2)
    return t("part").select("p_partkey", N.setting_values_faults(F.col("p_size"), F.lit(32), F.col("p_partkey") % 30, [F.lit(0.7), F.lit(0.15), rest]).alias("faults"))


_IMAGE = "substr(sha256(concat('img/', {})), 1, 20)"


@query(f"WITH {DET}, i AS (SELECT c_custkey AS k FROM customer UNION SELECT cast(item_id AS bigint) FROM det), b AS (SELECT cast(item_id AS bigint) AS k, count(*) AS n, first(label ORDER BY pos) AS label FROM det WHERE label <> 'cooler' GROUP BY 1) SELECT {_IMAGE.format('k')} AS image_id, coalesce(n, 0) AS n, label AS first_label, CASE WHEN n IS NULL THEN 'unlabeled' ELSE 'labeled' END AS status FROM i LEFT JOIN b USING (k)")
def annotation_upsert(t):
    """Images of customers, then those of items that aren't there yet, then boxes on the items' images."""
    path = lambda c: F.concat(F.lit("img/"), F.col(c).cast("string"))
    have = t("customer").select(N.image_key(path("c_custkey")).alias("image_id"), path("c_custkey").alias("path"), F.col("c_custkey").cast("string").alias("item_id"), F.lit("shop").alias("source"), F.array().cast("array<struct<label: string, x1: double, y1: double, x2: double, y2: double, confidence: double>>").alias("annotations"), F.lit("unlabeled").alias("status"))
    d = detections(t)
    images = N.with_images(have, d.select(path("item_id").alias("path"), "item_id"))
    boxes = d.where("label <> 'cooler'").select(N.image_key(path("item_id")).alias("image_id"), "pos", "label", "x1", "y1", "x2", "y2", F.lit(None).cast("double").alias("confidence"))
    return N.with_boxes(images, boxes).select("image_id", F.size("annotations").cast("long").alias("n"), F.get("annotations", F.lit(0))["label"].alias("first_label"), "status")


@query(f"WITH {DET} SELECT item_id AS image_id, concat('missing_image:img/', item_id) AS fault FROM det WHERE cast(item_id AS int) % 10 = 0 GROUP BY item_id UNION ALL SELECT item_id, concat('unknown_class:', label) FROM det WHERE label = 'bent_pins' UNION ALL SELECT item_id, concat('invalid_box:', item_id) FROM det WHERE x2 > 130 AND cast(item_id AS int) % 2 = 0")
def annotation_errors(t):
    d = detections(t)
    k = F.col("item_id").cast("int")
    broken = F.when((F.col("x2") > 130) & (k % 2 == 0), F.col("x1")).otherwise(F.col("x2"))
    images = d.groupBy("item_id").agg(F.collect_list(F.struct("label", "x1", "y1", broken.alias("x2"), "y2")).alias("annotations")).select(F.col("item_id").alias("image_id"), F.concat(F.lit("img/"), "item_id").alias("path"), "annotations")
    files = d.where(k % 10 != 0).select(F.concat(F.lit("img/"), "item_id").alias("path"))
    return N.annotation_faults(images, ("visible_cpu", "empty_socket", "cooler", "socket_cover", "ram_dimm", "nvme"), files)


@query("WITH r AS (SELECT p_brand AS model, 'review' AS source_type, concat('https://r/', p_partkey) AS source, 'a' AS revision FROM part UNION ALL SELECT p_brand, 'manufacturer', concat('https://m/', p_partkey), 'b' FROM part) SELECT substr(sha256(concat(trim(regexp_replace(upper(model), '[^A-Z0-9]+', '-', 'g'), '-'), '|', source_type, '|', source)), 1, 16) AS id, source_type, CASE source_type WHEN 'review' THEN 0.6::double ELSE 1.0::double END AS trust, revision FROM r")
def reference_upsert(t):
    """References of two kinds; those that were there under the same id are replaced."""
    policy = t("region").sparkSession.createDataFrame([("manufacturer", 1.0, False), ("review", 0.6, True)], "source_type string, trust double, manual boolean")
    p = t("part")
    rows = lambda kind, at, revision: p.select(F.col("p_brand").alias("model"), F.lit(kind).alias("source_type"), F.concat(F.lit(at), F.col("p_partkey").cast("string")).alias("source"), F.lit(kind == "review").alias("approved"), F.lit(revision).alias("revision"))
    none = p.limit(0).select(*(F.lit(None).cast(k).alias(c) for c, k in (("id", "string"), ("model", "string"), ("model_key", "string"), ("source_type", "string"), ("source", "string"), ("trust", "double"), ("approved", "boolean"), ("revision", "string"))))
    first = N.with_references(none, rows("manufacturer", "https://m/", "old").union(rows("review", "https://r/", "a")), policy)
    return N.with_references(first, rows("manufacturer", "https://m/", "b"), policy).select("id", "source_type", "trust", "revision")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'io,socket' ELSE 'dimm,io,socket' END AS names, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 3 END AS socket_points FROM supplier")
def region_upsert(t):
    """Named regions written over those of a board; boards that get none keep theirs."""
    point = lambda *x: F.array(*map(F.lit, x))
    boards = t("supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("model_key"), F.map_from_arrays(F.array(F.lit("socket"), F.lit("io")), F.array(point(1.0), point(2.0))).alias("regions"))
    news = boards.where("s_suppkey % 3 <> 0").select("model_key", F.explode(F.map_from_arrays(F.array(F.lit("socket"), F.lit("dimm")), F.array(point(1.0, 2.0, 3.0), point(4.0)))).alias("name", "polygon"))
    out = N.with_regions(boards, news)
    return out.select("s_suppkey", F.concat_ws(",", F.array_sort(F.map_keys("regions"))).alias("names"), F.size(F.element_at("regions", "socket")).alias("socket_points"))


@query("SELECT o_orderkey AS id, coalesce(p_name, '') AS title, CASE WHEN p_name IS NULL THEN 0 ELSE 2 END AS n_urls, coalesce(p_type, '') AS description FROM orders LEFT JOIN part ON o_orderkey = p_partkey")
def gallery_nesting(t):
    galleries = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("urls"), F.col("p_type").alias("description"))
    return N.extracted(N.embedded(t("orders").select(F.col("o_orderkey").alias("id")), galleries)).select("id", "title", F.size("urls").alias("n_urls"), "description")


@query(f"WITH {DET}, r AS (SELECT item_id, cast(pos % 4 * 90 AS int) AS rotation, max(score) AS score FROM det GROUP BY ALL) SELECT item_id, rotation, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rotation) AS rank FROM r")
def rotation_ranks(t):
    scores = detections(t).groupBy("item_id", (F.col("pos") % 4 * 90).cast("int").alias("rotation")).agg(F.max("score").alias("score"))
    return N.rotations(scores).select("item_id", "rotation", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)")
def find_by_name(t):
    first = t("nation").agg(F.min("n_name")).first()[0]
    return N.find_by_name(t("nation"), first, "n_name").select("n_nationkey", "n_name")


@query("SELECT o_orderkey, strftime(o_orderdate + to_hours(o_orderkey % 24), '%Y-%m-%dT%H:%M:%SZ') AS at, o_orderdate + to_hours(o_orderkey % 24) AS back, substr(sha256(concat(o_orderkey, '|', o_orderstatus, '|', o_orderpriority)), 1, 16) AS id, cast(round(least(30000, 1500 * pow(2, greatest(0, o_orderkey % 8 - 1))) * (0.8 + (o_orderkey % 64) / 64.0::double * 0.4)) AS bigint) AS wait, CASE o_orderkey % 3 WHEN 0 THEN 1.0::double WHEN 1 THEN 2.0::double ELSE 0.0::double END AS ram FROM orders")
def identifiers(t):
    """Times as text and back, short ids, waits before another attempt, and a map's value under one of two names."""
    k = F.col("o_orderkey")
    at = F.expr("o_orderdate + make_interval(0, 0, 0, 0, cast(o_orderkey % 24 as int), 0, 0)")
    scores = F.when(k % 3 == 0, F.create_map(F.lit("ram_dimm"), F.lit(1.0), F.lit("ram"), F.lit(9.0))).when(k % 3 == 1, F.create_map(F.lit("ram"), F.lit(2.0))).otherwise(F.create_map(F.lit("nvme"), F.lit(3.0)))
    text = X.iso_time(at)
    return t("orders").select("o_orderkey", text.alias("at"), X.from_iso(text).alias("back"), X.short_id(k.cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("id"), X.backoff(k % 8, (k % 64) / F.lit(64.0)).alias("wait"), X.map_value(scores, "ram_dimm", "ram").alias("ram"))


@query("SELECT page_id, CASE WHEN regexp_matches(h, '(.*\\.)?shop\\.example\\.com$') THEN 'review' WHEN h = 'example.com' OR h LIKE '%.example.com' THEN 'manufacturer' WHEN h = 'example.org' OR h LIKE '%.example.org' THEN 'ebay' END AS source_type FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '') AS h FROM pages)")
def ordered_source_types(t):
    """Types of source in their order; a marketplace counts as the one that listings are searched on."""
    from ..operators import references as R

    host = X.url_host(F.col("url"))
    return t("pages").select("page_id", R.source_type(host, {"review": ("shop.example.com",), "manufacturer": ("example.com",)}, ("example.org",)).alias("source_type"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def json_documents(t):
    """Rows written as JSON documents, some as bare lists and some under a name with a version, and read again."""
    rows = t("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))).alias("entries"))
    texts = rows.select(F.when(F.col("n_regionkey") % 2 == 0, F.to_json("entries")).otherwise(F.to_json(F.struct(F.lit(2).alias("schema_version"), "entries"))).alias("value"))
    return D.parsed(texts, "id long, name string", "entries", 2)


@query("SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 3 = 0 THEN 'legacy' ELSE 'h' END AS listing_hash, NULL::varchar AS result_hash FROM orders")
def ledger_migration(t):
    old = t("orders").select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") % 3 != 0, "h").alias("listing_hash"))
    return D.migrated_ledger(old)


@query("SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, max(ts) AS last FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY GROUP BY 1")
def run_log(t):
    """A compact row for each run added to the earlier ones, and those that are too old left out."""
    e = t("events").select("user_id", "event_type", "ts")
    half = F.expr("timestamp_ntz'2024-01-16'")
    log = B.retained(e.where(F.col("ts") < half).unionByName(e.where(F.col("ts") >= half)), "ts", "2024-01-31 00:00:00", 20)
    return log.groupBy("user_id").agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("ts").alias("last"))


@query("SELECT p_partkey, ['INTEL CORE I7-8700K', 'AMD RYZEN 5 3600|RYZEN 5 3600', 'RYZEN 7 5800X3D', ''][p_partkey % 4 + 1] AS cpus FROM part")
def cpu_candidates(t):
    """Names of processors in a text, the first of equals kept; the twin's names are written out by hand."""
    said = F.get(F.array(*map(F.lit, ("with Intel Core i7-8700K, used", "and AMD Ryzen 5 3600 (box)", "Ryzen 7 5800X3D / RYZEN  7 5800X3D", "no cpu i7"))), (F.col("p_partkey") % 4).cast("int"))
    return t("part").select("p_partkey", F.concat_ws("|", X.cpu_candidates(F.concat_ws(" ", "p_name", said))).alias("cpus"))
