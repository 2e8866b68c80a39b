"""Queries on files that are written from the tables first and read again."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import report as P
from ..operators.names import best_names
from ..sources import documents as D
from ..sources import npz
from ..sources.shared import as_table, shared_dir
from ..sources.versions import Versioned
from .queries import _RUN, VALUE, features, query, run_report, values


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


_MONEY = "concat('$', format('{{:,.2f}}', {}))"


@query("SELECT cast(label AS varchar) AS reference, cast(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS int) AS point, round(cast(embedding[1] AS float)::double, 5) AS x, round(cast(embedding[2] AS float)::double, 5) AS y, printf('%016X', vec_id) AS descriptor, 640 AS width FROM embeddings")
def feature_files(t):
    """Key points as an NPZ file for each reference, and what is read from them."""
    v = F.col("v")
    points = features(t).select(F.col("model").cast("string").alias("reference"), F.col("id").cast("int").alias("point"), v[0].alias("x"), v[1].alias("y"), F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("descriptor"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    path = _folder(points, "features")
    npz.write_points(points, path)
    back = npz.read_points(points.sparkSession, path).where("error is null")
    return back.select("reference", "point", *(F.round(F.col(c).cast("double"), 5).alias(c) for c in ("x", "y")), F.hex("descriptor").alias("descriptor"), "width")


@query("SELECT cast(label AS varchar) AS item_id, string_agg(DISTINCT concat(label, '_', vec_id % 12, '.npz'), ',' ORDER BY concat(label, '_', vec_id % 12, '.npz')) AS images FROM embeddings GROUP BY label")
def item_files(t):
    """Each item's files by name as text, so that _10 comes before _2."""
    points = features(t).select(F.concat("model", F.lit("_"), F.col("id") % 12).alias("reference"), F.col("id").cast("int").alias("point"), F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.lit(b"d").alias("descriptor"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    path = _folder(points, "images")
    npz.write_points(points, path)
    return D.item_images(points.sparkSession, path, ".npz").select("item_id", F.concat_ws(",", "images").alias("images"))


@query("SELECT concat(label, '.npz') AS name, true AS known FROM embeddings GROUP BY label")
def file_inventory(t):
    """The files below a folder with their checksums; each is what packing its points anew gives."""
    points = features(t).select(F.col("model").cast("string").alias("reference"), F.col("id").cast("int").alias("point"), F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.lit(b"d").alias("descriptor"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    one, two = _folder(points, "inventory"), _folder(points, "inventory")
    npz.write_points(points, one)
    npz.write_points(points.repartition(3), two)
    listed = lambda path: D.inventory(points.sparkSession, path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "sha256", "bytes")
    return listed(one).join(listed(two), ["name", "sha256", "bytes"], "left_semi").select("name", (F.col("bytes") > 0).alias("known"))


@query("SELECT p_brand AS model, count(*) AS n, round(sum(l_extendedprice), 2) AS realized FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N' GROUP BY 1")
def outcome_log(t):
    """Outcomes appended to a log in two runs, and the log read as one."""
    sold = t("lineitem").where("l_returnflag <> 'N'").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("model"), "l_returnflag", F.col("l_extendedprice").alias("realized"))
    path = _folder(sold, "outcomes")
    for flag in ("A", "R"):
        D.append_rows(sold.where(F.col("l_returnflag") == flag), path)
    return sold.sparkSession.read.schema(sold.schema).parquet(path).groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("realized"), 2).alias("realized"))


@query("SELECT o_orderkey AS id, o_orderpriority AS priority, [cast(o_custkey AS varchar), o_orderstatus] AS tags FROM orders".replace("[cast(o_custkey AS varchar), o_orderstatus] AS tags", "concat(o_custkey, ',', o_orderstatus) AS tags"))
def json_sink(t):
    """Nested rows written as JSON and read again."""
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderpriority").alias("priority"), F.array(F.col("o_custkey").cast("string"), "o_orderstatus").alias("tags")).alias("listing"))
    path = _folder(rows, "json")
    D.write_list(rows, path)
    return rows.sparkSession.read.schema(rows.schema).json(path).select("id", "listing.priority", F.concat_ws(",", "listing.tags").alias("tags"))


@query(f"""WITH {VALUE}, {_RUN}, al AS (SELECT 'bid_candidate' AS type, item_id, profit, max_bid, NULL AS detail FROM rec WHERE recommendation = 'bid' AND profit >= 5 AND confidence >= 0.75 AND max_bid <= 300 UNION ALL SELECT 'model_drift', NULL, NULL, NULL, 'confidence_drop' FROM run WHERE rb UNION ALL SELECT 'crawler_errors', NULL, NULL, NULL, cast(se + ge AS varchar) FROM run WHERE se + ge > 0)
SELECT row_number() OVER (ORDER BY type DESC, profit DESC NULLS LAST, item_id) AS place, concat('<div class="alert"><span class="kind">', type, '</span><span class="item">', coalesce(item_id, ''), '</span><span class="gain">', CASE WHEN profit IS NULL THEN '-' ELSE {_MONEY.format('profit')} END, '</span><span class="limit">', CASE WHEN max_bid IS NULL THEN '-' ELSE {_MONEY.format('max_bid')} END, '</span><span class="what">', coalesce(detail, ''), '</span></div>') AS line FROM al""")
def report_page(t):
    """The lines of the report's alerts, each of them, after the page was written and read again."""
    v = as_table(values(t).select("item_id", "pos", "title", "current_bid", "profit", "max_bid", "confidence", "recommendation", "reasons"), "values")
    found = P.alerts(v, run_report(t), 5.0, 0.75, 300.0)
    healthy = run_report(t).select((F.col("search_errors") + F.col("gallery_errors") <= 3).alias("healthy"))
    lines = as_table(P.page_lines(v, found, P.overview(v, run_report(t), healthy), "2024-01-01"), "lines")
    path = _folder(lines, "page")
    P.write_page(lines, path)
    written = lines.sparkSession.read.text(path).select(F.col("value").alias("line"))
    # alerts are told apart by their lines
    return lines.where("section = 1 and place > 0").join(written.distinct(), "line", "left_semi").select("place", "line")


def _shipped(t) -> Versioned:
    """Orders by key, then what their lines say of them, merged twice as after a lost answer."""
    orders = t("orders").select(F.col("o_orderkey").cast("long").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("status"))
    lines = t("lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").cast("long").alias("id")).agg(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("day")).withColumn("status", F.lit("shipped"))
    table = Versioned(orders.sparkSession, _folder(orders, "ledger"), orders.schema, "id", "day", 8)
    table.merge(orders, "orders", 0)
    for _ in range(2):
        table.merge(lines, "lines", 0)
    return table


_SHIPPED = """o AS (SELECT cast(o_orderkey AS bigint) AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS status, 1 AS nr FROM orders),
l AS (SELECT cast(l_orderkey AS bigint) AS id, strftime(max(l_shipdate), '%Y-%m-%d') AS day, 'shipped' AS status, 2 AS nr FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
current AS (SELECT id, day, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day DESC, nr DESC) AS n FROM (SELECT * FROM o UNION ALL SELECT * FROM l)) WHERE n = 1)"""


@query(f"WITH {_SHIPPED} SELECT id, day, status FROM current")
def versioned_ledger(t):
    """A table of versions after two merges, one sent again, and compaction: the latest row of each key."""
    table = _shipped(t)
    table.compact()
    return table.at()


@query(f"""WITH {_SHIPPED} SELECT 1 AS version, status, count(*) AS n, max(day) AS latest FROM o GROUP BY status UNION ALL SELECT v, status, count(*), max(day) FROM current, (VALUES (2), (3)) x(v) GROUP BY v, status
UNION ALL SELECT 4, status, count(*), max(day) FROM current WHERE day >= '2000-01-01' GROUP BY status""")
def versioned_history(t):
    """Every version of the same table, each read as it was then: before the second merge, after it, compacted, and without old rows."""
    table = _shipped(t)
    table.compact()
    table.compact(keep="day >= '2000-01-01'")
    each = [table.at(v).groupBy("status").agg(F.count("*").alias("n"), F.max("day").alias("latest")).select(F.lit(v).alias("version"), "status", "n", "latest") for v in table.versions()]
    return reduce(DataFrame.union, each)


@query()
def similar_parts(t):
    """Part names as someone might misspell them, each with the most similar of all parts' names."""
    parts = t("part").where("p_name is not null and p_partkey is not null")
    k = 2 + F.pmod(F.col("p_partkey"), F.lit(5)).cast("int")
    wrong = F.concat(F.substring("p_name", 1, 3), F.col("p_name").substr(k + 3, F.length("p_name")), F.lit(" "), F.element_at(F.split("p_name", " "), 1))
    return best_names(parts.select(wrong.alias("name")), parts.select(F.col("p_name").alias("model")), 0.6).select("name", "model", F.round("similarity", 6).alias("similarity"))
