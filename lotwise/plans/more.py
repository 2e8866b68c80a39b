"""More queries, registered beside those of `queries`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import evidence as E
from ..operators import sets as S
from .queries import DET, STATE, VALUE, detections, query, states, values

SOCKET = ("visible_cpu", "empty_socket", "socket_cover")
_SOCKET = "('visible_cpu', 'empty_socket', 'socket_cover')"


@query(f"WITH {DET} SELECT item_id, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, label DESC) AS n FROM det WHERE label IN {_SOCKET}) WHERE n = 1")
def best_label_of_set(t):
    return S.best_of(detections(t), "item_id", SOCKET).withColumn("score", F.round("score", 6))


@query(f"WITH {DET} SELECT item_id, {', '.join(f'''round(coalesce(max(CASE WHEN label = '{x}' THEN score END), 0), 6) AS {n}''' for n, x in (('inst', 'visible_cpu'), ('empty', 'empty_socket'), ('cover', 'socket_cover'), ('cooler', 'cooler')))} FROM det GROUP BY item_id")
def verdict_maxima(t):
    names = {"inst": "visible_cpu", "empty": "empty_socket", "cover": "socket_cover", "cooler": "cooler"}
    return S.maxima_wide(detections(t), "item_id", names).select("item_id", *(F.round(n, 6).alias(n) for n in names))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY pos) AS event_types FROM (SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY ALL) GROUP BY user_id")
def ordered_distinct(t):
    return S.ordered_distinct(t("events"), "user_id", "event_type", "event_id").select("user_id", F.concat_ws(",", "values").alias("event_types"))


@query(f"WITH {DET} SELECT item_id, bool_and(label IN {_SOCKET}) AS socket_only FROM det GROUP BY item_id")
def subset_test(t):
    return detections(t).groupBy("item_id").agg(F.collect_set("label").alias("labels")).select("item_id", S.is_subset(F.col("labels"), SOCKET).alias("socket_only"))


@query("SELECT o_orderkey, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_or_fail(t):
    orders = t("orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    return S.looked_up(orders, t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id", "name").select("o_orderkey", "name")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_extendedprice * l_tax - l_extendedprice * l_discount, 6) AS total FROM lineitem")
def map_sum(t):
    price = F.col("l_extendedprice")
    parts = F.create_map(F.lit("price"), price, F.lit("tax"), price * F.col("l_tax"), F.lit("discount"), -price * F.col("l_discount"))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(S.map_total(parts), 6).alias("total"))


@query(f"WITH {DET} SELECT image_index, count(*) FILTER (WHERE n > 0) AS annotated, count(*) AS items FROM (SELECT item_id, image_index, count(*) FILTER (WHERE score >= 0.5) AS n FROM det GROUP BY ALL) GROUP BY image_index")
def annotated_count(t):
    own = detections(t).groupBy("item_id", "image_index").agg(F.count_if(F.col("score") >= 0.5).alias("n"))
    return own.groupBy("image_index").agg(F.count_if(F.col("n") > 0).alias("annotated"), F.count("*").alias("items"))


@query(f"WITH {STATE} SELECT cpu_state, count(*) AS n, round(avg(cpu_confidence), 6) AS confidence FROM state GROUP BY cpu_state")
def state_summary(t):
    return states(t).groupBy("cpu_state").agg(F.count("*").alias("n"), F.round(F.avg("cpu_confidence"), 6).alias("confidence"))


@query(f"WITH {VALUE} SELECT r.item_id, s.cpu_state, r.recommendation FROM rec r JOIN state s USING (item_id)")
def inner_results(t):
    return values(t).select("item_id", "recommendation").join(states(t).select("item_id", "cpu_state"), "item_id")


@query(f"WITH {DET}, i AS (SELECT DISTINCT item_id FROM det), n AS (SELECT item_id, label AS name, count(*) AS n FROM det GROUP BY ALL) SELECT item_id, name, CASE WHEN n IS NULL THEN 'MISSING' WHEN name = 'cooler' THEN concat('PASS (', n, ')') ELSE 'PASS' END AS status FROM (SELECT item_id, unnest(['visible_cpu', 'cooler', 'bent_pins']) AS name FROM i) LEFT JOIN n USING (item_id, name)")
def layout_status(t):
    return S.layout_status(detections(t), ("visible_cpu", "cooler", "bent_pins"), counted=("cooler",))


@query(f"WITH {DET} SELECT a.pos, printf('%.1fpx', sqrt(power((a.x1 + a.x2 - b.x1 - b.x2) / 2, 2) + power((a.y1 + a.y2 - b.y1 - b.y2) / 2, 2)) + 1e-7) AS shift FROM det a JOIN det b ON a.pos + 1 = b.pos")
def socket_offsets(t):
    """How far apart an expected and an observed polygon lie."""
    own = detections(t).select("pos", G.centroid(G.corners(E.box())).alias("c"))
    pairs = own.join(own.select((F.col("pos") - 1).alias("pos"), F.col("c").alias("o")), "pos")
    return pairs.select("pos", F.format_string("%.1fpx", G.distance(F.col("c"), F.col("o")) + 1e-7).alias("shift"))


_QUAD = "q AS (SELECT pos, x1, y1, x2, y2, x2 - pos % 3 * 5 AS tx, y1 + pos % 5 AS ty FROM det), r AS (SELECT *, x2 - tx AS inset, y1 + (ty - y1) / (tx - x1) * (x2 - x1) AS iy FROM q)"


@query(f"WITH {DET}, {_QUAD}, k AS (SELECT *, CASE WHEN inset <= (x2 - x1) * 0.04::double THEN 0 WHEN iy < -7.5 OR iy > 157.5 OR x2 > 150 THEN 1 ELSE 2 END AS k FROM r) SELECT pos, cast(round(greatest(x2 - x1, sqrt((tx - x1) ** 2 + (ty - y1) ** 2))) AS int) AS width, cast(round(greatest(y2 - y1, sqrt((tx - x2) ** 2 + (ty - y2) ** 2))) AS int) AS height, ['top_right_not_materially_inset', 'inferred_corner_outside_image', 'extended_straight_top_edge_to_right_pcb_edge'][k + 1] AS reason, CASE WHEN k = 2 THEN x2 ELSE tx END AS x, round(CASE WHEN k = 2 THEN iy ELSE ty END, 6) AS y FROM k")
def quad_repair(t):
    """Sizes of four-cornered outlines, and their top right corner moved where it was taken too far left."""
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    c = F.col
    quad = F.array(point(c("x2"), c("y2")), point(c("x2") - c("pos") % 3 * 5, c("y1") + c("pos") % 5), point(c("x1"), c("y1")), point(c("x1"), c("y2")))
    rows = detections(t).select("pos", S.quad_size(quad).alias("s"), S.repaired_top_right(quad, F.lit(150.0), F.lit(150.0)).alias("r"))
    return rows.select("pos", "s.width", "s.height", "r.reason", "r.x", F.round("r.y", 6).alias("y"))


@query(f"WITH {DET} SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(list(label), lambda x: x NOT IN {_SOCKET}))), ',') AS rest, bool_or(regexp_matches(label, 'cover|pins$')) AS matched FROM det GROUP BY item_id")
def label_differences(t):
    """Labels of an item beyond those of a socket, and whether any has a given text."""
    d = detections(t)
    sets = d.groupBy("item_id").agg(F.collect_set("label").alias("labels"))
    return sets.select("item_id", F.concat_ws(",", S.difference(F.col("labels"), SOCKET)).alias("rest")).join(S.any_match(d, "item_id", "label", "cover|pins$"), "item_id")


@query(f"WITH {DET} SELECT pos, x1 AS left_x, y1 AS top_y, x2 AS right_x, y2 AS bottom_y FROM det")
def corner_order(t):
    shuffled = F.array(*(F.array(F.col(x), F.col(y)) for x, y in (("x2", "y2"), ("x1", "y1"), ("x1", "y2"), ("x2", "y1"))))
    c = detections(t).select("pos", S.ordered_corners(shuffled).alias("c"))
    return c.select("pos", F.col("c")[0][0].alias("left_x"), F.col("c")[1][1].alias("top_y"), F.col("c")[2][0].alias("right_x"), F.col("c")[3][1].alias("bottom_y"))


_FIRST = "SELECT item_id, row_number() OVER (PARTITION BY item_id, label ORDER BY pos) AS k, label, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM det WHERE label = "


@query(f"WITH {DET} SELECT a.item_id, a.k, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM ({_FIRST}'visible_cpu') a JOIN ({_FIRST}'empty_socket') b USING (item_id, k)")
def positional_compare(t):
    k = F.row_number().over(Window.partitionBy("item_id", "label").orderBy("pos")).alias("k")
    at = detections(t).select("item_id", "label", k, ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return S.positional_distances(at.where("label = 'visible_cpu'"), at.where("label = 'empty_socket'"), ["item_id", "k"]).withColumn("distance", F.round("distance", 6))


@query("""WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS before, max(ts) FILTER (WHERE event_type = 'signup') AS trained, count(*) FILTER (WHERE event_type = 'error' AND value > 60) AS errors FROM events GROUP BY user_id)
SELECT user_id, concat_ws(',', CASE WHEN user_id % 17 = 0 THEN 'disabled' END, CASE WHEN n < 100 THEN 'insufficient_total_labels' END, CASE WHEN n - before < 50 THEN 'insufficient_new_labels' END, CASE WHEN TIMESTAMP '2024-02-01' < trained + INTERVAL 7 DAY THEN 'training_cooldown' END, CASE WHEN errors >= 3 THEN 'failure_limit' END) AS reasons FROM u""")
def train_eligibility(t):
    """Whether a model of each user may be trained: events are labels, the last signup is the last training, great errors are failed ones."""
    v, at = F.col("value"), F.col("ts")
    own = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(at < F.expr("timestamp_ntz'2024-01-15'")).alias("before"), F.max(F.when(F.col("event_type") == "signup", at)).alias("trained"), F.count_if((F.col("event_type") == "error") & (v > 60)).alias("errors"))
    why = S.training_blockers(F.col("user_id") % 17 != 0, F.col("n"), F.col("before"), F.col("trained"), F.expr("timestamp_ntz'2024-02-01'"), F.col("errors"), 100, 50)
    return own.select("user_id", F.concat_ws(",", why).alias("reasons"))
