"""Scenarios on small tables."""

import datetime as dt
import difflib
import hashlib
import json
import math
import random
import re
import statistics

import pytest
from hypothesis import HealthCheck, given
from hypothesis import settings as _settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotwise.functions import text as X
from lotwise.operators import boards, evidence as E
from lotwise.operators import oriented as O
from lotwise.operators import references as R
from lotwise.operators import registry as N
from lotwise.operators import report as P
from lotwise.operators import tables as B
from lotwise.operators import value as V
from lotwise.sources import documents as D
from lotwise.streaming import incremental as I

settings = lambda **k: _settings(suppress_health_check=[HealthCheck.function_scoped_fixture], **k)
DET = "item_id string, pos long, label string, score double, image_index int, x1 double, y1 double, x2 double, y2 double"


def box(pos, label, score, image, x1=10.0, y1=10.0, x2=210.0, y2=210.0):
    return ("a", pos, label, score, image, x1, y1, x2, y2)


def suppress(d, same):
    """Suppression among boxes of one label, or among all with a bound of ten."""
    if not same:
        return boards.distinct_boxes(d, most=10)
    return O.suppressed(d, ["item_id", "image_index", "label"], [F.desc("score"), F.col("pos")], O.Clash(("x1", "y1", "x2", "y2"), overlap=0.45, at_least=True))


def test_suppression_keeps_other_labels(spark):
    d = spark.createDataFrame([box(0, "ram", 0.9, 1, 0.0, 0.0, 100.0, 100.0), box(1, "ram", 0.8, 1, 5.0, 5.0, 95.0, 95.0), box(2, "nvme", 0.7, 1, 5.0, 5.0, 95.0, 95.0)], DET)
    assert sorted(r["pos"] for r in suppress(d, True).collect()) == [0, 2]


def test_money(spark):
    df = spark.createDataFrame([("Current Price $42.50 Shipping: $18.00",), ("$1,234.00",), ("",), (None,)], "card string")
    got = df.select(X.money(F.col("card")), X.shipping(F.col("card"))).collect()
    assert [tuple(r) for r in got] == [(42.5, 18.0), (1.0, 18.0), (0.0, 18.0), (0.0, 18.0)]


VALUE = "title string, current_bid double, shipping double, cpu_state string, cpu_confidence double, needs_review boolean, review_reasons array<string>, damage_score double, maxima map<string,double>"


def test_value_recommendation(spark):
    rows = [
        ("Z390 board", 20.0, 15.0, "cooler_attached_cpu_highly_likely", 0.9, False, [], 0.0, {}),
        ("board", 20.0, 15.0, "visible_cpu_likely", 0.9, False, [], 0.5, {}),
        ("board", 20.0, 15.0, "unclear", 0.4, True, ["socket_state_unclear", "detector_disagreement"], None, None),
        ("board", 20.0, 15.0, "visible_cpu_likely", None, True, ["b", "a", "b"], 0.0, {"ram": 0.4, "nvme_ssd": 0.38, "nvme": 0.1, "visible_cpu": 0.98}),
        ("board", 0.0, 0.0, "empty_socket_likely", 0.9, False, None, None, {"ram_dimm": 0.1, "ram": 0.9}),
    ]
    a, b, c, d, e = V.estimate(spark.createDataFrame(rows, VALUE)).collect()
    assert a["recommendation"] == "bid" and a["max_bid"] > 20 and a["gross"] == 165 and a["breakdown"]["premium_chipset"] == 35
    assert b["recommendation"] != "bid" and b["risk"] == 80 and b["reasons"] == ["cpu_visible"]
    assert c["recommendation"] == "review" and c["risk"] == 45 and c["net"] == 0 and c["confidence"] == pytest.approx(0.3)
    assert set(d["breakdown"]) == {"motherboard", "cpu", "ram", "nvme"} and d["confidence"] == pytest.approx(0.98 * 0.75) and d["reasons"] == ["cpu_visible", "a", "b"]
    assert e["roi"] is None and list(e["breakdown"]) == ["motherboard"]


def test_shipping_is_the_first_amount_after_its_word(spark):
    df = spark.createDataFrame([("Ship: 12",), ("shipping is free, price $500",), ("Shipping $7.5",), ("ship  : $ 9.25",)], "card string")
    assert [r[0] for r in df.select(X.shipping(F.col("card"))).collect()] == [12.0, 18.0, 7.5, 9.25]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30000)), min_size=1, max_size=60))
def test_price_ranges_as_sorted_lists(spark, rows):
    got = {r["model"]: tuple(r)[1:] for r in V.price_ranges(spark.createDataFrame([(m, c / 100) for m, c in rows], "model string, realized double")).collect()}
    want = {}
    for m in {m for m, _ in rows}:
        v = sorted(c / 100 for k, c in rows if k == m)
        if len(v) >= 3:
            want[m] = (len(v), statistics.median(v), v[max(0, int(len(v) * 0.2) - 1)], v[min(len(v) - 1, int(len(v) * 0.8))])
    assert got == {m: pytest.approx(w) for m, w in want.items()}


def test_prices(spark):
    df = spark.createDataFrame([("m", float(x)) for x in (80, 90, 100, 110, 120)] + [("few", 1.0)], "model string, realized double")
    got = V.price_ranges(df).collect()
    assert [tuple(r) for r in got] == [("m", 5, 100.0, 80.0, 120.0)]


def test_retention_is_inclusive(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 7, 28),), (dt.datetime(2026, 7, 27, 23, 59, 59),)], "at timestamp_ntz")
    assert B.retained(df, "at", "2026-08-04 00:00:00", 7).count() == 1


def test_shards_are_complete_and_disjoint(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("id"))
    assert sum(r["items"] for r in B.shard_sizes(df, "id", 4).collect()) == 20


def test_union_refuses_duplicates(spark):
    one = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(Exception, match="duplicate key"):
        B.checked_union([one, one], "id").collect()


def test_last_wins_and_reconcile(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "k string, pos int, v string")
    assert B.last_wins(df, "k", "pos").first()["v"] == "y"
    base = spark.createDataFrame([("a", "unclear", 0.2, 10, ["socket_state_unclear"], True)], "k string, cpu_state string, cpu_confidence double, value_score int, review_reasons array<string>, needs_review boolean")
    ok = spark.createDataFrame([("a", "empty", 0.9, 50, False, 0.9)], "k string, f_state string, f_confidence double, f_score int, f_review boolean, identity double")
    assert tuple(B.reconciled(base, ok, "k").first()) == ("a", "empty", 0.9, 60, ["full_image_overridden_by_reference_socket_region"], False, True)
    weak = B.reconciled(base, ok.withColumn("identity", F.lit(0.4)), "k").first()
    assert not weak["overridden"] and weak["needs_review"] and weak["review_reasons"][-1] == "focused_socket_detection_inconclusive"
    assert tuple(B.reconciled(base, ok.where("k = 'x'"), "k").first())[1:4] == ("unclear", 0.2, 10)


def test_merge_modes(spark):
    ddl = "k string, cpu_state string, value_score int, review_reasons array<string>"
    old = spark.createDataFrame([("a", "x", 1, []), ("b", "x", 1, ["r"])], ddl)
    new = spark.createDataFrame([("b", "y", 2, []), ("c", "y", 2, [])], ddl)
    got = {r["k"]: r for r in B.merged(old, new, "k").collect()}
    assert got["a"]["review_reasons"] == ["phase2_missing"] and got["a"]["needs_review"] and got["b"]["review_reasons"] == ["detector_disagreement"] and got["b"]["legacy_state"] == "x"
    assert got["c"]["detector_source"] == "phase2_only_available" and not got["c"]["needs_review"]
    assert [r["cpu_state"] for r in B.merged(old, new.where("k = 'b'"), "k", "off").orderBy("k").collect()] == ["x", "x"]
    for mode in ("off", "only"):
        with pytest.raises(Exception, match="no (legacy|spatial) result"):
            B.merged(old, new, "k", mode).collect()
    with pytest.raises(ValueError):
        B.merged(old, new, "k", "both")


def test_canonical_models_and_names(spark):
    df = spark.createDataFrame([("Gigabyte Z370 AORUS Gaming 5 motherboard",), ("MSI B450 Tomahawk Max",), ("nothing",)], "t string")
    assert [r[0] for r in df.select(X.canonical_model(F.col("t"))).collect()] == ["GIGABYTE Z370 AORUS GAMING 5", "MSI B450 TOMAHAWK MAX", None]
    best = R.best_names(df.select(F.col("t").alias("name")), spark.createDataFrame([("MSI B450 TOMAHAWK",), ("MSI Z390-A",)], "model string")).collect()
    assert [(r["model"], r["similarity"]) for r in best if r["name"].startswith("MSI")] == [("MSI B450 TOMAHAWK", 0.92)]


def plain(text):
    return re.sub(r"\s+", " ", re.sub(r"[^A-Z0-9+ -]", " ", text.upper())).strip()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="AB4zé -+.", max_size=12), min_size=1, max_size=12), st.lists(st.text(alphabet="AB4z -", min_size=1, max_size=10), min_size=1, max_size=8))
def test_best_names_by_brute_force(spark, names, models):
    ratio = lambda a, b: max(difflib.SequenceMatcher(None, a, b).ratio(), 0.92 if a in b or b in a else 0)
    got = {r["name"]: (r["model"], r["similarity"]) for r in R.best_names(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in models], "model string"), 0.6).collect()}
    for name in set(names):
        best = max(((ratio(plain(name), plain(m)), -k, m) for k, m in enumerate(sorted(set(models)))))
        assert got.get(name) == ((best[2], best[0]) if best[0] >= 0.6 else None)


def test_identification_from_text(spark):
    catalog = spark.createDataFrame([("ASROCK X570 STEEL LEGEND",), ("MSI B450 TOMAHAWK MAX",), ("ASUS PRIME Z390-A",)], "model string")
    texts = [(1, "MSI B450 Tomahawk Max board, tested", "MSI B450 TOMAHAWK MAX"), (2, "MSI B450 Tomahawk Max board", "ASROCK X570 STEEL LEGEND rev 1"), (3, "GIGABYTE GA-H61M-S2 old board", ""), (4, "AORUS GAMING", "x"), (5, "plain", "MSI B450 TOMAHAWK MAX"), (6, "MSI B450 TOMAHAWK MAX", "")]
    df = spark.createDataFrame(texts, "item_id int, title string, seen string")
    items = df.select("item_id", X.board_candidates(F.col("title"), F.col("title")).alias("listing"), X.candidates(F.col("seen"), X.BOARD_PATTERNS).alias("visual"))
    assert items.where("item_id = 1").first()["listing"][0] == "MSI B450 TOMAHAWK MAX"
    got = {r["item_id"]: r for r in boards.resolved_identification(R.identified(items, catalog)).collect()}
    assert [got[k]["source"] for k in (1, 2, 3, 5, 6)] == ["listing_confirmed", "listing_conflict", "listing_uncatalogued", "visually_identified", "listing_probable"]
    assert got[1]["text"] == "MSI B450 TOMAHAWK MAX" and got[2]["conflict"] and got[3]["text"] == "GIGABYTE GA-H61M-S2" and got[4]["source"] is None


def overlap(a, b):
    w, h = (max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return w * h / (area(a) + area(b) - w * h)


@pytest.mark.parametrize("same", [True, False])
def test_suppression_by_brute_force(spark, same):
    r = random.Random(6)
    rows = []
    for k in range(80):
        x, y = r.randint(0, 60), r.randint(0, 60)
        rows.append(("a", k, r.choice(["p", "q"]), r.choice([0.3, 0.5, 0.7, r.random()]), k % 2, float(x), float(y), float(x + r.randint(10, 60)), float(y + r.randint(10, 60))))
    kept = {0: [], 1: []}
    for d in sorted(rows, key=lambda d: (-d[3], d[1])):
        if not any(overlap(k[5:], d[5:]) >= 0.45 and (k[2] == d[2] or not same) for k in kept[d[4]]):
            kept[d[4]].append(d)
    df = spark.createDataFrame(rows, DET)
    got = {x["pos"] for x in suppress(df, same).collect()}
    assert got == {d[1] for k in kept.values() for d in (k if same else k[:10])}


def test_homography_maps_its_points(spark):
    r = random.Random(1)
    quads = [(k, *([[x + r.uniform(-9, 9), y + r.uniform(-9, 9)] for x, y in ((0, 0), (90, 0), (90, 70), (0, 70))] for _ in range(2))) for k in range(30)]
    for row in R.homographies(spark.createDataFrame(quads, "id int, source array<array<double>>, target array<array<double>>")).collect():
        _, source, target = quads[row["id"]]
        for (x, y), (u, v) in zip(source, target, strict=True):
            h = row["h"]
            w = h[6] * x + h[7] * y + h[8]
            assert ((h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w) == pytest.approx((u, v))


def test_registry_guards(spark):
    models = spark.createDataFrame([("a", True), ("b", False)], "name string, promotable boolean")
    assert {r["name"]: r["active"] for r in N.promoted(models, "a").collect()} == {"a": True, "b": False}
    for name, why in (("b", "did not pass"), ("c", "not registered")):
        with pytest.raises(Exception, match=why):
            N.promoted(models, name).collect()
    with pytest.raises(Exception, match="no name c"):
        N.find_by_name(models, "c").collect()
    images = spark.createDataFrame([("i", [])], "image_id string, annotations array<struct<label: string, x1: double, y1: double, x2: double, y2: double, confidence: double>>").withColumn("status", F.lit("unlabeled"))
    boxes = spark.createDataFrame([("i", 0, "l", 5.0, 5.0, 5.0, 9.0, None)], "image_id string, pos int, label string, x1 double, y1 double, x2 double, y2 double, confidence double")
    with pytest.raises(Exception, match="positive area"):
        N.with_boxes(images, boxes).collect()
    refs = spark.createDataFrame([], "id string, model string, model_key string, source_type string, source string, trust double, approved boolean, revision string")
    new = spark.createDataFrame([("M", "ebay", "s", False, None)], "model string, source_type string, source string, approved boolean, revision string")
    with pytest.raises(Exception, match="require approval"):
        N.with_references(refs, new, spark.createDataFrame([("ebay", 0.5, True)], "source_type string, trust double, manual boolean")).collect()


def test_report_page(spark, tmp_path):
    rows = [("1", 0, "<Z390> & board", 20.0, 15.0, "cooler_attached_cpu_highly_likely", 0.9, False, [], 0.0, {}), ("2", 1, "board", 1234.5, 15.0, "unclear", 0.4, True, ["socket_state_unclear"], None, None)]
    values = V.estimate(spark.createDataFrame(rows, "item_id string, pos int, " + VALUE))
    run = spark.createDataFrame([(True, ["confidence_drop"], 1, 2, 0, "completed", 2, 2)], "rollback_recommended boolean, rollback_reasons array<string>, search_errors int, gallery_errors int, image_download_errors int, status string, listings_found int, processed int")
    found = P.alerts(values, run)
    assert [(r["type"], r["detail"]) for r in found.orderBy("type").collect()] == [("bid_candidate", None), ("crawler_errors", "3"), ("model_drift", "confidence_drop")]
    assert P.alerts(values, run, drift=False, crawler=False).count() == 1
    lines = P.page_lines(values, found, P.overview(values, run, spark.createDataFrame([(False,)], "healthy boolean")), "2024-01-01")
    P.write_page(lines, str(tmp_path / "page"))
    page = "\n".join(f.read_text() for f in sorted((tmp_path / "page").glob("part-*")))
    assert [r["line"] for r in lines.orderBy("section", "place").collect()] == page.split("\n")[:-1] or page.replace("\n\n", "\n").strip().split("\n") == [r["line"] for r in lines.orderBy("section", "place").collect()]
    assert "&lt;Z390&gt; &amp; board" in page and "$20.00" in page and "socket_state_unclear" in page and "crawler_errors" in page and page.index("Alerts") < page.index("Worth a bid")
    many = found.where("type = 'bid_candidate'").withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(70)))).withColumn("item_id", F.col("_n").cast("string")).drop("_n")
    assert P.page_lines(values, many, P.overview(values, run, spark.createDataFrame([(False,)], "healthy boolean")), "x").where("section = 1 and place > 0").count() == 70


def test_seeded_split(spark):
    rows = spark.range(1003).withColumnRenamed("id", "k")
    a, b = ({r["k"]: r["split"] for r in B.seeded_split(rows.repartition(n), "k", 42).collect()} for n in (1, 5))
    other = {r["k"]: r["split"] for r in B.seeded_split(rows, "k", 43).collect()}
    assert a == b != other and sorted(map([*a.values()].count, ("train", "val", "test"))) == [150, 151, 702]


def test_ledger_versions(spark):
    rows = spark.createDataFrame([("1", "h"), ("2", "h")], "item_id string, listing_hash string")
    ledger = spark.createDataFrame([("1", "v1", "h"), ("2", "v1", None)], "item_id string, detector_version string, listing_hash string")
    assert [r["item_id"] for r in B.pending(rows, ledger, "v1").collect()] == ["2"] and B.pending(rows, ledger, "v2").count() == 2
    files = spark.createDataFrame([("a.py", b"1"), ("b.py", b"2")], "path string, content binary")
    version = lambda f: B.code_version(f).first()[0]
    assert version(files) == version(files.orderBy(F.desc("path"))) != version(files.withColumn("content", F.lit(b"1")))


def test_files(spark, tmp_path):
    for name in ("7_1.jpg", "7_10.jpg", "7_2.jpg", "8_1.jpg", "x.txt"):
        (tmp_path / name).write_bytes(name.encode())
    got = {r["item_id"]: r["images"] for r in D.item_images(spark, str(tmp_path)).collect()}
    assert got == {"7": ["7_1.jpg", "7_10.jpg", "7_2.jpg"], "8": ["8_1.jpg"]}
    listed = {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["bytes"]) for r in D.inventory(spark, str(tmp_path)).collect()}
    assert listed["x.txt"] == (hashlib.sha256(b"x.txt").hexdigest(), 5)
    points = spark.createDataFrame([("r1", 0, 1.0, 2.0, b"ab"), ("r2", 0, 3.0, 4.0, b"cd")], "reference string, point int, x double, y double, descriptor binary")
    D.write_features(points, str(tmp_path / "features"))
    assert [tuple(r) for r in D.read_features(spark, str(tmp_path / "features"), ["r2"]).collect()] == [("r2", 0, 3.0, 4.0, bytearray(b"cd"))]
    D.append_rows(points, str(tmp_path / "log"))
    D.append_rows(points, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    D.write_list(points.select("reference"), str(tmp_path / "list"))
    assert spark.read.json(str(tmp_path / "list")).count() == 2
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "good.json").write_text('[{"id": 1}]')
    (tmp_path / "docs" / "bad.json").write_text("{oops")
    assert [r["path"].rsplit("/", 1)[1] for r in D.unread(spark, str(tmp_path / "docs")).collect()] == ["bad.json"]
    assert D.read_list(spark, str(tmp_path / "docs"), "id int").count() == 1
    assert tuple(D.migrated_ledger(spark.createDataFrame([(1,)], "item_id int")).first()) == (1, "legacy", None)


def test_json_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": 1, "items": [{"id": "1"}, {"id": "2"}]}))
    assert D.read_list(spark, str(tmp_path / "a.json"), "id string", "items", 1).count() == 2
    with pytest.raises(Exception, match="schema version"):
        D.read_list(spark, str(tmp_path / "a.json"), "id string", "items", 2).collect()
    (tmp_path / "b.json").write_text(json.dumps([{"id": "3"}]))
    assert D.read_list(spark, str(tmp_path / "b.json"), "id string", "items", 1).first()["id"] == "3"


def test_streams(spark, tmp_path):
    rows = [(1, "a", 0.5, dt.datetime(2026, 1, 1, 0, 1)), (1, "a", 0.7, dt.datetime(2026, 1, 1, 0, 2)), (2, "b", 0.1, dt.datetime(2026, 1, 1, 3, 0))]
    schema = "id long, label string, score double, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = I.first_seen(read(), ["id"], "ts").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 2
    q = I.windowed_maxima(read(), "ts").writeStream.format("memory").queryName("tops").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["top"] for r in spark.table("tops").collect()) == [0.1, 0.7]
    run = lambda: I.upsert_batches(read(), str(tmp_path / "out"), "id", "ts", str(tmp_path / "cp"), buckets=8).awaitTermination(60)
    table = lambda: {r["id"]: r["score"] for r in I.latest_rows(spark, str(tmp_path / "out")).collect()}
    run()
    assert table() == {1: 0.7, 2: 0.1}
    more = [(2, "b", 0.9, dt.datetime(2026, 1, 2)), (3, "c", 0.3, dt.datetime(2026, 1, 2)), (2, "b", 0.2, dt.datetime(2025, 1, 1))]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert table() == {1: 0.7, 2: 0.9, 3: 0.3}
    # the second batch wrote the buckets of its two keys only
    assert len(list((tmp_path / "out" / "version=1").glob("bucket=*"))) <= 2


def test_ransac_finds_planted_inliers(spark):
    rows = [(g, float(x), float(y), 1.1 * x + 0.2 * y + 5 + (300 * ((x * y) % 3 + 1) if (x + y) % 5 == 0 else 0), 0.9 * y - 0.1 * x + 7) for g in (1, 2) for x in range(0, 60, 7) for y in range(0, 60, 11)]
    rows += [(3, 0.0, 0.0, 1.0, 1.0), (3, 5.0, 0.0, 2.0, 1.0)]
    planted = sum((x + y) % 5 > 0 for x in range(0, 60, 7) for y in range(0, 60, 11))
    got = {r["id"]: r for r in boards.ransac_homographies(spark.createDataFrame(rows, "id long, sx double, sy double, tx double, ty double")).collect()}
    assert [got[g]["inliers"] for g in (1, 2)] == [planted, planted]
    assert all(abs(a - b) < 1e-3 for a, b in zip(got[1]["h"], [1.1, 0.2, 5, -0.1, 0.9, 7, 0, 0, 1]))
    assert got[3]["h"] is None and got[3]["inliers"] == 0


def test_distinct_boxes_ignore_labels(spark):
    rows = [("a", 0, 1, "cpu", 0.9, 0.0, 0.0, 10.0, 10.0), ("a", 0, 2, "fan", 0.8, 0.0, 0.0, 10.0, 9.0), ("a", 0, 3, "fan", 0.7, 50.0, 50.0, 60.0, 60.0), ("a", 1, 4, "fan", 0.7, 0.0, 0.0, 10.0, 10.0)]
    d = spark.createDataFrame(rows, "item_id string, image_index int, pos long, label string, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r["pos"] for r in boards.distinct_boxes(d).collect()) == [1, 3, 4]
    assert sorted(r["pos"] for r in boards.distinct_boxes(d, most=1).collect()) == [1, 4]
