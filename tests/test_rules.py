"""Decision rules case by case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from lotwise.operators import references as R
from lotwise.operators import sets as S
from lotwise.operators import tables as B

RUN = "run string, listings_found int, processed int, search_errors int, gallery_errors int, image_download_errors int, rollback_recommended boolean, review_rate double"


def test_health(spark):
    runs = [("bad", 10, 10, 4, 3, 0, False, 9.0), ("good", 10, 10, 3, 2, 1, False, 9.0), ("images", 10, 10, 0, 0, 2, None, None), ("drift", 0, 0, 0, 0, 0, True, None), ("none", None, None, None, None, None, None, None)]
    results = [("bad", k < 8) for k in range(10)] + [("good", k < 6) for k in range(10)] + [("images", None)]
    found = B.health(spark.createDataFrame(runs, RUN), spark.createDataFrame(results, "run string, needs_review boolean"))
    got = {r["run"]: r for r in found.collect()}
    assert got["bad"]["reasons"] == ["search_errors", "gallery_error_rate", "review_rate"] and not got["bad"]["healthy"]
    assert (got["bad"]["gallery_error_rate"], got["bad"]["review_rate"], got["bad"]["search_errors"]) == (0.3, 0.8, 4)
    assert got["good"]["healthy"] and got["images"]["reasons"] == ["image_error_rate"] and got["drift"]["reasons"] == ["model_drift"] and got["none"]["healthy"]
    assert B.health(spark.createDataFrame([], RUN), spark.createDataFrame(results, "run string, needs_review boolean")).count() == 0


@pytest.mark.parametrize("mode,has_model,bucket,want", [("auto", False, 0.0, "fallback"), ("trained", True, 0.9, "trained"), ("trained", False, 0.0, "fallback"), ("fallback", True, 0.0, "fallback"), ("auto", True, 0.09, "trained"), ("auto", True, 0.1, "fallback")])
def test_backend(spark, mode, has_model, bucket, want):
    row = spark.range(1).select(B.backend(F.lit(bucket), 0.1, mode, has_model), B.backend(F.lit(bucket), 0.1, F.lit(mode), F.lit(has_model))).first()
    assert tuple(row) == (want, want)


def test_training(spark):
    now = dt.datetime(2026, 8, 4)
    rows = [(1, True, 210, 100, None, 0), (2, True, 140, 100, None, 0), (3, False, 300, None, now - dt.timedelta(days=6, hours=23), 3), (4, True, 300, 100, now - dt.timedelta(days=7), 2), (5, True, 200, 150, None, None)]
    df = spark.createDataFrame(rows, "id int, enabled boolean, total int, before int, last timestamp_ntz, failures int")
    why = S.training_blockers(*(F.col(c) for c in ("enabled", "total", "before", "last")), F.lit(now).cast("timestamp_ntz"), F.col("failures"))
    got = {r[0]: r[1] for r in df.select("id", why).collect()}
    assert got == {1: [], 2: ["insufficient_total_labels", "insufficient_new_labels"], 3: ["disabled", "training_cooldown", "failure_limit"], 4: [], 5: []}


def test_discovery(spark):
    rows = [
        (1, "ASUS P8P67 EVO", "ASUS P8P67 EVO motherboard", "https://www.asus.com/p8p67-evo", "https://www.asus.com/p8p67-evo.jpg"),
        (2, "ASUS P8P67 EVO", "ASUS Z690 motherboard", "https://www.asus.com/z690", "https://www.asus.com/z690.jpg"),
        (3, "ASUS P8P67 EVO", "ASUS P8P67 EVO", "https://spam.example/p8p67", "https://spam.example/p8p67.jpg"),
        (4, "ASUS P8P67 EVO", "ASUS P8P67 EVO", "https://www.ebay.com/itm/1", "HTTPS://i.ebayimg.com/p8p67-evo.jpg"),
        (5, "ASUS P8P67 EVO", "again", "https://rog.asus.com/p8p67-evo", "https://www.asus.com/p8p67-evo.jpg"),
        (6, "ASUS P8P67 EVO", "ASUS P8P67 EVO", "https://asus.com/p8p67", "ftp://asus.com/p8p67-evo.jpg"),
        (7, "", "x", "https://asus.com/a", "https://asus.com/b.jpg"), (8, "ASUS", None, None, "https://asus.com/b.jpg"), (9, "ASUS", "x", "https://asus.com", ""),
    ]
    df = spark.createDataFrame(rows, "id int, model string, title string, page_url string, image_url string")
    got = {r["id"]: r for r in R.discovery(df, {"manufacturer": ("asus.com",), "review_site": ("anandtech.com",)}, ("ebay.com",), ("manufacturer", "review_site")).collect()}
    assert [got[k]["rejection"] for k in range(1, 10)] == [None, "insufficient_model_evidence", "unapproved_domain", None, "duplicate_image_url", "unsupported_image_url", *["missing_required_fields"] * 3]
    assert (got[1]["source_type"], got[4]["source_type"], got[3]["source_type"]) == ("manufacturer", "ebay", None) and not got[1]["by_hand"] and got[4]["by_hand"]
