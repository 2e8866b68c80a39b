"""What a reviewer found: odd inputs of queries whose SQL twin said otherwise."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from lotwise.functions import text as X
from lotwise.operators import oriented as O
from lotwise.operators import references as R
from lotwise.plans import queries as Q


def test_models_with_widening_letters(spark):
    """A sharp s or a ligature is no pair of A-Z: 'ß1a' has the one token 1A, and 'Chß' and 'Ch' are one model."""
    page, image = "http://example.com/x1a", "https://img/1"
    rows = [(1, "Üß.", "Üß.", page, image), (2, "Chß", "chb", page + "/ch", image), (3, "Ch", "chb", page + "/ch", image), (4, "ﬁx1a", "x", page, image)]
    df = spark.createDataFrame(rows, "id int, model string, title string, page_url string, image_url string")
    got = {r["id"]: (r["ratio"], r["rejection"]) for r in R.discovery(df, {"official": ("example.com",)}).collect()}
    assert got == {1: (0.0, "insufficient_model_evidence"), 2: (1.0, None), 3: (1.0, "duplicate_image_url"), 4: (1.0, None)}


def _both(spark, tmp_path, name, **tables):
    """Rows of a query over tables, and of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = Q.QUERIES[name](spark, str(tmp_path))
    answer = con.execute(Q.SQL[name])
    at = [[d[0] for d in answer.description].index(c) for c in df.columns]
    return sorted(tuple(map(str, r)) for r in df.collect()), sorted(tuple(str(r[i]) for i in at) for r in answer.fetchall())


def test_cards_of_broken_headings(spark, tmp_path):
    """A heading that was cut within an entity stays as it is shown."""
    heads = ["Haan&amp;&amp", "a&lt;b &gt", "x & y;", "&amp;lt; q&quot;", "plain"]
    pages = spark.createDataFrame([(k, f"<p>a</p><h1>{h}</h1>") for k, h in enumerate(heads)], "page_id long, html string")
    got, want = _both(spark, tmp_path, "listing_cards", pages=pages)
    assert got == want and len(got) == 2 * len(heads)


@pytest.mark.parametrize("name", ["report_cells", "ranked_values", "value_estimate"])
def test_bids_on_half_a_cent(spark, tmp_path, name):
    """Prices whose thousandth ends in a five are rounded as doubles, which is how the twins round."""
    prices = [1005.0, 77195.0, 64035.0, 1015.0, 77190.0, 2675.0]
    orders = spark.createDataFrame([(k, k, "F", p, dt.datetime(2024, 1, 1), "1") for k, p in enumerate(prices)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    events = spark.range(12 * len(prices)).select(F.col("id").alias("event_id"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.lit(90.0).alias("value"), F.lit('{"k": 8}').alias("props"))
    got, want = _both(spark, tmp_path, name, orders=orders, events=events)
    assert got == want and len(got) == len(prices)


def test_tokens_are_whole_words(spark):
    rows = [("the 555, le", 0.6), ("theand (LE) 5555", 0.2), ("", 0.0), (None, 0.0), ("x-the_and.der\n555 le", 1.0), ("THE the the", 0.2)]
    df = spark.createDataFrame(rows, "text string, want double").withColumn("got", X.token_overlap(F.lit("the and le der 555 board a"), F.col("text")))
    assert [(r["text"], r["got"]) for r in df.collect()] == rows


def test_images_of_forty_polygons_go_together(spark):
    """Images that are whole in a batch are gone through at once, and only polygons whose boxes leave it open are cut."""
    r = np.random.default_rng(3)
    rows = [(k // 40, k, *map(float, (x + h, y, x + w + h, y, x + w, y + h, x, y + h))) for k, (x, y, w, h) in enumerate(r.integers(5, 60, (2000, 4)).tolist())]
    d = spark.createDataFrame(rows, "image int, pos int, " + ", ".join(f"{a}{b} double" for a in "abcd" for b in "xy"))
    clash = O.Clash(tuple(f"{a}{b}" for a in "abcd" for b in "xy"), "polygon", 0.3)
    got = {x["pos"] for x in O.suppressed(d.coalesce(1), ["image"], [F.col("pos")], clash).collect()}
    kept = set()
    for image in range(50):
        mine = []
        for k in range(image * 40, image * 40 + 40):
            p = np.array(rows[k][2:]).reshape(1, 4, 2)
            if not any(O.polygon_share(p, np.array(rows[m][2:]).reshape(1, 4, 2))[0] > 0.3 for m in mine):
                mine.append(k)
        kept |= set(mine)
    assert got == kept
    assert O.SMALL >= 40
    square = np.array([[[0, 0], [4, 0], [4, 4], [0, 4]]], float)
    assert O._clipped(square, square[:, 0] + 1, square[:, 1] + 1).shape[1] <= 5


def test_rank_of_stacked_systems():
    r = np.random.default_rng(2)
    a = r.normal(size=(60, 8, 8))
    a[::3, 7] = a[::3, 6]
    a[1::9] *= 1e-9
    a[2::9, 0] = a[2::9, 1] * (1 + 1e-15)
    assert (R._full_rank(a) == (np.linalg.matrix_rank(a) == 8)).all() and 0 < R._full_rank(a).sum() < 60
    assert len(R._full_rank(a[:0])) == 0
