"""Exact places against a sort of all rows."""

import random

import pytest
from pyspark.sql import functions as F
from lotwise.operators import ranking, tables


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_places_equal_a_sort(spark, parts):
    rng = random.Random(parts)
    rows = [(k, rng.choice([None, *range(6)]), rng.choice(["a", "b", None]), "x") for k in range(800)]
    df = spark.createDataFrame(rows, "id int, score int, name string, place string").repartition(5)
    got = {r["id"]: r["at"] for r in ranking.placed(df, [F.desc_nulls_last("score"), F.asc_nulls_first("name"), F.col("id") % 7, F.desc("id")], "at", parts).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is not None, r[2] or "", r[0] % 7, -r[0]))
    assert [got[r[0]] for r in want] == [*range(1, 801)]


def test_a_value_that_most_rows_share(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("v"))
    made = ranking.placed(df, [F.col("v"), F.col("id")], parts=8)
    assert [r["place"] for r in made.orderBy("v", "id").collect()] == [*range(1, 3001)]


def test_empty_and_other_columns(spark):
    none = spark.createDataFrame([], "id int, _part string, place int")
    assert ranking.placed(none, [F.col("id")], "at").count() == 0
    one = ranking.placed(spark.createDataFrame([(5, "kept")], "id int, name string"), [F.col("id")]).first()
    assert (one["place"], one["name"]) == (1, "kept")


def test_split_sizes(spark):
    df = spark.range(1003).select(F.col("id").alias("k"))
    one, two = ({r["k"]: r["split"] for r in tables.seeded_split(x, "k", 4).collect()} for x in (df, df.repartition(9)))
    assert one == two and sorted(map([*one.values()].count, ("train", "val", "test"))) == [150, 151, 702]
