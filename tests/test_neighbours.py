"""Neighbour indexes against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F
from lotwise.operators import neighbours as K
from lotwise.operators import references as R

SCHEMA = "id long, model string, v array<double>, d string, cell string"


def points(seed, n, clusters=6, size=5):
    r = random.Random(seed)
    centres = [[r.uniform(-20, 20) for _ in range(size)] for _ in range(clusters)]
    rows = [(k, "m" if k % 4 else "n", [x + r.gauss(0, 1) for x in centres[k % clusters]], "", "") for k in range(n)]
    return rows + [(n, "m", None, "", ""), (n + 1, "alone", [0.0] * size, "", ""), (n + 2, "m", rows[5][2], "", ""), rows[7]]


def nearest(rows, queries, k, distance):
    out = set()
    for q, m, v in queries:
        near = sorted((distance(v, w), i) for i, n, w in {(i, n, tuple(w)) for i, n, w, *_ in rows if w is not None} if n == m and i != q)
        out |= {(q, i, round(d, 9), n) for n, (d, i) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("k,block,cells", [(2, 2048, 256), (3, 7, 4), (40, 16, 256), (1, 50, 1)])
def test_nearest_is_exact(spark, k, block, cells):
    rows = points(1, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    queries = df.where("id % 20 = 0 or id > 299").select(F.col("id").alias("q"), "model", "v")
    got = {(r["q"], r["id"], round(r["d"], 9), r["n"]) for r in K.nearest(queries, df, k, cells, block).collect()}
    assert got == nearest(rows, [(i, m, v) for i, m, v, *_ in rows if v and (i % 20 == 0 or i > 299)], k, math.dist)


def test_a_query_reads_few_cells(spark):
    """Apart from its own cluster's, cells can't hold anything near."""
    df = spark.createDataFrame([r for r in points(2, 900, clusters=9) if r[2]], SCHEMA)
    index = K.Cells(df, 64)
    queries = df.where("id % 30 = 0 and id < 900").select(F.col("id").alias("q"), "model", "v").withColumn("within", F.lit(4.0))
    read = index.reached(queries, "within", 1).join(index.table.groupBy("model", "cell").count(), ["model", "cell"]).agg(F.sum("count")).first()[0]
    assert read < 0.3 * queries.count() * df.count() / 2


@pytest.mark.parametrize("block", [9, 2048])
def test_agreement_and_partners(spark, block):
    rows = [(k, "m" if k % 4 else "n", [random.Random(k).random(), random.Random(-k).random()], "", "") for k in range(80)] + [(99, "one", [0.0, 0.0], "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = {(i, j) for i, m, v, *_ in rows for j, n, w, *_ in rows if m == n and i != j and math.dist(v, w) <= 0.3}
    others = {i: sum(n == m for _, n, *_ in rows) - 1 for i, m, *_ in rows}
    want = {i: (near := sum(a == i for a, _ in pairs), others[i] - near) for i in others if others[i]}
    assert {x["id"]: (x["agreeing"], x["conflicting"]) for x in K.agreement(df, 0.3, block=block).collect()} == want
    assert {(x["id"], x["partner"]) for x in K.within(df, 0.3, block=block).collect()} == pairs


def descriptors(seed, n):
    r = random.Random(seed)
    base = [[r.getrandbits(64) - (1 << 63) for _ in range(2)] for _ in range(5)]
    rows = []
    for k in range(n):
        v = list(base[k % 5])
        for _ in range(r.choice((0, 1, 3, 9, 20, 40))):
            w = r.randrange(2)
            v[w] = ((v[w] ^ (1 << r.randrange(64))) + (1 << 63)) % (1 << 64) - (1 << 63)
        rows.append((k, "m" if k % 3 else "n", v))
    return [*rows, (n, "m", None), (n + 1, "m", [None, 5]), (n + 2, "alone", [1, 2])]


def bits(v, w):
    return sum(((a ^ b) % (1 << 64)).bit_count() for a, b in zip(v, w, strict=True))


@pytest.mark.parametrize("width,s", [(16, 0), (8, 0), (8, 1)])
def test_hashing_finds_all_within_its_radius(spark, width, s):
    rows = descriptors(3, 120)
    df = spark.createDataFrame(rows, "id long, model string, v array<bigint>").where("id < 120")
    radius = 2 * (64 // width) * (s + 1) - 1
    want = {(i, j, bits(v, w)) for i, m, v in rows[:120] for j, n, w in rows[:120] if m == n and i != j and bits(v, w) <= radius}
    got = [(x["q"], x["id"], x["d"]) for x in K.hamming_within(df.withColumnRenamed("id", "q"), df, 2, width, s).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


@pytest.mark.parametrize("rounds", [1, 2])
def test_nearest_descriptors_are_exact(spark, rounds):
    rows = descriptors(4, 150)
    df = spark.createDataFrame(rows, "id long, model string, v array<bigint>")
    got = {(r["q"], r["id"], r["d"], r["n"]) for r in K.hamming_nearest(df.where("id % 5 = 0").withColumnRenamed("id", "q"), df, 2, 2, 8, rounds).collect()}
    usable = [r for r in rows if r[2] and None not in r[2]]
    assert got == nearest(usable, [r for r in usable if r[0] % 5 == 0], 2, bits)


def test_no_rows(spark):
    df = spark.createDataFrame(points(1, 40), SCHEMA)
    q = df.select(F.col("id").alias("q"), "model", "v")
    assert K.nearest(q.limit(0), df).count() == 0 and K.nearest(q, df.limit(0)).count() == 0 and K.agreement(df.limit(0), 1.0).count() == 0
    assert K.hamming_nearest(*(spark.createDataFrame([], f"{c} long, model string, v array<bigint>") for c in ("q", "id")), 2).count() == 0


@pytest.mark.parametrize("agreeing,conflicting,by_hand,want", [(1, 0, False, "approve"), (1, 0, True, "manual_approval"), (5, 0, False, "approve"), (3, 1, False, "manual_review"), (3, 1, True, "manual_review"), (0, 4, False, "insufficient_evidence"), (0, 0, True, "insufficient_evidence")])
def test_recommendation(spark, agreeing, conflicting, by_hand, want):
    assert spark.range(1).select(R.recommendation(F.lit(agreeing), F.lit(conflicting), F.lit(by_hand))).first()[0] == want
    assert spark.range(1).select(R.recommendation(F.lit(1), F.lit(0), F.lit(False), 3)).first()[0] == "manual_review"


@pytest.mark.parametrize("known,score,good,ratio,want", [(False, 0.0, None, None, "no_reference"), (True, 0.0, None, None, "reference_conflict"), (True, 0.7, 18, 0.32, "reference_confirmed"), (True, 0.7, 17, 0.5, "reference_uncertain"), (True, 0.7, 30, 0.31, "reference_uncertain"), (True, 0.57, 60, 0.9, "reference_uncertain"), (True, 0.41, 60, 0.9, "reference_conflict")])
def test_verification(spark, known, score, good, ratio, want):
    assert spark.range(1).select(R.verification(F.lit(known), F.lit(score), F.lit(good).cast("int"), F.lit(ratio).cast("double"))).first()[0] == want


def test_no_bundle_is_asked_cell_by_cell(spark):
    """Random directions: every cell may hold something near, so a query goes to all bundles of its model, which are as many as its rows fill."""
    r = random.Random(6)
    rows = [(k, "m", [r.gauss(0, 1) for _ in range(24)]) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, model string, v array<double>")
    index = K.Cells(df, 28, block=150)
    asked = df.where("id < 90").select(F.col("id").alias("q"), "model", "v").withColumn("within", F.lit(6.0))
    assert index.reached(asked, "within", 1).count() > 90 * 20
    assert index.reached(asked, "within", 1, "bundle").count() <= 90 * 6


def test_crowded_chunks_are_not_looked_up(spark, monkeypatch):
    """Descriptors that share nearly all chunks' values would meet pair by pair: they are compared in blocks, to the same end."""
    r = random.Random(7)
    rows = [(k, "m", [sum(r.choice((0, 1)) << b for b in range(0, 64, 8)) for _ in range(2)]) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, model string, v array<bigint>")
    monkeypatch.setattr(K, "hamming_within", lambda *_: pytest.fail("looked up"))
    got = {(x["q"], x["id"], x["d"], x["n"]) for x in K.hamming_nearest(df.where("id % 20 = 0").withColumnRenamed("id", "q"), df, 2, 2, 8, 3).collect()}
    assert got == nearest(rows, [x for x in rows if x[0] % 20 == 0], 2, bits)
