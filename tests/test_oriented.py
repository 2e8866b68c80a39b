"""Suppression and clustering against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from lotwise.operators import oriented as O

SCHEMA = "item string, image int, pos int, score double, x1 double, y1 double, x2 double, y2 double, angle double, length double, cluster string"
KEYS = ["item", "image"]


def best_first():
    return [F.desc("score"), F.col("pos")]


def rows(seed, n=260):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y = r.uniform(0, 90), r.uniform(0, 60)
        out.append((r.choice("ab"), r.choice([0, 0, 1, None]), k, round(r.random(), 2), x, y, x + r.uniform(1, 40), y + r.uniform(1, 40), r.uniform(0, 180), r.uniform(5, 40), "c"))
    return out


def by_image(data):
    groups = {}
    for row in sorted(data, key=lambda x: (-x[3], x[2])):
        groups.setdefault(row[:2], []).append(row)
    return groups.values()


def iou(a, b):
    w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
    shared = max(0, w) * max(0, h)
    return shared / (sum((x[6] - x[4]) * (x[7] - x[5]) for x in (a, b)) - shared)


def turned(a, b):
    d = abs(a - b) % 180
    return min(d, 180 - d)


@pytest.mark.parametrize("clash,test,most", [
    (O.Clash(("x1", "y1", "x2", "y2"), overlap=0.3), lambda a, b: iou(a, b) > 0.3, None),
    (O.Clash(("x1", "y1", "x2", "y2"), overlap=0.2, at_least=True), lambda a, b: iou(a, b) >= 0.2, 9),
    (O.Clash(("x1", "y1"), "centre", near=12.0), lambda a, b: math.dist(a[4:6], b[4:6]) < 12, None),
    (O.Clash(("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2", "angle"), "bounds", overlap=0.15, angle=30.0), lambda a, b: iou(a, b) > 0.15 and turned(a[8], b[8]) < 30, None),
    (O.Clash(("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2"), "polygon", overlap=0.3), lambda a, b: iou(a, b) > 0.3, None),
])
def test_suppression(spark, monkeypatch, clash, test, most):
    monkeypatch.setattr(O, "ROWS", 17)
    data = rows(1)
    want = set()
    for group in by_image(data):
        kept = []
        for row in group:
            if not any(test(row, k) for k in kept) and (most is None or len(kept) < most):
                kept.append(row)
        want |= {k[2] for k in kept}
    got = O.suppressed(spark.createDataFrame(data, SCHEMA), KEYS, best_first(), clash, most)
    assert got.columns == [x.split()[0] for x in SCHEMA.split(", ")] and {r["pos"] for r in got.collect()} == want and len(want) < len(data)


def inside(p, polygon):
    return all((polygon[(k + 1) % 4][0] - polygon[k][0]) * (p[1] - polygon[k][1]) - (polygon[(k + 1) % 4][1] - polygon[k][1]) * (p[0] - polygon[k][0]) >= 0 for k in range(4))


def test_polygon_overlap_by_sampling():
    r = random.Random(2)

    def quad():
        x, y, w, h, t = r.uniform(30, 70), r.uniform(30, 70), r.uniform(10, 50), r.uniform(10, 50), r.uniform(0, math.pi)
        return [(x + u * w / 2 * math.cos(t) - v * h / 2 * math.sin(t), y + u * w / 2 * math.sin(t) + v * h / 2 * math.cos(t)) for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1))]

    a, b = [quad() for _ in range(12)], [quad() for _ in range(12)]
    got = O.polygon_iou(np.array([q[::-1] if k % 2 else q for k, q in enumerate(a)]), np.array(b))
    grid = [(x + 0.5, y + 0.5) for x in range(-20, 120) for y in range(-20, 120)]
    for i, p in enumerate(a):
        one = {g for g in grid if inside(g, p)}
        for j, q in enumerate(b):
            two = {g for g in grid if inside(g, q)}
            assert abs(got[i, j] - len(one & two) / len(one | two)) < 0.04
    square = np.array([[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]])
    assert O.polygon_iou(square, square + 1)[0, 0] == pytest.approx(1 / 7) and O.polygon_iou(square, square + 5)[0, 0] == 0 and O.polygon_iou(square, square)[0, 0] == 1


@pytest.mark.parametrize("along", [None, 0.85])
def test_line_clusters(spark, along):
    data = rows(3)
    want = {}
    for group in by_image(data):
        clusters = []
        for row in group:
            for number, cluster in enumerate(clusters):
                mean = sum(c[8] for c in cluster) / len(cluster)
                if turned(row[8], mean) > 7:
                    continue
                t = math.radians(mean)
                apart = [(row[4] - c[4], row[5] - c[5]) for c in cluster]
                if min(abs(-x * math.sin(t) + y * math.cos(t)) for x, y in apart) > 8:
                    continue
                if along and min(abs(x * math.cos(t) + y * math.sin(t)) for x, y in apart) > along * sum(c[9] for c in cluster) / len(cluster):
                    continue
                cluster.append(row)
                break
            else:
                number = len(clusters)
                clusters.append([row])
            want[row[2]] = number
    d = spark.createDataFrame(data, SCHEMA).withColumn("across", F.lit(8.0))
    got = O.clustered(d, KEYS, best_first(), O.Cluster(("angle", "x1", "y1", "length", "across"), along=along))
    assert {r["pos"]: r["cluster"] for r in got.collect()} == want and max(want.values()) > 5


def test_value_clusters(spark):
    data = rows(4)
    want = {}
    for group in by_image(data):
        clusters = []
        for row in sorted(group, key=lambda x: (x[4], x[2])):
            number = next((k for k, c in enumerate(clusters) if abs(row[4] - sum(c) / len(c)) <= 6), len(clusters))
            clusters[number:] or clusters.append([])
            clusters[number].append(row[4])
            want[row[2]] = number
    got = O.clustered(spark.createDataFrame(data, SCHEMA), KEYS, [F.col("x1"), F.col("pos")], O.Cluster(("x1",), reach=6.0))
    assert {r["pos"]: r["cluster"] for r in got.collect()} == want


def test_nulls_and_no_rows(spark):
    data = [("a", 0, 1, 0.9, None, 1.0, 2.0, 3.0, None, 1.0, "c"), ("a", 0, 2, 0.8, None, 1.0, 2.0, 3.0, 5.0, 1.0, "c"), (None, None, 3, None, 0.0, 0.0, 5.0, 5.0, 1.0, 1.0, "c"), (None, None, 4, None, 0.0, 0.0, 5.0, 5.0, 1.0, 1.0, "c")]
    d = spark.createDataFrame(data, SCHEMA)
    clash = O.Clash(("x1", "y1", "x2", "y2"))
    assert {r["pos"] for r in O.suppressed(d, KEYS, best_first(), clash).collect()} == {1, 2, 3}
    assert {r["pos"]: r["cluster"] for r in O.clustered(d, KEYS, best_first(), O.Cluster(("x1",), reach=1.0)).collect()} == {1: None, 2: None, 3: 0, 4: 0}
    assert O.suppressed(d.limit(0), KEYS, best_first(), clash).count() == 0 == O.clustered(d.limit(0), KEYS, best_first(), O.Cluster(("x1",), reach=1.0)).count()


def test_homographies_and_degenerate_points(spark):
    from lotwise.operators import references as R

    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    line = [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [0.0, 5.0]]
    rows = spark.createDataFrame([(1, square, [[2 * x, 2 * y] for x, y in square]), (2, [[0.0, 0.0]] * 4, square), (3, line, square), (4, None, square), (5, square[:3], square)], "id long, source array<array<double>>, target array<array<double>>")
    got = {r["id"]: r["h"] for r in R.homographies(rows).collect()}
    assert got[1] == pytest.approx([2, 0, 0, 0, 2, 0, 0, 0, 1]) and [got[k] for k in (2, 3, 4, 5)] == [None] * 4
