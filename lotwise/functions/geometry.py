"""Boxes, polygons and projections as arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area, 0 for empty boxes."""
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def overlap_smaller(a: Column, b: Column) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def _box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), x2.cast("int").alias("x2"), y2.cast("int").alias("y2"))


def tiles(width: Column, height: Column, size: int, overlap: float) -> Column:
    """Named boxes that cover an image: "full", and, if it is larger than a tile, tiles row by row in steps of size * (1 - overlap), with a last one at the far edge, cut to the image."""
    step = max(1, int(size * (1 - overlap)))
    full = F.struct(F.lit("full").alias("name"), _box(F.lit(0), F.lit(0), width, height).alias("box"))

    def along(length: Column) -> Column:
        last = F.greatest(length - size, F.lit(0)).cast("int")
        return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))

    xs, ys = along(width), along(height)
    name = lambda x, y: F.concat(F.lit("tile-"), x.cast("string"), F.lit("-"), y.cast("string"))
    parts = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(name(x, y).alias("name"), _box(x, y, F.least(width, x + size), F.least(height, y + size)).alias("box")))))
    return F.when(F.greatest(width, height) <= size, F.array(full)).otherwise(F.concat(F.array(full), parts))


def crops(width: Column, height: Column) -> Column:
    """Named boxes of an image: "full", then its quarters and its ninths row by row, each wider by a sixth of its size on every side, cut to the image."""
    out = [F.struct(F.lit("full").alias("name"), _box(F.lit(0), F.lit(0), width, height).alias("box"))]
    for grid in (2, 3):
        w, h = F.floor(width / grid), F.floor(height / grid)
        dx, dy = F.floor(w / 6), F.floor(h / 6)
        for y in range(grid):
            for x in range(grid):
                box = _box(F.greatest(F.lit(0), x * w - dx), F.greatest(F.lit(0), y * h - dy), F.least(width, (x + 1) * w + dx), F.least(height, (y + 1) * h + dy))
                out.append(F.struct(F.lit(f"g{grid}-{x}-{y}").alias("name"), box.alias("box")))
    return F.array(*out)


def named_crops(found: Column, names: tuple[str, ...]) -> Column:
    """Of an array of named boxes those of given names that aren't empty."""
    return F.filter(found, lambda c: c["name"].isin(*names) & (c["box"]["x2"] > c["box"]["x1"]) & (c["box"]["y2"] > c["box"]["y1"]))


def translated(b: Column, dx: Column, dy: Column) -> Column:
    return F.struct((b["x1"] + dx).alias("x1"), (b["y1"] + dy).alias("y1"), (b["x2"] + dx).alias("x2"), (b["y2"] + dy).alias("y2"))


def polygon_bounds(polygon: Column, ratio: float, width: Column, height: Column) -> Column:
    """The box around a polygon, grown by a share of its size and cut to the image."""
    of = lambda k: F.transform(polygon, lambda p: p[k])
    around = F.struct(F.array_min(of("x")).alias("x1"), F.array_min(of("y")).alias("y1"), F.array_max(of("x")).alias("x2"), F.array_max(of("y")).alias("y2"))
    return expanded(around, ratio, width, height)


def in_pixels(polygon: Column, width: Column, height: Column) -> Column:
    """The reverse of `scaled`: shares of the image to pixels; an error if one isn't a share."""
    inside = F.forall(polygon, lambda p: (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] <= 1) & (p["y"] <= 1))
    out = F.transform(polygon, lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y")))
    return F.when(inside, out).otherwise(F.raise_error(F.lit("a share lies outside 0 to 1")))


def expanded(b: Column, ratio: float, width: Column, height: Column) -> Column:
    """A box grown by a share of its size on each side and cut to the image."""
    dx, dy = (b["x2"] - b["x1"]) * ratio, (b["y2"] - b["y1"]) * ratio
    return F.struct(F.greatest(F.lit(0.0), b["x1"] - dx).alias("x1"), F.greatest(F.lit(0.0), b["y1"] - dy).alias("y1"), F.least(width, b["x2"] + dx).alias("x2"), F.least(height, b["y2"] + dy).alias("y2"))


def corners(b: Column) -> Column:
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(b["x1"], b["y1"]), point(b["x2"], b["y1"]), point(b["x2"], b["y2"]), point(b["x1"], b["y2"]))


def projected(polygon: Column, h: list[float]) -> Column:
    """Points through a 3x3 homography given row by row."""

    def go(p: Column) -> Column:
        w = h[6] * p["x"] + h[7] * p["y"] + h[8]
        return F.struct(((h[0] * p["x"] + h[1] * p["y"] + h[2]) / w).alias("x"), ((h[3] * p["x"] + h[4] * p["y"] + h[5]) / w).alias("y"))

    return F.transform(polygon, go)


def scaled(polygon: Column, width: Column, height: Column) -> Column:
    """Pixels to shares of the image; an error if a point lies outside."""
    inside = F.forall(polygon, lambda p: (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] <= width) & (p["y"] <= height))
    out = F.transform(polygon, lambda p: F.struct((p["x"] / width).alias("x"), (p["y"] / height).alias("y")))
    return F.when(inside, out).otherwise(F.raise_error(F.lit("a point lies outside the image")))


def centroid(polygon: Column) -> Column:
    n = F.size(polygon)
    mean = lambda k: F.aggregate(polygon, F.lit(0.0), lambda s, p: s + p[k]) / n
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def match_score(good: Column, inlier_ratio: Column, trust: Column | None = None) -> Column:
    """How well a reference matches: good matches up to 60, the share of inliers, and how far the reference is trusted."""
    out = F.least(F.lit(1.0), good / 60.0) * 0.45 + inlier_ratio * 0.55
    return out if trust is None else out * trust


def yolo_line(number: Column, b: Column, width: Column, height: Column) -> Column:
    """A training label: class, then centre and size of a box as shares of the image."""
    return F.format_string("%d %.8f %.8f %.8f %.8f", number, (b["x1"] + b["x2"]) / 2 / width, (b["y1"] + b["y2"]) / 2 / height, (b["x2"] - b["x1"]) / width, (b["y2"] - b["y1"]) / height)
