"""Order-dependent operators on boxes, quadrilaterals and lines of an image: greedy suppression and greedy clustering.

Both take an image's rows in order, best first, and ask each row about those before it that were kept. Spark deals rows out by image and sorts them; a task streams through its images in Arrow batches
and holds of an image only what is kept, or the clusters so far. A block of rows is compared with what is kept as matrices, and small images go together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an image that are compared at once, and rows of an image that goes with others.
ROWS, SMALL = 128, 256


def angle_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Degrees between two lines' directions, of which each has two."""
    d = np.abs(a - b) % 180.0
    return np.minimum(d, 180.0 - d)


def box_share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared part of boxes (..., 4) and boxes (..., 4) by the union, pair by pair; 0 where neither has an area."""
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    shared = np.maximum(w, 0) * np.maximum(h, 0)
    area = lambda x: np.maximum(x[..., 2] - x[..., 0], 0) * np.maximum(x[..., 3] - x[..., 1], 0)
    union = area(a) + area(b) - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def box_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, m): box_share of all pairs of boxes (x1, y1, x2, y2)."""
    return box_share(a[:, None], b[None])


def shoelace(ring: np.ndarray) -> np.ndarray:
    """Signed area of rings (..., points, 2)."""
    x, y = ring[..., 0], ring[..., 1]
    return 0.5 * (x * np.roll(y, -1, -1) - np.roll(x, -1, -1) * y).sum(axis=-1)


def _clipped(ring: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Convex rings (n, points, 2) cut to the left of the lines from a to b (n, 2). Rings of fewer points than others repeat their last one, which adds no area; rings that are cut off whole are one point."""
    side = (b[:, None, 0] - a[:, None, 0]) * (ring[..., 1] - a[:, None, 1]) - (b[:, None, 1] - a[:, None, 1]) * (ring[..., 0] - a[:, None, 0])
    after, following = np.roll(side, -1, 1), np.roll(ring, -1, 1)
    crosses = (side >= 0) != (after >= 0)
    step = np.divide(side, side - after, out=np.zeros_like(side), where=crosses)
    out = np.stack([ring, ring + step[..., None] * (following - ring)], axis=2).reshape(len(ring), 2 * ring.shape[1], 2)
    stays = np.stack([side >= 0, crosses], axis=2).reshape(len(ring), 2 * ring.shape[1])
    # those that stay come first, as many as any ring has; the last one stands for the others
    count = stays.sum(axis=1)
    at = np.argsort(~stays, axis=1, kind="stable")[:, : max(1, int(count.max(initial=0)))]
    at = np.take_along_axis(at, np.minimum(np.arange(at.shape[1]), np.maximum(count - 1, 0)[:, None]), axis=1)
    out = np.take_along_axis(out, at[..., None], axis=1)
    return np.where((count > 0)[:, None, None], out, 0.0)


def may_share(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether convex polygons may have that share in common, by the boxes around them."""
    x, y = bounds(a), bounds(b)
    w, h = (np.maximum(np.minimum(x[:, 2 + k], y[:, 2 + k]) - np.maximum(x[:, k], y[:, k]), 0) for k in (0, 1))
    areas = np.abs(shoelace(a)) + np.abs(shoelace(b))
    return w * h >= least * (1 - 1e-9) * (areas - w * h)


def polygon_share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared part of convex polygons (n, points, 2) and as many others by the union, pair by pair, in either direction."""
    turned = lambda p: np.where((shoelace(p) < 0)[:, None, None], p[:, ::-1], p)
    a, b = turned(a), turned(b)
    ring = a
    for k in range(b.shape[1]):
        ring = _clipped(ring, b[:, k], b[:, (k + 1) % b.shape[1]])
    shared = np.abs(shoelace(ring)) if len(a) else np.zeros(0)
    union = shoelace(a) + shoelace(b) - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def polygon_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, m): polygon_share of all pairs of polygons."""
    n, m = len(a), len(b)
    return polygon_share(np.repeat(a, m, axis=0), np.tile(b, (n, 1, 1))).reshape(n, m)


def bounds(p: np.ndarray) -> np.ndarray:
    """Boxes around polygons (n, points, 2)."""
    return np.concatenate([p.min(axis=1), p.max(axis=1)], axis=1)


@dataclass(frozen=True)
class Clash:
    """When a row goes because of a kept one: each part that is set must hold.

    columns are the row's arguments: of `shape` "box" x1, y1, x2, y2, of "polygon" and "bounds" the x and y of each corner in turn, of "centre" x and y; then, if `angle` is set, the angle.
    overlap is a share of the union that is passed ("at_least": or reached); near a distance of centres that isn't reached; angle degrees that aren't reached.
    """

    columns: tuple[str, ...]
    shape: str = "box"
    overlap: float = 0.45
    at_least: bool = False
    near: float = 0.0
    angle: float | None = None

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(n, m): whether rows of a and of b clash."""
        n, m = len(a), len(b)
        return self.each(np.repeat(a, m, axis=0), np.tile(b, (n, 1))).reshape(n, m)

    def each(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each row of a clashes with that of b."""
        angled = self.angle is not None
        x, y = (v[:, :-1] if angled else v for v in (a, b))
        if self.shape == "centre":
            hit = np.hypot(x[:, 0] - y[:, 0], x[:, 1] - y[:, 1]) < self.near
        else:
            if self.shape != "box":
                x, y = x.reshape(len(x), len(x[0]) // 2 if len(x) else 4, 2), y.reshape(len(y), len(y[0]) // 2 if len(y) else 4, 2)
            if self.shape == "polygon":
                share, near = np.zeros(len(x)), may_share(x, y, self.overlap)
                share[near] = polygon_share(x[near], y[near])
            else:
                share = box_share(bounds(x), bounds(y)) if self.shape == "bounds" else box_share(x, y)
            hit = share >= self.overlap if self.at_least else share > self.overlap
        return hit & (angle_distance(a[:, -1], b[:, -1]) < self.angle) if angled else hit


def _kept(block: np.ndarray, start: np.ndarray, clash: Clash, most: int | None) -> np.ndarray:
    """Which rows of whole images stay: images begin at `start`, their rows stand in order. All images are gone through at once, their first rows, then their second ones and so on."""
    size = np.diff(np.append(start, len(block)))
    image = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(block)) - start[image]
    keep, count = np.zeros(len(block), bool), np.zeros(len(start), np.int64)
    for at in range(int(size.max(initial=0))):
        row = np.flatnonzero(place == at)
        if at:
            # each row with those before it in its image that were kept
            late, early = np.repeat(row, at), (start[image[row]][:, None] + np.arange(at)).ravel()
            late, early = late[keep[early]], early[keep[early]]
            hit = late[clash.each(block[late], block[early])]
            row = row[~np.isin(row, hit)]
        if most is not None:
            row = row[count[image[row]] < most]
        keep[row] = True
        count[image[row]] += 1
    return keep


def _cuts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where a key's rows begin, and the end."""
    new = np.zeros(len(batch), bool)
    new[:1] = True
    for c in range(keys):
        values = batch.column(c).to_pylist()
        new[1:] |= np.fromiter((a != b for a, b in zip(values[1:], values[:-1], strict=True)), bool, len(values) - 1)
    return np.append(np.flatnonzero(new), len(batch))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) in order; a key's rows may come in several parts."""
    for batch in batches:
        if not len(batch):
            continue
        cut = _cuts(batch, keys).tolist()
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            yield tuple(batch.column(c)[i].as_py() for c in range(keys)), batch.slice(i, j - i)


def _numbers(rows: pa.RecordBatch, first: int, last: int) -> np.ndarray:
    return np.column_stack([np.asarray(rows.column(c).cast(pa.float64()).fill_null(np.nan)) for c in range(first, last)])


def suppressed(d: DataFrame, keys: list[str], order: list[Column], clash: Clash, most: int | None = None) -> DataFrame:
    """d's rows that no better row of their keys suppresses, in `order`, which should end with a key; of them the first `most`, where an image's number is bounded.

    Rows with a null or NaN among the clash's columns clash with nothing. Other columns stay as they are; rows alike in all suppress each other.
    """
    n, names = len(keys), d.columns
    own = [F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate(clash.columns)]
    ordered = d.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *own, *d.columns).repartition(*(F.col(f"_k{i}") for i in range(n))).sortWithinPartitions(*(f"_k{i}" for i in range(n)), *order)
    width = len(clash.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, np.zeros((0, width))
        for batch in batches:
            if not len(batch):
                continue
            cut = _cuts(batch, n)
            size = np.diff(cut)
            # images that are whole in the batch and small go together; the first and the last may have rows in other batches
            small = size <= SMALL
            small[[0, -1]] = False
            block = _numbers(batch, n, n + width)
            stay = np.zeros(len(batch), bool)
            mine = np.repeat(small, size)
            stay[mine] = _kept(block[mine], np.cumsum(size[small]) - size[small], clash, most)
            for g in np.flatnonzero(~small).tolist():
                key = tuple(batch.column(c)[int(cut[g])].as_py() for c in range(n))
                if key != now:
                    now, kept = key, np.zeros((0, width))
                for i in range(int(cut[g]), int(cut[g + 1]), ROWS):
                    if most is not None and len(kept) >= most:
                        break
                    rows = block[i : min(i + ROWS, int(cut[g + 1]))]
                    free = np.flatnonzero(~clash.between(rows, kept).any(axis=1)) if len(kept) else np.arange(len(rows))
                    free = free[_kept(rows[free], np.zeros(1, np.int64), clash, None if most is None else most - len(kept))]
                    kept = np.concatenate([kept, rows[free]])
                    stay[free + i] = True
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(stay)).columns[n + width :], names)

    return ordered.mapInArrow(run, d.schema)


@dataclass(frozen=True)
class Cluster:
    """When a row joins a cluster: by value, within `reach` of the cluster's mean value; or as a line, within `angle` degrees of the cluster's mean angle, across it no farther than `across` from the nearest centre, and,
    if `along` is set, along it no farther than `along` mean lengths from the nearest centre.

    columns are (value) or (angle, x, y, length, across).
    """

    columns: tuple[str, ...]
    reach: float | None = None
    angle: float = 7.0
    along: float | None = None


class _Clusters:
    """An image's clusters: sums for their means, and the centres of their rows."""

    def __init__(self, rule: Cluster) -> None:
        self.rule, self.n = rule, 0
        self.sums, self.count = np.zeros((0, 2)), np.zeros(0)
        self.centres: list[np.ndarray] = []

    def place(self, row: np.ndarray) -> int:
        """Number of the first cluster that takes the row, a new one if none does."""
        rule = self.rule
        mean = self.sums / np.maximum(self.count, 1)[:, None]
        if rule.reach is not None:
            fits = np.flatnonzero(np.abs(row[0] - mean[:, 0]) <= rule.reach)
        else:
            fits = np.flatnonzero(angle_distance(row[0], mean[:, 0]) <= rule.angle)
        for k in fits.tolist():
            if rule.reach is None:
                turn = np.radians(mean[k, 0])
                apart = row[1:3] - self.centres[k]
                if np.abs(apart @ (-np.sin(turn), np.cos(turn))).min() > row[4]:
                    continue
                if rule.along is not None and np.abs(apart @ (np.cos(turn), np.sin(turn))).min() > mean[k, 1] * rule.along:
                    continue
            break
        else:
            k = len(self.count)
            self.sums, self.count = np.concatenate([self.sums, np.zeros((1, 2))]), np.append(self.count, 0)
            self.centres.append(np.zeros((0, 2)))
        self.sums[k] += (row[0], row[3] if rule.reach is None else 0)
        self.count[k] += 1
        if rule.reach is None:
            self.centres[k] = np.concatenate([self.centres[k], row[None, 1:3]])
        return k


def clustered(d: DataFrame, keys: list[str], order: list[Column], rule: Cluster) -> DataFrame:
    """d's rows with `cluster`, from 0 in the order in which an image's clusters begin. Rows with a null or NaN among the rule's columns join nothing and have none."""
    n, width = len(keys), len(rule.columns)
    names = [c for c in d.columns if c != "cluster"]
    own = [F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate(rule.columns)]
    ordered = d.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *own, *names).repartition(*(F.col(f"_k{i}") for i in range(n))).sortWithinPartitions(*(f"_k{i}" for i in range(n)), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for key, rows in _runs(batches, n):
            if held is None or key != now:
                now, held = key, _Clusters(rule)
            numbers = [None if np.isnan(row).any() else held.place(row) for row in _numbers(rows, n, n + width)]
            yield pa.RecordBatch.from_arrays([*rows.columns[n + width :], pa.array(numbers, pa.int32())], [*names, "cluster"])

    from pyspark.sql.types import IntegerType, StructField, StructType

    return ordered.mapInArrow(run, StructType([*(d.schema[c] for c in names), StructField("cluster", IntegerType())]))
