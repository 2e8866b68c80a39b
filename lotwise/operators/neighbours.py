"""Nearest neighbours by index tables: inverted cells for Euclidean distance, multi-index hashing for Hamming distance. Both give exact results.

Cells: centroids are fitted on a bounded sample, every row is put into the cell of its nearest centroid, and a cell knows its radius within each model. By the triangle inequality
a cell whose centroid is farther from a query than its radius and the distance in question can't hold an answer, and is never read.

Hashing: a descriptor's bits are cut into chunks. Two descriptors that differ in at most `chunks * (s + 1) - 1` bits differ in at most s bits of some chunk, so looking up all values within s bits of each
of a query's chunks finds all neighbours within that distance.

Queries and rows meet by model and bundle of cells (or chunk) in blocks of bounded size, and are compared there as matrices; no model is joined with itself. A bundle is neighbouring cells of about a block's
rows: a query goes to it once, whatever number of its cells may hold an answer. Products of matrices bound the distances there; only pairs that the bound leaves open are measured, so answers are those of measuring all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import as_table

#: Rows that centroids are fitted on, and centroids, at most.
SAMPLE, CELLS = 20_000, 256
#: Rows and queries of a bundle that meet in one task, about.
BLOCK = 2048
#: Queries that are sent to their bundles at once, and entries of a matrix of distances.
SLICE, ENTRIES = 256, 1 << 19


def fit_cells(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Centroids of a bounded sample of rows (id, v): those of least hash of id; a cell for 32 of its rows, up to `cells`."""
    v = _matrix(rows.where("v is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column(0))
    if not len(v):
        return np.zeros((1, 0))
    n = max(1, min(cells, len(v) // 32))
    centres = v[np.linspace(0, len(v) - 1, n).astype(int)]
    for _ in range(rounds):
        near = _distances(v, centres).argmin(axis=1)
        count = np.bincount(near, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, near, v)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    # one after the other, so that cells of near numbers are near each other
    order, left = [0], np.arange(1, n)
    while len(left):
        k = int(((centres[left] - centres[order[-1]]) ** 2).sum(axis=1).argmin())
        order.append(int(left[k]))
        left = np.delete(left, k)
    return centres[order]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _vectors(rows: DataFrame):
    """Column v as doubles, or as floats if that is what it has."""
    return F.col("v") if rows.schema["v"].dataType.simpleString() == "array<float>" else F.col("v").cast("array<double>").alias("v")


def _squares(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row of a, squared distances to all of b, how far these may be off), some rows of a at a time; NaN stands for infinity."""
    own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
    step = max(1, ENTRIES // max(1, len(b)))
    for i in range(0, len(a), step):
        part = own[i : i + step, None] + other
        off = 1e-9 * part + 1e-12
        with np.errstate(invalid="ignore", over="ignore"):
            g = part - 2 * (a[i : i + step] @ b.T)
        yield i, np.where(np.isnan(g), np.inf, g), np.where(np.isfinite(off), off, np.inf)


def _each_distance(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of rows a[at] and b[to], pair by pair."""
    out = np.empty(len(at))
    step = max(1, (1 << 22) // max(1, a.shape[1]))
    for i in range(0, len(at), step):
        out[i : i + step] = np.sqrt(((a[at[i : i + step]] - b[to[i : i + step]]) ** 2).sum(axis=1))
    return out


def _closer(a: np.ndarray, b: np.ndarray, distance: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, distances) of all pairs within a distance, some rows of a at a time."""
    for i, g, off in _squares(a, b):
        at, to = np.nonzero(g - off <= distance * distance)
        d = _each_distance(a, b, at + i, to)
        near = d <= distance
        yield at[near] + i, to[near], d[near]


def _count_closer(a: np.ndarray, b: np.ndarray, distance: float) -> np.ndarray:
    """How many rows of b lie within a distance of each of a."""
    out = np.zeros(len(a), np.int64)
    for i, g, off in _squares(a, b):
        sure = g + off <= distance * distance
        at, to = np.nonzero((g - off <= distance * distance) & ~sure)
        out[i : i + len(g)] = sure.sum(axis=1) + np.bincount(at[_each_distance(a, b, at + i, to) <= distance], minlength=len(g))
    return out


def _where(q: pa.Array, ids: pa.Array) -> np.ndarray:
    """The place of each of q among ids, which are there once each; -1 if it isn't."""
    return pc.fill_null(pc.index_in(q, value_set=ids), -1).to_numpy(zero_copy_only=False)


def _firsts(at: np.ndarray, d: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Of pairs the first k of each row `at`, by distance and then rank."""
    order = np.lexsort((rank, d, at))
    row = at[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    return order[place < k]


def _ranks(ids: pa.Array) -> np.ndarray:
    """The place of each id in their order."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between rows of a and of b, as sums of squared differences, a few rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 22) // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None] - b[None]) ** 2).sum(axis=2))
    return out


class Cells:
    """Rows (id, model, v) by cell, as a table, and each model's cells."""

    def __init__(self, rows: DataFrame, cells: int = CELLS, block: int = BLOCK) -> None:
        rows = rows.select("id", "model", _vectors(rows)).where("v is not null")
        self.centres = rows.sparkSession.sparkContext.broadcast(fit_cells(rows, cells))
        self.kind, self.block = rows.schema["id"].dataType.simpleString(), block
        shared, ddl = self.centres, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = _distances(_matrix(batch.column(2)), shared.value) if len(batch) else np.zeros((0, 1))
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "model", "v", "cell", "far"])

        self.table = as_table(rows.mapInArrow(run, f"{ddl}, cell int, far double"), "cells")
        before = F.sum("n").over(Window.partitionBy("model").orderBy("cell")) - F.col("n")
        own = self.table.groupBy("model", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        #: each model's cells in bundles: those that begin in the same `block` rows, in order of cells
        self.bundles = as_table(own.withColumn("bundle", F.floor(before / block).cast("int")), "bundles")
        #: one row for each model, of at most as many entries as there are centroids
        self.models = self.bundles.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("cell", "radius", "n", "bundle"))).alias("cells"), F.sum("n").alias("size"))

    def reached(self, queries: DataFrame, within: str | None, k: int, part: str = "cell") -> DataFrame:
        """queries (q, model, v) with each cell, or bundle, to look into: all that can hold a row within the distance in column `within`; without one, the nearest that hold over k rows together."""
        shared = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, len(whole), SLICE):
                    batch = whole.slice(i, SLICE)
                    d, cells = _distances(_matrix(batch.column(2)), shared.value), batch.column(3)
                    ends, flat = cells.offsets.to_numpy(), cells.values
                    row = np.repeat(np.arange(len(batch)), np.diff(ends))
                    cell, radius, n, into = (flat.field(c).to_numpy()[ends[0] : ends[-1]] for c in ("cell", "radius", "n", part))
                    far = d[row, cell]
                    if within:
                        bound = batch.column(4).to_numpy(zero_copy_only=False).astype(float)[row]
                        mine = far - radius <= bound * (1 + 1e-9) + 1e-9
                    else:
                        order = np.lexsort((far, row))
                        before = np.cumsum(n[order]) - n[order]
                        # rows in nearer cells of the same query
                        before -= before[(ends[:-1] - ends[0])[row]]
                        mine = np.zeros(len(row), bool)
                        mine[order] = before <= k
                    at, into = np.unique(np.stack([row[mine], into[mine]]), axis=1)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in range(3)), pa.array(into.astype(np.int32))], ["q", "model", "v", part])

        q = queries.select("q", "model", _vectors(queries), *([within] if within else [])).where("v is not null").join(self.models.select("model", "cells"), "model")
        ddl = ", ".join(f"{c} {q.schema[c].dataType.simpleString()}" for c in ("q", "model", "v"))
        return q.select("q", "model", "v", "cells", *([within] if within else [])).mapInArrow(run, f"{ddl}, {part} int")

    def met(self, reached: DataFrame, compare, schema: str) -> DataFrame:
        """What `compare(q ids, q vectors, ids, vectors)` makes of each block of queries (q, model, v, bundle) and each block of rows of a bundle."""
        place = ["model", "bundle"]
        blocks = lambda n: F.greatest(F.lit(1), F.ceil(n * 2 / (3 * self.block))).cast("long")
        sizes = self.bundles.groupBy(*place).agg(blocks(F.sum("n")).alias("blocks"))
        asked = reached.groupBy(*place).agg(blocks(F.count("*")).alias("turns"))
        both = sizes.join(asked, place)
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        key = [*place, "block", "turn"]
        rows = self.table.join(self.bundles.select("model", "cell", "bundle"), ["model", "cell"]).join(both, place)
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("turn", each("turns")).select(*key, "id", "v")
        queries = reached.join(both, place).withColumn("turn", F.pmod(F.xxhash64("q"), F.col("turns"))).withColumn("block", each("blocks")).select(*key, "q", "v")

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            return compare(a.column("q").combine_chunks(), _matrix(a.column("v")), b.column("id").combine_chunks(), _matrix(b.column("v")))

        return queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(run, schema)


def _first(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("n") <= k)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 2, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """(q, id, d, n): the k nearest rows (id, model, v) of each query's model (q, model, v), by Euclidean distance and then id; a row of the query's own id isn't its neighbour.

    Exact: a first look into the bundles of the nearest cells bounds the k-th distance, a second one takes all others with a cell that could hold something nearer. Null vectors and queries of unknown models find nothing; a query
    or row that is repeated counts once. Vectors of one table have one length.
    """
    queries = queries.select("q", "model", "v").dropDuplicates(["q", "model"])
    index = Cells(rows.dropDuplicates(["id", "model"]), cells, block)

    def compare(q: pa.Array, a: np.ndarray, ids: pa.Array, b: np.ndarray) -> pa.Table:
        if not len(q) or not len(ids):
            return pa.table([q.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], ["q", "id", "d"])
        rank, mine, found = _ranks(ids), _where(q, ids), []
        for i, g, off in _squares(a, b):
            own = np.flatnonzero(mine[i : i + len(g)] >= 0)
            g[own, mine[i : i + len(g)][own]] = np.inf
            most = np.partition(g + off, min(k, g.shape[1]) - 1, axis=1)[:, min(k, g.shape[1]) - 1]
            at, to = np.nonzero(g - off <= most[:, None]) if np.isfinite(off).all() else np.nonzero(np.ones(g.shape, bool))
            other = mine[at + i] != to
            at, to = at[other] + i, to[other]
            d = _each_distance(a, b, at, to)
            first = _firsts(at, d, rank[to], k)
            found.append((at[first], to[first], d[first]))
        at, to, d = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([q.take(pa.array(at)), ids.take(pa.array(to)), pa.array(d)], ["q", "id", "d"])

    schema = f"q {queries.schema['q'].dataType.simpleString()}, id {index.kind}, d double"
    looked = as_table(index.reached(queries, None, k, "bundle"), "reached")
    found = as_table(_first(index.met(looked, compare, schema), k), "nearest")
    # with fewer than k rows so far, any distance may do
    bound = found.groupBy("q").agg(F.count("*").alias("c"), F.max("d").alias("far"))
    bounded = queries.join(bound, "q", "left").withColumn("within", F.when(F.col("c") >= k, F.col("far")).otherwise(F.lit(float("inf"))))
    more = index.reached(bounded, "within", k, "bundle").join(looked.select("q", "model", "bundle"), ["q", "model", "bundle"], "left_anti").select("q", "model", "v", "bundle")
    return _first(found.drop("n").union(index.met(more, compare, schema)), k)


def within(rows: DataFrame, distance: float, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """(id, partner, d): each row (id, model, v) and each other of its model within a distance. As many rows as there are such pairs, in both directions."""
    rows = rows.dropDuplicates(["id", "model"])
    index = Cells(rows, cells, block)

    def compare(q: pa.Array, a: np.ndarray, ids: pa.Array, b: np.ndarray) -> pa.Table:
        if not len(q) or not len(ids):
            return pa.table([q.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], ["id", "partner", "d"])
        at, to, d = (np.concatenate(x) for x in zip(*_closer(a, b, distance), strict=True))
        other = _where(q, ids)[at] != to
        at, to = at[other], to[other]
        return pa.table([q.take(pa.array(at)), ids.take(pa.array(to)), pa.array(d[other])], ["id", "partner", "d"])

    asked = rows.select(F.col("id").alias("q"), "model", "v").withColumn("within", F.lit(float(distance)))
    return index.met(index.reached(asked, "within", 1, "bundle"), compare, f"id {index.kind}, partner {index.kind}, d double")


def agreement(rows: DataFrame, distance: float, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """(id, agreeing, conflicting): how many others of its model lie within a distance of each row (id, model, v), and how many don't; rows alone in their model have no answer.

    Only bundles with a cell that can hold a row within the distance are read, and their answers are counted in the task; conflicts are what is left of the model.
    """
    rows = rows.where("v is not null").dropDuplicates(["id", "model"])
    index = Cells(rows, cells, block)

    def compare(q: pa.Array, a: np.ndarray, ids: pa.Array, b: np.ndarray) -> pa.Table:
        return pa.table([q, pa.array(_count_closer(a, b, distance) if len(q) and len(ids) else np.zeros(len(q), np.int64))], ["id", "near"])

    asked = rows.select(F.col("id").alias("q"), "model", "v").withColumn("within", F.lit(float(distance)))
    near = index.met(index.reached(asked, "within", 1, "bundle"), compare, f"id {index.kind}, near long").groupBy("id").agg(F.sum("near").alias("near"))
    # a row is within any distance of itself
    out = rows.select("id", "model").join(index.models.select("model", "size"), "model").join(near, "id")
    return out.where("size > 1").select("id", (F.col("near") - 1).alias("agreeing"), (F.col("size") - F.col("near")).alias("conflicting"))


#: Pairs that a round of looking up may bring, for each row and each query.
MEET = 16


def _near_values(bits: int, s: int) -> np.ndarray:
    """Masks of at most s of a chunk's bits."""
    return np.array([sum(1 << b for b in chosen) for n in range(s + 1) for chosen in combinations(range(bits), n)], np.int64)


def _chunks(v: DataFrame, words: int, bits: int, keep: list[str]) -> DataFrame:
    """A row for each chunk of v, an array of 64-bit words: its number and value."""
    per = 64 // bits
    value = lambda w, c: F.shiftrightunsigned(F.get("v", F.lit(w)), c * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    parts = F.array(*(F.struct(F.lit(w * per + c).alias("chunk"), value(w, c).alias("value")) for w in range(words) for c in range(per)))
    return v.select(*keep, F.explode(parts).alias("p")).select(*keep, "p.chunk", "p.value")


def hamming(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def _looked_up(asked: DataFrame, bits: int, s: int, keep: list[str]) -> DataFrame:
    """Chunks' values, and those that differ from them in at most s bits."""
    masks = F.array(*(F.lit(int(m)).cast("long") for m in _near_values(bits, s)))
    return asked.select(*keep, F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))


def hamming_within(queries: DataFrame, rows: DataFrame, words: int, bits: int = 16, s: int = 0) -> DataFrame:
    """(q, id, d): all rows (id, model, v) of each query's model (q, model, v) that differ from it in at most `words * (64 // bits) * (s + 1) - 1` bits, and not by id alone."""
    radius = words * (64 // bits) * (s + 1) - 1
    asked = _looked_up(_chunks(queries, words, bits, ["q", "model"]), bits, s, ["q", "model", "chunk"])
    there = _chunks(rows, words, bits, ["id", "model"])
    pairs = asked.join(there, ["model", "chunk", "value"]).where("q <> id").select("q", "id").distinct()
    both = pairs.join(queries.select("q", F.col("v").alias("_a")), "q").join(rows.select("id", F.col("v").alias("_b")), "id")
    return both.select("q", "id", hamming(F.col("_a"), F.col("_b")).alias("d")).where(F.col("d") <= radius)


def hamming_nearest(queries: DataFrame, rows: DataFrame, words: int, k: int = 2, bits: int = 16, rounds: int = 2) -> DataFrame:
    """(q, id, d, n): the k nearest rows (id, model, v) of each query's model by Hamming distance and then id; v is an array of `words` 64-bit words.

    Round after round the queries that have fewer than k rows within the radius are looked up with one bit more for each chunk, as long as the places to look up hold no more than `MEET` rows for each
    query and row there is; those left are compared with their model's rows in blocks, as matrices. So results are exact, and no more pairs are written than that. Rows or queries with null words, and
    repeated ones, count as in `nearest`.
    """
    clean = lambda d, key: d.where("v is not null and not exists(v, x -> x is null)").dropDuplicates([key, "model"])
    queries, rows = clean(queries.select("q", "model", "v"), "q"), clean(rows.select("id", "model", "v"), "id")
    there = as_table(_chunks(rows, words, bits, ["model"]).groupBy("model", "chunk", "value").agg(F.count("*").alias("n")), "chunks")
    held = there.where("chunk = 0").agg(F.sum("n")).first()[0] or 0
    done, left = [], as_table(queries, "hamming-left")
    for s in range(rounds):
        asked = _chunks(left, words, bits, ["model"]).groupBy("model", "chunk", "value").agg(F.count("*").alias("asks"))
        meet = _looked_up(asked, bits, s, ["model", "chunk", "asks"]).join(there, ["model", "chunk", "value"]).agg(F.sum(F.col("asks") * F.col("n"))).first()[0] or 0
        if meet > MEET * (held + left.count()):
            break
        found = as_table(_first(hamming_within(left, rows, words, bits, s), k), "hamming")
        full = found.groupBy("q").count().where(F.col("count") >= k).select("q")
        done.append(found.join(full, "q", "left_semi"))
        left = as_table(left.join(full, "q", "left_anti"), "hamming-left")
        if left.isEmpty():
            break
    if not left.isEmpty() or not done:
        blocks = lambda d, name: d.groupBy("model").agg(F.ceil(F.count("*") / BLOCK).alias(name))
        both = blocks(rows, "blocks").join(blocks(left, "turns"), "model")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        # a block of queries meets each block of its model's rows
        asked = left.join(both, "model").withColumn("turn", F.pmod(F.xxhash64("q"), F.col("turns"))).withColumn("block", each("blocks")).drop("blocks", "turns")
        held = rows.join(both, "model").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("turn", each("turns")).drop("blocks", "turns").withColumnRenamed("v", "w")

        kinds = f"q {queries.schema['q'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, d int"

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            q, ids = a.column("q").combine_chunks(), b.column("id").combine_chunks()
            if not len(q) or not len(ids):
                return pa.table([q.slice(0, 0), ids.slice(0, 0), pa.array([], pa.int32())], ["q", "id", "d"])
            x, y = (np.ascontiguousarray(t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), words).T).view(np.uint64) for t, c in ((a, "v"), (b, "w")))
            rank, mine, found = _ranks(ids), _where(q, ids), []
            step = max(1, ENTRIES // len(ids))
            for i in range(0, len(q), step):
                # distances and then ids in one number; a query's own row is the last
                d = sum(np.bitwise_count(x[w, i : i + step, None] ^ y[w]).astype(np.int64) for w in range(words))
                own = np.flatnonzero(mine[i : i + step] >= 0)
                d[own, mine[i : i + step][own]] = 64 * words + 1
                coded = d * len(ids) + rank
                near = np.argpartition(coded, min(k, len(ids)) - 1, axis=1)[:, :k]
                at, to = np.repeat(np.arange(len(d)), near.shape[1]), near.ravel()
                use = d[at, to] <= 64 * words
                found.append((at[use] + i, to[use], d[at, to][use]))
            at, to, d = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.table([q.take(pa.array(at)), ids.take(pa.array(to)), pa.array(d.astype(np.int32))], ["q", "id", "d"])

        met = asked.groupBy("model", "block", "turn").cogroup(held.groupBy("model", "block", "turn")).applyInArrow(run, kinds)
        done.append(_first(met, k))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def ratio_matches(near: DataFrame, ratio: float = 0.8) -> DataFrame:
    """(q, r, d1, d2) from the two nearest of each query (q, id, d, n): the nearest, if clearly nearer than the second."""
    pick = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    two = near.where("n <= 2").groupBy("q").agg(pick("id", 1).alias("r"), pick("d", 1).alias("d1"), pick("d", 2).alias("d2"))
    return two.where(F.col("d1") < ratio * F.col("d2"))
