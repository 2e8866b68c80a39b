"""The most similar name of a catalog of any size: cells of keys, bounds from shared characters and character pairs, exact similarities in batches.

The catalog is a table. Its keys stand in order and are cut into cells of about CELL keys; of a cell one knows the lengths of its keys, the least and greatest count of each character, and
which pairs of characters occur. Equal blocks of two texts use each character of either text once, so no more can match than their common characters. Between two such blocks at least one character of either text
is left over, so M matched characters of n + m lie in at most 1 + n + m - 2M blocks, which share 3M - n - m - 1 pairs of neighbours at least. Both bound the similarity of a name to a key and to all keys of a cell.

A name first meets the cell that bounds it highest; what it finds there is the floor for all other cells, and only cells that can reach it are met. No pair of a name and a key is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import as_table
from .ranking import placed

# What a normalised text is made of, and how alike two texts are at least of which one contains the other.
ALPHABET = " +-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTAINED = 0.92

#: Keys of a cell, cells (beyond them cells grow), and names that meet a cell's keys in one task, about.
CELL, MOST_CELLS, BLOCK = 1024, 65_536, 512
#: Numbers that pairs of characters are counted under.
PAIRS = 256
#: From this length on a text's frequent characters don't count in a sequence's similarity.
LONG = 200

_CODE = np.full(256, len(ALPHABET), np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_EPS = 1e-12


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Ratcliff-Obershelp similarity of each text of a with that of b, equal to the last bit to that of SequenceMatcher(None, a, b): twice the length of the equal blocks by both lengths, 1 for two empty texts.

    All pairs go through the search for the longest equal block together, then all that is left and right of these blocks, and so on. Texts b of LONG characters or more are left to SequenceMatcher.
    """
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.ones(len(n))
    short = m < LONG
    for k in np.flatnonzero(~short):
        out[k] = SequenceMatcher(None, a[k], b[k]).ratio()
    flat = [np.append(np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32), np.uint32(0)) for x in (a, b)]
    end_a, end_b = n.cumsum(), m.cumsum()
    work = np.stack([np.arange(len(n)), end_a - n, end_a, end_b - m, end_b], axis=1)[short]
    matched = np.zeros(len(n), np.int64)
    while len(work):
        work = work[(work[:, 1] < work[:, 2]) & (work[:, 3] < work[:, 4])]
        width = work[:, 2] - work[:, 1]
        order = np.argsort(width, kind="stable")
        work, width, left, at = work[order], width[order], [], 0
        while at < len(work):
            rows = min(len(work) - at, max(1, (1 << 20) // int(width[at])))
            while rows > 1 and rows * int(width[at + rows - 1]) > 1 << 21:
                rows //= 2
            part = work[at : at + rows]
            i, j, k = _longest(*flat, part)
            np.add.at(matched, part[:, 0], k)
            part, i, j, k = part[k > 0], i[k > 0], j[k > 0], k[k > 0]
            left += [np.stack([part[:, 0], part[:, 1], i, part[:, 3], j], axis=1), np.stack([part[:, 0], i + k, part[:, 2], j + k, part[:, 4]], axis=1)]
            at += rows
        work = np.concatenate(left) if left else work[:0]
    both = n + m
    ask = short & (both > 0)
    out[ask] = 2.0 * matched[ask] / both[ask]
    return out


def _longest(a: np.ndarray, b: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of the longest equal block within each row's ranges; of equal ones the first in a, then in b. Each row's part of a lies across, b's characters go by one at a time."""
    _, a0, a1, b0, b1 = part.T
    columns = a0[:, None] + np.arange(int((a1 - a0).max()))
    # an impossible character stands beyond a range's end
    own = np.where(columns < a1[:, None], a[np.minimum(columns, len(a) - 1)].astype(np.int64), -1)
    rows = np.arange(len(part))
    run = np.zeros((len(part), own.shape[1] + 1), np.int32)
    length, i, j = (np.zeros(len(part), np.int64) for _ in range(3))
    for y in range(int((b1 - b0).max())):
        at = b0 + y
        other = np.where(at < b1, b[np.minimum(at, len(b) - 1)].astype(np.int64), -2)
        run[:, 1:] = (run[:, :-1] + 1) * (own == other[:, None])
        end = run.argmax(axis=1)
        k = run[rows, end]
        start = end - k
        better = (k > length) | ((k == length) & (k > 0) & (start < i))
        length, i, j = np.where(better, k, length), np.where(better, start, i), np.where(better, at + 1 - k, j)
    return a0 + i, j, length


def _counts(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, counts of characters, counts of pairs of neighbours) of normalised texts."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(n)), n)
    code = _CODE[np.frombuffer("".join(texts).encode(), np.uint8)]
    letters = np.bincount(row * len(ALPHABET) + code, minlength=len(n) * len(ALPHABET)).reshape(-1, len(ALPHABET))
    same = row[1:] == row[:-1]
    pair = (code[:-1] * len(ALPHABET) + code[1:])[same] % PAIRS
    pairs = np.bincount(row[1:][same] * PAIRS + pair, minlength=len(n) * PAIRS).reshape(-1, PAIRS)
    return n, letters.astype(np.int32), pairs.astype(np.int32)


def _most(n: np.ndarray, m: np.ndarray, common: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """The similarity that texts of n and m characters have at most that share so many characters, and so many pairs of neighbours."""
    both = n + m
    matched = common if pairs is None else np.minimum(common, (pairs + both + 1) // 3)
    return np.where(both > 0, 2.0 * matched / np.maximum(both, 1), 1.0)


class _Profiles:
    """What is known of all cells, in order of cell: lengths, least and greatest counts, pairs that occur."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.sort_by("cell")
        self.cell = np.array(rows.column("cell").to_pylist(), np.int64)
        self.shortest, self.longest = (np.array(rows.column(c).to_pylist(), np.int64) for c in ("shortest", "longest"))
        widths = {"least": len(ALPHABET), "greatest": len(ALPHABET), "pairs": PAIRS}
        self.least, self.greatest, self.pairs = (np.array(rows.column(c).to_pylist(), np.int32).reshape(len(rows), w) for c, w in widths.items())

    def bounds(self, texts: Sequence[str]) -> np.ndarray:
        """(texts, cells): the similarity that any key of a cell can have."""
        n, letters, pairs = _counts(texts)
        out = np.empty((len(n), len(self.cell)))
        for k in range(len(n)):
            common = np.minimum(letters[k], self.greatest).sum(axis=1)
            # a key that is as long as what is in common makes the best of it
            m = np.clip(common, self.shortest, self.longest)
            shared = (pairs[k] * self.pairs).sum(axis=1)
            longest = np.minimum(common, m)
            # the second bound grows with a key's length more slowly than the length itself, so the shortest key has the highest
            second = np.where(n[k] + self.shortest > 0, 2.0 * ((shared + n[k] + self.shortest + 1) // 3 + 1) / np.maximum(n[k] + self.shortest, 1), 1.0)
            bound = np.minimum(_most(n[k], m, longest), second)
            holds = (self.least <= letters[k]).all(axis=1) & (self.shortest <= n[k])
            held = (self.greatest >= letters[k]).all(axis=1) & (self.longest >= n[k])
            out[k] = np.where(holds | held, np.maximum(bound, CONTAINED), bound)
        return out


_PROFILE = "cell long, shortest long, longest long, least array<int>, greatest array<int>, pairs array<int>"


def _profile(cell: pa.Table) -> pa.Table:
    n, letters, pairs = _counts(cell.column("key").to_pylist())
    row = {"cell": cell.column("cell")[0].as_py(), "shortest": int(n.min()), "longest": int(n.max()), "least": letters.min(axis=0).tolist(), "greatest": letters.max(axis=0).tolist(), "pairs": (pairs.max(axis=0) > 0).astype(int).tolist()}
    kinds = pa.schema([("cell", pa.int64()), ("shortest", pa.int64()), ("longest", pa.int64()), *((c, pa.list_(pa.int32())) for c in ("least", "greatest", "pairs"))])
    return pa.Table.from_pylist([row], kinds)


def best_of(texts: Sequence[str], floors: np.ndarray, keys: Sequence[str], models: Sequence[str]) -> list[tuple[int, int, float]]:
    """(text, key, similarity) of the most similar key of each text that reaches its floor; of equals the first by model. Keys are tried in order of their bounds, some of all texts at a time."""
    place = np.empty(len(models), np.int64)
    place[sorted(range(len(models)), key=lambda k: models[k])] = np.arange(len(models))
    m, key_letters, key_pairs = _counts(keys)
    found: list[tuple[int, int, float]] = []
    step = max(1, (1 << 22) // (len(keys) * len(ALPHABET)))
    for at in range(0, len(texts), step):
        some = texts[at : at + step]
        n, letters, pairs = _counts(some)
        common = np.minimum(letters[:, None], key_letters[None]).sum(axis=2)
        bound = np.maximum(_most(n[:, None], m[None], common), np.where(common >= np.minimum(n[:, None], m[None]), CONTAINED, 0.0))
        best, own = np.array(floors[at : at + step], float), np.full(len(some), -1)
        each = min(4, len(keys))
        while True:
            k = np.argpartition(-bound, each - 1, axis=1)[:, :each]
            r = np.repeat(np.arange(len(some)), each)
            k = k.ravel()
            open_ = bound[r, k] >= best[r] - _EPS
            if not open_.any():
                break
            r, k = r[open_], k[open_]
            shared = np.minimum(pairs[r], key_pairs[k]).sum(axis=1)
            most = _most(n[r], m[k], common[r, k], shared)
            inside = np.minimum(n[r], m[k])
            held = np.array([c and (some[x] in keys[y] or keys[y] in some[x]) for x, y, c in zip(r, k, (common[r, k] >= inside) & (shared >= inside - 1), strict=True)], bool)
            score = np.where(held, CONTAINED, 0.0)
            ask = most >= np.maximum(best[r], score) - _EPS
            score[ask] = np.maximum(score[ask], ratios([some[x] for x in r[ask]], [keys[y] for y in k[ask]]))
            bound[r, k] = -1.0
            order = np.lexsort((place[k], -score, r))
            first = order[np.unique(r[order], return_index=True)[1]]
            for x, y, s in zip(r[first], k[first], score[first], strict=True):
                if s > best[x] or (s == best[x] and (own[x] < 0 or place[y] < place[own[x]])):
                    best[x], own[x] = s, y
        found += [(at + x, int(own[x]), float(best[x])) for x in np.flatnonzero(own >= 0)]
    return found


class Catalog:
    """Models (model) as a table of cells (cell, key, model), and what is known of each cell. Models that are null are left out, repeated ones count once."""

    def __init__(self, models: DataFrame, cell: int = CELL) -> None:
        rows = models.where("model is not null").select("model").distinct().withColumn("key", X.normalized(F.col("model")))
        there = placed(rows, [F.col("key"), F.col("model")])
        size = F.lit(max(cell, -(-there.count() // MOST_CELLS)))
        self.table = as_table(there.select(F.floor((F.col("place") - 1) / size).cast("long").alias("cell"), "key", "model"), "catalog")
        # one row for each of at most MOST_CELLS cells
        self.profiles = _Profiles(self.table.groupBy("cell").applyInArrow(_profile, _PROFILE).toArrow())
        self.size = len(self.profiles.cell)

    def reached(self, names: DataFrame, shared: Broadcast, first: bool) -> DataFrame:
        """names (name, text, floor) with the cell that bounds them highest, or with all others that can reach the floor."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            step = max(1, (1 << 22) // len(known.cell))
            for whole in batches:
                for at in range(0, len(whole), step):
                    batch = whole.slice(at, step)
                    bound = known.bounds(batch.column(1).to_pylist())
                    top = bound.argmax(axis=1)
                    floor = np.array(batch.column(2).to_pylist(), float)
                    rows = np.arange(len(top))
                    if not first:
                        bound[rows, top] = -1.0
                        rows, top = np.nonzero(bound >= floor[:, None] - _EPS)
                    else:
                        rows = np.flatnonzero(bound[rows, top] >= floor - _EPS)
                        top = top[rows]
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(known.cell[top])], ["name", "text", "floor", "cell"])

        return names.select("name", "text", "floor").mapInArrow(run, "name string, text string, floor double, cell long")

    def met(self, reached: DataFrame) -> DataFrame:
        """(name, model, similarity): the best of each cell that a name meets, if it reaches the floor. Names of a cell come in blocks, so that one that many names meet is many tasks."""
        turns = reached.groupBy("cell").agg(F.expr(f"1 + count(*) div {BLOCK}").alias("turns"))
        keys = self.table.join(turns, "cell").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).select("cell", "turn", "key", "model")
        names = reached.join(turns, "cell").withColumn("turn", F.pmod(F.xxhash64("name"), F.col("turns"))).select("cell", "turn", "name", "text", "floor")

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            name, models = a.column("name").to_pylist(), b.column("model").to_pylist()
            found = best_of(a.column("text").to_pylist(), np.array(a.column("floor").to_pylist(), float), b.column("key").to_pylist(), models) if name and models else []
            return pa.table([pa.array([name[x] for x, _, _ in found], pa.string()), pa.array([models[y] for _, y, _ in found], pa.string()), pa.array([s for _, _, s in found], pa.float64())], ["name", "model", "similarity"])

        return names.groupBy("cell", "turn").cogroup(keys.groupBy("cell", "turn")).applyInArrow(run, "name string, model string, similarity double")


def best_names(candidates: DataFrame, catalog: DataFrame, least: float = 0.6, cell: int = CELL) -> DataFrame:
    """(name, model, similarity): of each distinct name the most similar of all catalog models, the first by name of equals; names without one of `least` (above 0) aren't returned.

    candidates have (name), catalog (model); other columns don't matter. Similarity is that of the normalised texts as sequences, 0.92 at least if one contains the other; an empty text is contained in all. Exact
    for catalogs of any size. Nulls are left out, repeated rows count once, and an empty table of either kind gives an empty one.
    """
    index = Catalog(catalog, cell)
    empty = candidates.select(F.col("name").cast("string").alias("name"), F.lit(None).cast("string").alias("model"), F.lit(0.0).alias("similarity")).where(F.lit(False))
    if not index.size:
        return empty
    shared = candidates.sparkSession.sparkContext.broadcast(index.profiles)
    names = candidates.where("name is not null").select("name").distinct().withColumn("text", X.normalized(F.col("name")))
    start = names.withColumn("floor", F.lit(float(least)))
    if index.size == 1:
        return index.met(as_table(index.reached(start, shared, True), "asked"))
    names = as_table(names, "names")
    start = names.withColumn("floor", F.lit(float(least)))
    found = as_table(index.met(as_table(index.reached(start, shared, True), "asked")), "floors")
    floors = names.join(found.select("name", "similarity"), "name", "left").withColumn("floor", F.coalesce("similarity", F.lit(float(least))))
    others = index.met(as_table(index.reached(floors, shared, False), "asked"))
    return found.union(others).groupBy("name").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "model")).alias("b")).select("name", "b.model", (-F.col("b.s")).alias("similarity"))
