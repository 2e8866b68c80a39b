"""Min-max hashing: near duplicates by signatures that keep both the least and the greatest value of a set under each permutation.

Either end agrees for two sets with a probability of their Jaccard similarity, so one permutation gives two signature values; and as a shingle that only one set
has can't be at both ends, the two values of a permutation vary less together than two independent ones.

On Spark:

1. A pass over the texts hashes each document's shingles. Documents of one shingle set are one *class*. A class has a signature of 2 * PERMUTATIONS values, kept as
   a hash for each band (RULES) and a sketch: the last byte of each value.
2. Bands are grouped as (band hash, class) rows: partial aggregation gives each group's size, its first and its last class. Each member is paired with these two, which is linear in
   the group, however large. Pairs that their sizes and sketches don't rule out are confirmed on the full sets, and joined into components. ROUNDS more times, the members of a group that
   aren't in its largest component are paired with one of those that are, another one for each band: most of what links is one component then.
3. Groups may still have members in several components. The largest of these is the group's core; a *family* is a core's component and all members outside it of all groups with that core. Core
   classes needn't meet each other; shares of them, and of the others, meet in tasks. First with sketches, which tells the members that have any likely partner; then those with
   their full sets, which are compared in the task. What comes out are members, and then links: never the likely pairs, whose number grows with the square of a family.

A band of ROWS values misses a pair at the threshold with probability 1 - s**ROWS; all bands together with under 1e-9. A sketch is let through down to a number of
equal values that such a pair falls short of with under 1e-9. Everything else is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .ngram_join import _sets

#: Each gives two values to the sketch; the first ones also give them to the bands.
PERMUTATIONS = 128
#: Permutations in a band, at most: each with both ends.
ROWS = 2
#: How often members outside a group's largest component are paired with one inside.
ROUNDS = 1
#: The chance that a pair at the threshold is missed by all bands, or by the sketch, is under this.
MISSED = 1e-9
#: Members of a family in a share, about, and bytes of their full sets; two shares meet in one task.
SHARE, SHARE_BYTES = 2048, 4 << 20
#: log2 of the bits in the table of classes whose sets are wanted: 8 MB, whatever the input's size.
BITS = 26
#: Bytes of pairs with both sets in a batch.
PROBED = 16 << 20

_FACTORS = C.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def bands_for(percent: int, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """(permutations in a band, bands): as long bands and then as few as leave pairs at the threshold a chance under MISSED to be in no band together."""
    for n in range(ROWS, 0, -1):
        bands = math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** (2 * n)))) if percent < 100 else 1
        if n * bands <= permutations:
            return n, bands
    return 1, permutations


def least_equal(percent: int, values: int = 2 * PERMUTATIONS) -> int:
    """The most equal values that a pair at the threshold has fewer than with a chance under MISSED."""
    s, below = percent / 100, 0.0
    for k in range(values + 1):
        below += math.comb(values, k) * s**k * (1 - s) ** (values - k)
        if below >= MISSED:
            return k
    return values


def signatures(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(sets, 2 * PERMUTATIONS): least and greatest value of each set under each permutation. Sets are not empty and lie one after the other."""
    out = np.empty((len(begin), 2 * PERMUTATIONS), np.uint64)
    for k, factor in enumerate(_FACTORS):
        # multiplication by an odd number permutes the 64-bit hashes
        value = grams * factor
        out[:, 2 * k] = np.minimum.reduceat(value, begin)
        out[:, 2 * k + 1] = np.maximum.reduceat(value, begin)
    return out


def band_hashes(signature: np.ndarray, permutations: int, bands: int) -> np.ndarray:
    """(sets, bands): one hash for the values of each band."""
    width = 2 * permutations
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), np.uint64(b + 1))
        for v in range(width):
            h = C.mix(h * C._M1 ^ signature[:, b * width + v])
        out[:, b] = h
    return out


def _class_of(grams: np.ndarray, text: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, set size) of each text: a hash of its whole set."""
    n = np.bincount(text, minlength=rows).astype(np.int32)
    total = np.zeros(rows, np.uint64)
    np.add.at(total, text, C.mix(grams ^ np.uint64(0x5A5A)))
    return C.mix(total + n.astype(np.uint64)), n


def _once(class_id: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first text of each class that has shingles."""
    first = np.zeros(len(n), bool)
    first[np.unique(class_id, return_index=True)[1]] = True
    return np.flatnonzero(first & (n > 0))


_DOCUMENTS = "doc_id long, text_key long, class long, n int, bands binary, sketch binary"


def _describe(width: int, permutations: int, n_bands: int):
    """Each document's class and set size; once for each class of a slice also its bands and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, 2):
            grams, text = _sets(*C.utf8(batch.column(2)), width)
            class_id, n = _class_of(grams, text, len(batch))
            chosen = _once(class_id, n)
            bands, sketches = [None] * len(batch), [None] * len(batch)
            if len(chosen):
                mine = np.zeros(len(batch), bool)
                mine[chosen] = True
                size = n[chosen].astype(np.int64)
                made = signatures(grams[mine[text]], np.cumsum(size) - size)
                for k, b, s in zip(chosen.tolist(), band_hashes(made, permutations, n_bands), (made >> np.uint64(20)).astype(np.uint8), strict=True):
                    bands[k], sketches[k] = b.tobytes(), s.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), C.signed(class_id), pa.array(n), pa.array(bands, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "text_key", "class", "n", "bands", "sketch"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, class, n) for each band of each class."""
    for batch in batches:
        if not len(batch):
            continue
        band = np.stack([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)])
        own, n = (np.repeat(np.asarray(batch.column(k)), band.shape[1]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(band.ravel()), pa.array(own), pa.array(n)], ["band", "class", "n"])


def _could(percent: int, least: int):
    """Of pairs with sizes and sketches (a, b, n, m, x, y) those that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n, m = (np.asarray(batch.column(k), np.int64) for k in (2, 3))
            x, y = (np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column(k)]) for k in (4, 5))
            keep = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((x == y).sum(axis=1) >= least)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _unsettled(members: DataFrame, seed: int) -> DataFrame:
    """(band, main, rep, most, size) of the groups of members (band, class, n, comp) that are in several components: the largest one and one of its members, its size and the group's."""
    sizes = members.groupBy("band", "comp").agg(F.count("*").alias("c"), F.min_by("class", F.xxhash64("class", "band", F.lit(seed))).alias("rep"))
    groups = sizes.groupBy("band").agg(F.max_by(F.struct("comp", "rep"), F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("size"), F.count("*").alias("comps"))
    return groups.where("comps > 1").select("band", F.col("main.comp").alias("main"), F.col("main.rep").alias("rep"), "most", "size")


def _families(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(family, class, n, comp) of the groups of members (band, class, n, comp) in several components; classes is (class, n, comp) of all classes. A core's comp is its family."""
    outside = members.join(_unsettled(members, 0).select("band", F.col("main").alias("family")), "band").where("comp <> family").select("family", "class", "n", "comp").distinct()
    core = classes.join(outside.select(F.col("family").alias("comp")).distinct(), "comp").select(F.col("comp").alias("family"), "class", "n", "comp")
    return outside.union(core)


def _cells(family: DataFrame, share: int) -> DataFrame:
    """(family, low, high, class, n, comp, share) for each member (family, class, n, comp) in each cell where it meets others.

    The core's shares are numbered from -1 downward and meet those of the others, which are numbered from 0 and meet each other too.
    """
    core = F.col("comp") == F.col("family")
    shares = lambda test: F.expr(f"1 + greatest(sum(if({test}, 1, 0)) div {share}, sum(if({test}, n, 0)) * 8 div {SHARE_BYTES})")
    sizes = family.groupBy("family").agg(shares("comp = family").alias("cores"), shares("comp <> family").alias("others"))
    met = family.join(sizes, "family")
    dealt = F.xxhash64("class")
    met = met.withColumn("share", F.when(core, -1 - F.pmod(dealt, F.col("cores"))).otherwise(F.pmod(dealt, F.col("others"))))
    rest = F.sequence(F.lit(0).cast("long"), F.col("others") - 1)
    main = F.sequence(-F.col("cores"), F.lit(-1).cast("long"))
    met = met.withColumn("with", F.explode(F.when(core, rest).otherwise(F.concat(main, rest))))
    return met.select("family", F.least("share", "with").alias("low"), F.greatest("share", "with").alias("high"), "class", "n", "comp", "share")


_CELL = ["family", "low", "high", "class", "n", "comp", "share"]


def _likely(rows: dict[str, np.ndarray], percent: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each member of a cell the members of other components that can link with it; each pair once."""
    one = rows["share"] == rows["low"]
    within = rows["low"][0] == rows["high"][0]
    left, right = (np.flatnonzero(one),) * 2 if within else sorted((np.flatnonzero(one), np.flatnonzero(~one)), key=len)
    sketch = rows["sketch"]
    for i in left:
        other = right[right > i] if within else right
        n, m = int(rows["n"][i]), rows["n"][other].astype(np.int64)
        other = other[(rows["comp"][other] != rows["comp"][i]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))]
        other = other[(sketch[other] == sketch[i]).sum(axis=1) >= least]
        if len(other):
            yield i, other


def _each_cell(batches: Iterator[pa.RecordBatch], more: list[str]) -> Iterator[dict]:
    """The rows of each cell of over one member: arrays, sketches as a matrix, full sets (if asked for) as a list. A cell's rows come one after the other."""

    def taken(rows: list[pa.RecordBatch]) -> dict | None:
        batch = pa.concat_batches(rows)
        if len(batch) < 2:
            return None
        out = {c: np.asarray(batch.column(c)) for c in _CELL} | {"sketch": np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column("sketch")])}
        return out | {c: [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in more}

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([np.asarray(batch.column(c)) for c in _CELL[:3]])
        if held and (np.array([held[-1].column(c)[0].as_py() for c in _CELL[:3]]) != key[:, 0]).any():
            yield taken(held)
            held = []
        cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        for i, j in zip(cut, [*cut[1:], len(batch)], strict=True):
            if i:
                yield taken(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield taken(held)


def _hopeful(percent: int, least: int):
    """(family, class): members with any likely partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_cell(batches, []):
            if rows is None:
                continue
            hope = np.zeros(len(rows["n"]), bool)
            for i, other in _likely(rows, percent, least):
                hope[i] = True
                hope[other] = True
            if hope.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows["family"][hope]), pa.array(rows["class"][hope])], ["family", "class"])

    return run


def _met(percent: int, least: int):
    """(a, b): members of different components that link on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_cell(batches, ["grams"]):
            if rows is None:
                continue
            a, b = [], []
            for i, other in _likely(rows, percent, least):
                own, sets = rows["grams"][i], [rows["grams"][k] for k in other]
                all_ = np.concatenate(sets)
                size = np.array([len(x) for x in sets])
                hit = own[np.minimum(np.searchsorted(own, all_), len(own) - 1)] == all_
                common = np.bincount(np.repeat(np.arange(len(sets)), size), hit, len(sets)).astype(np.int64)
                linked = other[100 * common >= percent * (len(own) + size - common)]
                a.append(np.full(len(linked), rows["class"][i]))
                b.append(rows["class"][linked])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _wanted_sets(width: int, table):
    """(class, grams): the sets of classes whose bit is in the table, once for each slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in C.slices(batches, 0):
            grams, text = _sets(*C.utf8(batch.column(0)), width)
            class_id, n = _class_of(grams, text, len(batch))
            bit = class_id >> np.uint64(64 - BITS)
            hit = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
            chosen = _once(class_id, np.where(hit, n, 0))
            chosen = chosen[hit[chosen]]
            begin, end = np.searchsorted(text, chosen), np.searchsorted(text, chosen, "right")
            yield pa.RecordBatch.from_arrays([C.signed(class_id[chosen]), pa.array([grams[i:j].tobytes() for i, j in zip(begin, end, strict=True)], pa.binary())], ["class", "grams"])

    return run


def _confirm(percent: int):
    """Of pairs with their full sets (a, b, x, y), each sorted, those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                shared = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def minmax_dedup(docs: DataFrame, width: int = 3, percent: int = 85, share: int = SHARE) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, class_id, component_class, text_key.

    Words are what stands between spaces, A-Z lower-cased; a document's set are its distinct runs of `width` words, or all its words as one if fewer. Documents
    link if 100 * shared >= percent * all, decided on the full sets; component_id is the smallest doc_id that links reach, kept whether it is the row's own. Null
    and empty texts: 0 shingles, their own component, kept. Repeated rows: each is returned, with the same component. A null doc_id takes part in links, but names
    no component; its row is kept only where no link reaches a doc_id. doc_id is read as a 64-bit number. Other columns are left aside. An empty table gives an empty one. Texts of any length are read whole.
    Hashes have 64 bits. `share` changes the plan only.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50, up to 100")
    spark = docs.sparkSession
    (permutations, bands), least = bands_for(percent), least_equal(percent)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    described = C.as_table(docs.mapInArrow(_describe(width, permutations, bands), _DOCUMENTS), "minmax-documents")
    documents = described.select("doc_id", "text_key", "class", "n")
    classes = C.as_table(described.where("bands is not null").groupBy("class").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "minmax-classes")
    members = classes.select("class", "n", "bands").mapInArrow(_members, "band long, class long, n int")
    groups = members.groupBy("band").agg(F.count("*").alias("size"), F.min("class").alias("first"), F.max("class").alias("last")).where("size > 1")
    groups = C.as_table(groups, "minmax-groups")

    sets = _Sets(docs, width, percent)
    sketched = classes.select("class", "n", "sketch")
    one, two = sketched.toDF("a", "n", "x"), sketched.toDF("b", "m", "y")

    def likely(pairs: DataFrame) -> DataFrame:
        """Of pairs (class, end) those that can link, once each, as (a, b)."""
        pairs = pairs.where("class <> end").select(F.least("class", "end").alias("a"), F.greatest("class", "end").alias("b")).distinct()
        return C.as_table(pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_could(percent, least), "a long, b long"), "minmax-pairs")

    comps = C.connected_components(sets.links(likely(members.join(groups, "band").select("class", F.explode(F.array("first", "last")).alias("end")))))

    def settled(links: DataFrame) -> DataFrame:
        return comps if links.isEmpty() else C.connected_components(links.union(comps.selectExpr("v as a", "label as b").where("a <> b")))

    def placed() -> DataFrame:
        """Members of the groups with their components."""
        return members.join(groups.select("band"), "band").join(comps.withColumnsRenamed({"v": "class", "label": "comp"}), "class", "left").withColumn("comp", F.coalesce("comp", "class"))

    for seed in range(1, ROUNDS + 1):
        own = placed()
        comps = settled(sets.links(likely(own.join(_unsettled(own, seed), "band").where("comp <> main").select("class", F.col("rep").alias("end")))))
    labels = comps.withColumnsRenamed({"v": "class", "label": "comp"})
    family = C.as_table(_families(placed(), classes.select("class", "n").join(labels, "class", "left").withColumn("comp", F.coalesce("comp", "class"))), "minmax-families")
    parts = min(C.deals_for(docs), C.MOST_PARTS)
    cell = ["family", "low", "high"]
    sketches = classes.select("class", "sketch")
    dealt = lambda rows: rows.repartition(parts, *cell).sortWithinPartitions(*cell)
    hopeful = dealt(_cells(family, share).join(sketches, "class")).mapInArrow(_hopeful(percent, least), "family long, class long").distinct()
    hopeful = C.as_table(hopeful.join(family, ["family", "class"]).select("family", "class", "n", "comp"), "minmax-hopeful")
    full = dealt(_cells(hopeful, share).join(sketches, "class").join(sets.of(hopeful.select("class").distinct()), "class"))
    with C.batch_bytes(spark, PROBED):
        comps = settled(C.as_table(full.mapInArrow(_met(percent, least), "a long, b long").distinct(), "minmax-links"))

    by_class = documents.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    # classes of one row that link with nothing name themselves
    named = by_class.join(comps.withColumnRenamed("v", "class"), "class", "left").where("copies > 1 or label is not null")
    named = C.as_table(named.select("class", "least", "copies", F.coalesce("label", "class").alias("label")), "minmax-names")
    by_label = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    named = C.looked_up(named, by_label, "label", "classes", "class").select("class", "component_id", "label", "copies", F.lit(True).alias("named"))
    out = C.looked_up(documents, named, "class", "copies", "text_key")
    component = F.when((F.col("n") > 0) & F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("class").alias("class_id"), F.coalesce("label", "class").alias("component_class"), "text_key")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


class _Sets:
    """Full sets of the classes that are asked for: made from the texts again, in a pass for those that no earlier pass has made."""

    def __init__(self, docs: DataFrame, width: int, percent: int) -> None:
        self.docs, self.width, self.percent, self.made = docs, width, percent, []

    def of(self, wanted: DataFrame) -> DataFrame:
        """(class, grams) of the classes in wanted (class), and of some others."""
        for table in self.made:
            wanted = wanted.join(table.select("class"), "class", "left_anti")
        spark = self.docs.sparkSession
        table = C.bit_table(wanted.select(F.shiftrightunsigned("class", 64 - BITS).alias("bit")), BITS)
        if table.any():
            sets = self.docs.select("text").mapInArrow(_wanted_sets(self.width, spark.sparkContext.broadcast(table)), "class long, grams binary")
            for before in self.made:
                # others of the same bit may be there already
                sets = sets.join(before.select("class"), "class", "left_anti")
            # copies of a class in several slices are alike
            self.made.append(C.as_table(sets.groupBy("class").agg(F.first("grams").alias("grams")), "minmax-sets"))
        out = self.made[0] if self.made else spark.createDataFrame([], "class long, grams binary")
        for more in self.made[1:]:
            out = out.union(more)
        return out

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that link on their full sets."""
        sets = self.of(pairs.select(F.explode(F.array("a", "b")).alias("class")))
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        with C.batch_bytes(pairs.sparkSession, PROBED):
            return C.as_table(both.mapInArrow(_confirm(self.percent), "a long, b long"), "minmax-links")
