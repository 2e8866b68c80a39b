"""N-gram Jaccard join: documents whose word-shingle sets overlap enough, by T-occurrence search.

How it runs on Spark:

1. A first pass over the texts hashes every shingle. A document's *class* is the signature of its shingle set, so
   exact copies are one class from here on. The pass also finds hot shingles (fewer than HOT, each over a HOT-th of all): they
   are too common to be counted in one place.
2. A second pass deals the (shingle, class) postings out by shingle, hot ones by shingle and class. Each inverted list gives
   its length (the shingle's document frequency; that of a hot one is known). Lists of one class can never yield a match and end here; the others go back to their class.
3. A class orders its shingles by frequency, rarest first. With t = threshold, two sets of sizes n and m match only
   if they share T = ceil(t/(1+t) * (n+m)) shingles. DivideSkip: the ceil(t*n)-1 most frequent shingles are the long lists,
   which are probed only; the rest are the short lists, which are merged. A class that has no shared shingle
   in its short lists has no match at all and is left out.
4. Short lists are dealt out by shingle, those of over SHARE classes in shares. First, each share pairs its members with the member before and with the
   first one (linear in the list, however long), and some members of all shares meet in one more; pairs are verified by binary probes and joined into
   components. Then the lists whose members are in several components pair members of different components, share by share; every class's lists are merged with
   a heap, and classes that occur in at least T - L short lists (L long lists: the greater number of the two) are probed in the long lists. A group of g near copies thus
   costs O(g), and no link between different components is lost: the components are exact.

Deals are as many as the texts' size asks for, and a task holds one at a time, so what it holds doesn't grow with the input.
Hashes have 64 bits. Documents with null or empty text have no shingles and link with nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Separators of words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A shingle with over a HOT-th of all postings is hot; by arithmetic there are fewer than HOT.
HOT = 1 << 14
#: Classes in a share of an inverted list, about; and of how many one goes to the share where all shares meet, at most.
SHARE, MEET = 4096, 512
#: Bytes of pairs with both classes' shingles in a batch, and of lists in one.
PROBED, MERGED = 16 << 20, 8 << 20


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least shared shingles of sets of sizes n and m: 100 * shared >= percent * (n + m - shared)."""
    return -(-percent * (n + m) // (100 + percent))


def _short(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n shingles are short lists: all but the ceil(t*n)-1 most frequent ones."""
    return n + (-percent * n // 100) + 1


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, index of their text), distinct and sorted within each text."""
    is_word, same = C.byte_table(SPACES)
    grams, texts = [], []
    for i, j in C.steps(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = C.word_bounds(part, at, is_word)
        words = C.word_hashes(part, starts, ends, same)
        n = np.diff(first)
        where, text = C.inner_grams(first, width)
        found, owner = [C.gram_hashes(words, width)[where]] if len(where) else [], [text] if len(where) else []
        for k in range(1, width):
            few = np.flatnonzero(n == k)
            if len(few):
                found.append(C.gram_hashes(words, k)[first[few]])
                owner.append(few)
        if found:
            g, t = np.concatenate(found), np.concatenate(owner)
            order = np.lexsort((g, t))
            g, t = g[order], t[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
            grams.append(g[new])
            texts.append(t[new] + i)
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(grams), np.concatenate(texts)


_PACKED = "deal int, kind int, a binary, b binary, c binary"


def _packed(kind: int, deal: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> Iterator[tuple]:
    """Rows for each partition that these arrays are dealt to."""
    if not len(deal):
        return
    order = np.argsort(deal, kind="stable")
    deal, a, b, c = deal[order], a[order], b[order], c[order]
    cut = np.flatnonzero(np.r_[True, deal[1:] != deal[:-1]])
    for i, j in zip(cut, [*cut[1:], len(deal)], strict=True):
        yield int(deal[i]), kind, a[i:j].tobytes(), b[i:j].tobytes(), c[i:j].tobytes()


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 4096], strict=True), types, strict=True)], names)


_PACKED_NAMES, _PACKED_TYPES = ["deal", "kind", "a", "b", "c"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _hashed(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class and set size of each text; shingles, their class and set size: once for each class of these texts)."""
    grams, text = _sets(*C.utf8(column), width)
    n = np.bincount(text, minlength=len(column)).astype(np.int32)
    class_id = np.zeros(len(column), np.uint64)
    np.add.at(class_id, text, C.mix(grams ^ np.uint64(0xA5A5)))
    class_id = C.mix(class_id + n.astype(np.uint64))
    _, once = np.unique(class_id, return_index=True)
    keep = np.zeros(len(column), bool)
    keep[once] = True
    mine = keep[text]
    return class_id, n, grams[mine], class_id[text[mine]], n[text[mine]]


_DOCUMENTS = "doc_id long, text_key long, class long, n int, grams binary, counts binary"


def _describe(width: int):
    """Each document's class and set size; the first row of a slice also has the shingles that are common in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, 2):
            class_id, n, grams, _, _ = _hashed(batch.column(2), width)
            gram, count = np.unique(grams, return_counts=True)
            often = (count > 1) & (count * (2 * HOT) >= len(grams))
            first = lambda x: pa.array([x.tobytes(), *[None] * (len(batch) - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), C.signed(class_id), pa.array(n), first(gram[often]), first(count[often].astype(np.int64))], ["doc_id", "text_key", "class", "n", "grams", "counts"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for gram, count in zip(*batch.columns, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(gram.as_buffer(), np.int64)), pa.array(np.frombuffer(count.as_buffer(), np.int64))], ["gram", "n"])


def _scan(width: int, parts: int, hot: np.ndarray, hot_df: np.ndarray):
    """Postings by shingle (kind 1), those of hot shingles by shingle and class, with their list's length (kind 2)."""
    ends = np.append(hot, np.uint64(0xFFFFFFFFFFFFFFFF))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, 0):
            _, _, grams, owner, n = _hashed(batch.column(0), width)
            at = np.searchsorted(hot, grams)
            known = (ends[at] == grams) & (at < len(hot))
            cold = ~known
            rows = [*_packed(1, (C.mix(grams[cold]) % np.uint64(parts)).astype(np.int32), grams[cold], owner[cold], n[cold])]
            both = n[known].astype(np.int64) << 32 | hot_df[at[known]]
            rows += _packed(2, (C.mix(grams[known] ^ owner[known]) % np.uint64(parts)).astype(np.int32), grams[known], owner[known], both)
            yield from _rows(rows, _PACKED_NAMES, _PACKED_TYPES)

    return run


def _once(gram: np.ndarray, owner: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings by shingle and class, each once."""
    order = np.lexsort((owner, gram))
    gram, owner, more = gram[order], owner[order], more[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[new], owner[new], more[new]


def _frequencies(parts: int):
    """Inverted lists: drops those of one class, gives the others' length back to each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for deal in C.each_deal(batches):
            yield from one(deal)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {1: ([], [], []), 2: ([], [], [])}
        for batch in batches:
            for kind, *arrays in zip(np.asarray(batch.column(1)).tolist(), *batch.columns[2:], strict=True):
                for part, x in zip(held[kind], arrays, strict=True):
                    part.append(x.as_buffer())
        joined = lambda kind, *types: [np.concatenate([np.frombuffer(x, t) for x in p] or [np.zeros(0, t)]) for p, t in zip(held.pop(kind), types, strict=True)]
        gram, owner, n = _once(*joined(1, np.uint64, np.uint64, np.int32))
        cut = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
        long = np.diff(np.r_[cut, len(gram)])
        df = np.repeat(long, long)
        keep = df > 1
        both = n[keep].astype(np.int64) << 32 | np.minimum(df[keep], 0x7FFFFFFF)
        gram, owner = gram[keep], owner[keep]
        yield from _rows([*_packed(1, (owner % np.uint64(parts)).astype(np.int32), gram, owner, both)], _PACKED_NAMES, _PACKED_TYPES)
        gram, owner, both = _once(*joined(2, np.uint64, np.uint64, np.int64))
        yield from _rows([*_packed(1, (owner % np.uint64(parts)).astype(np.int32), gram, owner, both)], _PACKED_NAMES, _PACKED_TYPES)

    return run


_CLASSES = "class long, n int, n_short int, grams binary, shares binary"


def _classes(percent: int, share: int):
    """The classes that can match: their shared shingles by frequency, the first n_short of them short lists, and into how many shares each of these lists is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for deal in C.each_deal(batches):
            yield from one(deal)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["class", "n", "n_short", "grams", "shares"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        gram, owner, both = [], [], []
        for batch in batches:
            for a, b, c in zip(*batch.columns[2:], strict=True):
                gram.append(np.frombuffer(a.as_buffer(), np.uint64))
                owner.append(np.frombuffer(b.as_buffer(), np.uint64))
                both.append(np.frombuffer(c.as_buffer(), np.int64))
        if not gram:
            return
        gram, owner, both = np.concatenate(gram), np.concatenate(owner), np.concatenate(both)
        df, n = both & 0xFFFFFFFF, both >> 32
        order = np.lexsort((gram, df, owner))
        gram, owner, n, df = gram[order], owner[order], n[order], df[order]
        cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        shared = np.diff(np.r_[cut, len(owner)])
        size = n[cut]
        short = _short(size, percent) - (size - shared)
        shares = (1 + df // share).astype(np.int32)
        rows = []
        for k in np.flatnonzero(short > 0):
            i = cut[k]
            rows.append((int(owner[i].view(np.int64)), int(size[k]), int(short[k]), gram[i : i + shared[k]].tobytes(), shares[i : i + short[k]].tobytes()))
            if len(rows) == 4096:
                yield from _rows(rows, names, types)
                rows = []
        yield from _rows(rows, names, types)

    return run


def _short_lists(meet: bool):
    """(gram, class, n, comp, shares, share) for each short list that a class is in; with `meet`, some classes of each share of a list once more, in share -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = np.asarray(batch.column(2), np.int64)
            if not len(short):
                continue
            gram = np.concatenate([np.frombuffer(x.as_buffer(), np.int64)[:k] for x, k in zip(batch.column(3), short, strict=True)])
            shares = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(5)])
            own, n, comp = (np.repeat(np.asarray(batch.column(k)), short) for k in (0, 1, 4))
            dealt = C.mix(own.view(np.uint64))
            share = (dealt % shares.astype(np.uint64)).astype(np.int32)
            if meet:
                more = np.flatnonzero((shares > 1) & ((dealt >> np.uint64(32)) % np.minimum(shares, MEET).astype(np.uint64) == 0))
                gram, own, n, comp, shares = (np.r_[x, x[more]] for x in (gram, own, n, comp, shares))
                share = np.r_[share, np.full(len(more), -1, np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (gram, own, n, comp, shares, share))], ["gram", "class", "n", "comp", "shares", "share"])

    return run


def _lists(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each group of `key`, whose rows come one after the other: classes, sizes, components, shares; by component and class."""
    columns = [*key, "class", "n", "comp", "share"]
    left = None
    for batch in batches:
        now = {c: np.asarray(batch.column(c)) for c in columns}
        if left is not None:
            now = {c: np.r_[left[c], now[c]] for c in columns}
        if not len(now["n"]):
            continue
        new = np.zeros(len(now["n"]), bool)
        new[0] = True
        for c in key:
            new[1:] |= now[c][1:] != now[c][:-1]
        cut = np.flatnonzero(new)
        yield from _groups({c: v[: cut[-1]] for c, v in now.items()}, cut)
        left = {c: v[cut[-1] :] for c, v in now.items()}
    if left is not None:
        yield from _groups(left, np.array([0, len(left["n"])]))


def _groups(rows: dict[str, np.ndarray], cut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        if j - i > 1:
            owner, n, comp, share = (rows[c][i:j] for c in ("class", "n", "comp", "share"))
            order = np.lexsort((owner, comp))
            yield owner[order], n[order], comp[order], share[order]


def _chain(percent: int):
    """Pairs of each share's members with the one before and with the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for owner, n, _, _ in _lists(batches, ["gram", "share"]):
            for x, y in ((slice(None, -1), slice(1, None)), (slice(0, 1), slice(2, None))):
                fits = 100 * np.minimum(n[x], n[y]).astype(np.int64) >= percent * np.maximum(n[x], n[y]).astype(np.int64)
                a.append(np.broadcast_to(owner[x], fits.shape)[fits])
                b.append(owner[y][fits])
        if a:
            pair = np.unique(np.stack([np.minimum(x := np.concatenate(a), y := np.concatenate(b)), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    return run


def _postings(percent: int):
    """Of each two shares of a list (or one) and each class in them: the classes of other components that follow it and fit in size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["a", "n", "others", "sizes"], [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        rows, held = [], 0
        for owner, n, comp, share in _lists(batches, ["gram", "low", "high"]):
            after = np.searchsorted(comp, comp, "right")
            one = share.min() == share.max()
            for i in np.flatnonzero(after < len(comp)):
                o, m = owner[after[i] :], n[after[i] :]
                fits = 100 * np.minimum(m, n[i]).astype(np.int64) >= percent * np.maximum(m, n[i]).astype(np.int64)
                if not one:
                    fits &= share[after[i] :] != share[i]
                if fits.any():
                    o, m = o[fits], m[fits]
                    by = np.argsort(o)
                    rows.append((owner[i], n[i], o[by], m[by]))
                    held += len(o)
                    if held > 1 << 20:
                        yield from _rows(rows, names, types)
                        rows, held = [], 0
        yield from _rows(rows, names, types)

    return run


def _ascending(ids: np.ndarray) -> Iterator[int]:
    """An ascending list's members, a part of it as Python numbers at a time."""
    for k in range(0, len(ids), 1024):
        yield from ids[k : k + 1024].tolist()


def _merge(percent: int):
    """T-occurrence: merges a class's short lists with a heap; keeps what occurs in at least T - L of them, L the greater number of long lists. Lists stay arrays of one class at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, lists = None, 0, []

        def found() -> Iterator[pa.RecordBatch]:
            if not lists:
                return
            ids = np.concatenate([x for x, _ in lists])
            known, at = np.unique(ids, return_index=True)
            m = np.concatenate([x for _, x in lists])[at].astype(np.int64)
            # both follow one order, so what they share outside both prefixes is in the one's long lists or in the other's
            probed = np.maximum(-(-percent * size // 100) - 1, -(-percent * m // 100) - 1)
            least = np.maximum(1, -(-percent * (size + m) // (100 + percent)) - probed)
            kept, k, times, place = [], None, 0, -1
            for x in heapq.merge(*(_ascending(x) for x, _ in lists)):
                if x != k:
                    k, times, place = x, 0, place + 1
                times += 1
                if times == least[place]:
                    kept.append(k)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), now, np.int64)), pa.array(kept, pa.int64())], ["a", "b"])

        for batch in batches:
            owner, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            values = [(np.asarray(c.values), np.asarray(c.offsets)) for c in batch.columns[2:]]
            for k, a in enumerate(owner.tolist()):
                if a != now:
                    yield from found()
                    now, size, lists = a, int(n[k]), []
                lists.append(tuple(v[o[k] : o[k + 1]].copy() for v, o in values))
        yield from found()

    return run


def _probe(percent: int):
    """Binary probes of one class's shared shingles in the other's; keeps the pairs that overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = batch.columns
            keep = []
            for n1, n2, one, two in zip(n.to_pylist(), m.to_pylist(), x, y, strict=True):
                p, q = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                if 100 * len(p) < percent * (n1 + n2 - len(p)):
                    keep.append(False)
                    continue
                q = np.sort(q)
                shared = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(100 * shared >= percent * (n1 + n2 - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return run


def ngram_jaccard_join(docs: DataFrame, width: int = 5, percent: int = 75, share: int = SHARE) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, class_id, component_class, text_key.

    Words are what stands between spaces, A-Z lower-cased; a document's set are its distinct runs of `width` words, or
    all its words as one if fewer. Documents link if 100 * shared >= percent * all; component_id is
    the smallest doc_id that links reach, component_class the same for just the rows of a component. Null and empty texts: 0 shingles, their own component. Repeated rows: each
    is returned, with the same component. Null doc_id: its row is returned and takes part in links, but never
    names a component. doc_id is read as a 64-bit number; other ids are for the caller to number. A doc_id with two texts has a row for each, told apart by
    text_key (xxhash64 of the text). Other columns are left aside. An empty table gives an empty one.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50, up to 100")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    described = C.as_table(docs.mapInArrow(_describe(width), _DOCUMENTS), "ngram-documents")
    documents = described.select("doc_id", "text_key", "class", "n")
    deals = C.deals_for(docs)
    parts = min(deals, C.MOST_PARTS)
    postings = documents.agg(F.sum("n")).first()[0] or 0
    often = described.where("grams is not null").select("grams", "counts").mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    hot = sorted((r["gram"] % (1 << 64), min(r["n"], 0x7FFFFFFF)) for r in often.where(F.col("n") * HOT > F.lit(postings)).collect())
    hot, hot_df = np.array([g for g, _ in hot], np.uint64), np.array([n for _, n in hot], np.int64)
    packed = docs.select("text").mapInArrow(_scan(width, deals, hot, hot_df), _PACKED)
    lists = C.by_deal(packed, deals).mapInArrow(_frequencies(deals), _PACKED)
    classes = C.as_table(C.by_deal(lists, deals).mapInArrow(_classes(percent, share), _CLASSES), "ngram-classes")

    def short_lists(comps: DataFrame | None) -> DataFrame:
        own = classes.withColumn("comp", F.col("class")) if comps is None else classes.join(comps.withColumnsRenamed({"v": "class", "label": "comp"}), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
        return own.select("class", "n", "n_short", "grams", "comp", "shares").mapInArrow(_short_lists(comps is None), "gram long, class long, n int, comp long, shares int, share int")

    def linked(pairs: DataFrame) -> DataFrame:
        one = classes.select(F.col("class").alias("a"), "n", F.col("grams").alias("x"))
        two = classes.select(F.col("class").alias("b"), F.col("n").alias("m"), F.col("grams").alias("y"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_probe(percent), "a long, b long")

    near = short_lists(None).repartition(parts, "gram", "share").sortWithinPartitions("gram", "share")
    near = C.as_table(near.mapInArrow(_chain(percent), "a long, b long").distinct(), "ngram-pairs")
    with C.batch_bytes(spark, PROBED):
        first = C.as_table(linked(near), "ngram-links")
    comps = C.connected_components(first)
    own = short_lists(comps)
    several = own.groupBy("gram").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.max("shares").alias("all")).where("least <> most")
    several = several.select("gram", F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("share"))
    met = own.join(several, ["gram", "share"]).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    met = met.withColumns({"low": F.least("share", "with"), "high": F.greatest("share", "with")}).drop("with", "shares")
    met = met.repartition(parts, "gram", "low", "high").sortWithinPartitions("gram", "low", "high")
    merged = met.mapInArrow(_postings(percent), "a long, n int, others array<long>, sizes array<int>").repartition(parts, "a").sortWithinPartitions("a").mapInArrow(_merge(percent), "a long, b long")
    with C.batch_bytes(spark, MERGED):
        merged = C.as_table(merged.distinct(), "ngram-pairs")
    with C.batch_bytes(spark, PROBED):
        more = C.as_table(linked(merged), "ngram-links")
    comps = C.connected_components(more.union(comps.selectExpr("v as a", "label as b").where("a <> b"))) if not more.isEmpty() else comps
    by_class = documents.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    # classes of one row that link with nothing name themselves
    named = by_class.join(comps.withColumnRenamed("v", "class"), "class", "left").where("copies > 1 or label is not null")
    named = C.as_table(named.select("class", "least", "copies", F.coalesce("label", "class").alias("label")), "ngram-names")
    by_label = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    named = C.looked_up(named, by_label, "label", "classes", "class").select("class", "component_id", "label", "copies", F.lit(True).alias("named"))
    out = C.looked_up(documents, named, "class", "copies", "text_key")
    own = F.when((F.col("n") > 0) & F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), F.col("class").alias("class_id"), F.coalesce("label", "class").alias("component_class"), "text_key")
