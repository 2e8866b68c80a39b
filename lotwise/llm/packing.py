"""Best-fit packing: documents into sequences of several permitted lengths, with as little padding as possible.

Pieces are dealt into groups of bounded total length by a hash of the row; each group is packed by one
best-fit-decreasing run, so no group grows with the corpus. Texts stay where they are: only ids and lengths move.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Permitted sequence lengths, and what a sequence costs besides its length.
CAPACITIES, OVERHEAD = (2048, 8192, 32768), 64
#: The pieces of a group fill about this many of the longest sequences.
GROUP_BINS = 256
#: Pieces in a group at most, about, however short they are.
GROUP_PIECES = 1 << 17


def best_fit(lengths: list[int], capacities: tuple[int, ...], overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset in it) of each length, which come longest first, and each bin's capacity.

    A piece goes where it leaves the least room, of equal rooms to the bin opened first. If it fits nowhere, the bin size opened is the one of least
    cost for each unit that it can hold of what is still to be placed. In the end each bin is made as small as its contents allow.
    """
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    bins, offsets, used = [], [], []
    rest = sum(lengths)
    for n in lengths:
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free = min((c for c in capacities if c >= n), key=lambda c: ((c + overhead) / min(c, rest), c))
            b = len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        rest -= n
        if free > n:
            insort(room, (free - n, b))
    return bins, offsets, [capacities[bisect_left(capacities, u)] for u in used]


def pack(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, group_bins: int = GROUP_BINS) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text): doc_id, piece, start, length, bin_id, bin_capacity, bin_offset, bin_used.

    length is that of a text in units of the model, by default its UTF-8 bytes and one for its end. A text longer than the largest
    capacity is cut into pieces that fill sequences of their own, its last piece apart; nothing is left out. bin_id is unique and numbers no empty bin. Rows
    of length 0 or null (possible with a length of one's own) get a row without a bin. Repeated rows are packed
    each, and dealt to groups like any other rows; ties are broken by doc_id, piece, text and number among equal rows, so the same rows give the same bins however they are split into files. Null ids are packed too, and an id of any type comes back as it is.
    Other columns are left aside; an empty table gives an empty one.
    """
    capacities = tuple(sorted(set(capacities)))
    if not capacities or capacities[0] <= 0:
        raise ValueError("capacities must be positive")
    top = capacities[-1]
    length = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1 if length is None else length
    key = F.xxhash64(F.col("text").cast("string")) if "text" in docs.columns else F.lit(0).cast("long")
    # rows alike in id and text are counted, and then numbered: what deals them out doesn't depend on how the input is split
    alike = docs.select("doc_id", F.coalesce(length.cast("long"), F.lit(0)).alias("size"), key.alias("key")).groupBy("doc_id", "size", "key").agg(F.count("*").alias("n"))
    sizes = C.as_table(alike, "packing-lengths")
    total, n_pieces = sizes.agg(F.sum(F.col("size") * F.col("n")), F.sum(F.greatest(F.ceil(F.col("size") / top), F.lit(1)) * F.col("n"))).first()
    groups = max(1, -(-(total or 0) // (top * group_bins)), -(-(n_pieces or 0) // GROUP_PIECES))
    last = F.greatest(F.ceil(F.col("size") / top) - 1, F.lit(0)).cast("int")
    sizes = sizes.select("doc_id", "size", "key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("row"))
    pieces = sizes.select("doc_id", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece"), "key", "row")
    start = F.col("piece").cast("long") * top
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.col("size") - start, F.lit(top)).alias("length"), "key", "row", F.pmod(F.xxhash64("doc_id", "key", "row", "piece"), F.lit(groups)).alias("group"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("key", "ascending"), ("row", "ascending")])
        group = group.take(order)
        lengths = group.column("length").to_pylist()
        full = sum(n > 0 for n in lengths)
        bins, offsets, sizes = best_fit(lengths[:full], capacities, overhead)
        bins = np.array(bins, np.int64)
        used = np.bincount(bins, lengths[:full], len(sizes)).astype(np.int64) if full else np.zeros(0, np.int64)
        none = pa.nulls(len(lengths) - full, pa.int64())
        own = lambda x: pa.concat_arrays([pa.array(x, pa.int64()), none])
        first = group.column("group")[0].as_py() << 24
        columns = [own(first + bins), own(np.array(sizes, np.int64)[bins]), own(offsets), own(used[bins])]
        return pa.table([*(group.column(c) for c in ("doc_id", "piece", "start", "length")), *columns], ["doc_id", "piece", "start", "length", "bin_id", "bin_capacity", "bin_offset", "bin_used"])

    return pieces.groupBy("group").applyInArrow(run, f"doc_id {kind}, piece int, start long, length long, bin_id long, bin_capacity long, bin_offset long, bin_used long")
