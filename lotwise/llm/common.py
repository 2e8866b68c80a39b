"""Shared helpers: shared-folder tables, byte-level word hashing, connected components.

Everything here works on Arrow batches inside tasks; Spark deals out the work.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once; a longer single text is one step of its own.
STEP_BYTES = 1 << 19

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, or a temporary one where none is set."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not there:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        sc.setCheckpointDir(there)
    return there.rstrip("/")


def as_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    return _written(df, name, **options)[0]


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of about `most` bytes, for what is run meanwhile."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _written(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that _written made and that nothing reads any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text that one deal of a word-level shuffle stands for, about; and partitions at most, whatever the input's size.
DEAL_BYTES, MOST_PARTS = 16 << 20, 50_000
#: Bytes of text that a task turns into arrays at once, about.
SLICE_BYTES = 4 << 20


def deals_for(docs: DataFrame, text: str = "text") -> int:
    """Into how many deals a shuffle of what is derived from the texts goes: as many as the session has partitions, more if the texts are large."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(n_partitions(docs.sparkSession), -(-total // DEAL_BYTES))


def by_deal(df: DataFrame, deals: int) -> DataFrame:
    """df's rows by their column `deal`: a partition for each, or, if they are too many, several in one partition, one after the other. A task holds one deal at a time."""
    if deals <= MOST_PARTS:
        return df.repartitionById(deals, F.col("deal"))
    return df.repartitionById(MOST_PARTS, F.pmod("deal", F.lit(MOST_PARTS))).sortWithinPartitions("deal")


def each_deal(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
    """The batches of each deal; a deal's are to be used up before the next one's."""
    state: dict = {"next": None, "last": None}

    def advance() -> None:
        while state["next"] is None or not len(state["next"]):
            state["next"] = next(batches, None)
            if state["next"] is None:
                return

    def own(deal: int) -> Iterator[pa.RecordBatch]:
        while state["next"] is not None:
            deals = np.asarray(state["next"].column(0))
            # with one deal for each partition rows come in no order, but all are of that deal
            n = int((deals == deal).argmin()) if (deals != deal).any() else len(deals)
            if n == 0:
                return
            batch, state["next"] = state["next"].slice(0, n), state["next"].slice(n)
            yield batch
            advance()

    advance()
    while state["next"] is not None:
        deal = int(state["next"].column(0)[0].as_py())
        part = own(deal)
        yield part
        for _ in part:
            pass


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has texts (in column number `text`) of about `most` bytes."""
    for batch in batches:
        for i, j in steps(utf8(batch.column(text))[1], most):
            yield batch.slice(i, j - i)


#: A lookup table of up to this many rows is broadcast whole.
BROADCAST_ROWS = 50_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: str, spread: str) -> DataFrame:
    """rows left-joined with table, whose `key` is unique and whose `count` tells how many of rows hold it, at most; `count` itself is left out.

    A table of at most BROADCAST_ROWS rows is broadcast. Of a larger one only hot keys are: those that more than a
    thousandth of all rows hold, of which there can't be more than a thousand. Rows of the other keys are shuffled; rows of hot keys and of none
    are dealt out by a hash of `spread`.
    """
    values = [c for c in table.columns if c not in (key, count)]
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(count)), key, "left")
    total = table.agg(F.sum(count)).first()[0] or 0
    kept = F.struct(*values)
    hot = table.where(F.col(count) * 1000 > total).select(key, kept.alias("_hot"))
    cold = table.where(F.col(count) * 1000 <= total).select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_deal"), kept.alias("_cold"))
    there = rows.join(F.broadcast(hot), key, "left")
    done = F.col("_hot").isNotNull() | F.col(key).isNull()
    there = there.withColumn("_deal", F.when(done, F.xxhash64(spread).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long")))
    out = there.join(cold, (there[key] == cold["_key"]) & (there["_deal"] == cold["_deal"]), "left").withColumn("_kept", F.coalesce("_hot", "_cold"))
    return out.select(*rows.columns, *(F.col("_kept")[c].alias(c) for c in values))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's), so that sums of products become evenly spread."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ROLL = _powers(0xA0761D6478BD642F, 64)


def byte_table(separators: bytes, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is a word's byte, the byte as it is compared): A-Z are compared as a-z if fold_case."""
    same = np.arange(256, dtype=np.uint8)
    if fold_case:
        same[65:91] = same[97:123]
    word = np.ones(256, bool)
    word[list(separators)] = False
    return word, same


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each text's offsets in them; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = pa.types.is_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if raw else "")
    column = column.cast(pa.large_binary() if raw else pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and of each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, same: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its bytes are taken eight at a time, as one integer."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = same[data]
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix((eight[starts] & _KEEP[np.minimum(lengths, 8)]) ^ (lengths.astype(np.uint64) << np.uint64(56)))
    rest, at = np.flatnonzero(lengths > 8), 8
    while len(rest):
        out[rest] = mix(out[rest] * _M1 ^ (eight[starts[rest] + at] & _KEEP[np.minimum(lengths[rest] - at, 8)]))
        at += 8
        rest = rest[lengths[rest] > at]
    return out


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of k words; those that cross from one text to the next are the caller's to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k * 0x9E37 + seed * 0x85EB + 1))
    for j in range(k):
        out += words[j : j + n] * _ROLL[j + 1 + 7 * seed]
    return mix(out)


def inner_grams(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k-grams that lie within a text, and the index of that text."""
    n = np.diff(first)
    grams = np.maximum(n - k + 1, 0)
    text = np.repeat(np.arange(len(n)), grams)
    return np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(first[:-1], grams), text


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def bit_table(rows: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits, those set that rows (bit: long) name. Spark sets them in blocks, and only the blocks, 2**bits / 8 bytes together, come to the driver."""
    # bitmap block k >= 1 has bit 32768 * (k - 1) + p + 1 at place p, block 0 the bit 0
    blocks = rows.groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = np.zeros(1 << bits - 3, np.uint8)
    for block, part in blocks.toLocalIterator():
        places = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(part), np.uint8), bitorder="little")) + (32768 * (block - 1) + 1 if block > 0 else 0)
        np.bitwise_or.at(table, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return table


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(v, label) for each vertex of edges (a, b: long): label is its component's smallest vertex.

    Alternates large-star and small-star steps (Kiveris and others, 2014) as joins and grouped minima; each
    round is a table in the shared folder, which the next one takes the place of. Empty edges give an empty table. The number of rounds grows with the
    logarithm of the longest path.
    """
    e, path = _written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down).distinct()
        before = path
        e, path = _written(small, name)
        _dropped(edges.sparkSession, before)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return e.select(F.col("u").alias("v"), F.col("v").alias("label")).union(e.select("v", F.col("v").alias("label")).distinct())
