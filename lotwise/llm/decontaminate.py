"""Benchmark decontamination: winnowed fingerprints find every window of `width` words that documents share with benchmark items.

A run of `width` words has `width - gram + 1` k-grams; its least hash is its fingerprint, so a shared run always
has the same one (winnowing's guarantee). The items' fingerprints go into a bit table of fixed size, which is broadcast;
documents' windows whose fingerprint is in it are extended to the hash of the whole window and joined with the items' windows.
The join decides; the bit table only spares the shuffle. Items of fewer than `width` words are one window of their own length.
Windows that stand in very many places are dealt to many tasks by the row that they stand in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes that aren't part of a word.
NO_WORD = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: log2 of the bits in the table of fingerprints: 8 MB, whatever the size of the benchmark.
BITS = 26
#: A window with over a SALTS-th of all places (of which there are fewer than SALTS) is dealt to SALTS tasks.
SALTS = 256


def _windows(data: np.ndarray, offsets: np.ndarray, width: int, gram: int, table: np.ndarray | None, lengths: list[int], whole_if_short: bool):
    """(words of each text, then for windows: text, first word, length, two hashes, fingerprint); only windows in the table, if there is one."""
    is_word, same = C.byte_table(NO_WORD)
    n_words, found = [], []
    span = width - gram + 1
    for i, j in C.steps(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = C.word_bounds(part, at, is_word)
        words = C.word_hashes(part, starts, ends, same)
        n = np.diff(first)
        n_words.append(n)
        jobs = []
        where, text = C.inner_grams(first, width)
        if len(where):
            g = C.gram_hashes(words, gram)
            least = g[: len(g) - span + 1].copy()
            for k in range(1, span):
                np.minimum(least, g[k : len(g) - span + 1 + k], out=least)
            jobs.append((width, where, text, least[where]))
        for k in lengths if not whole_if_short else range(1, width):
            where, text = C.inner_grams(first, k)
            if whole_if_short:
                short = n[text] == k
                where, text = where[short], text[short]
            if len(where):
                jobs.append((k, where, text, C.gram_hashes(words, k, 1)[where]))
        for k, where, text, mark in jobs:
            if table is not None:
                bit = mark >> np.uint64(64 - BITS)
                hit = (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                where, text, mark = where[hit], text[hit], mark[hit]
            if len(where):
                one, two = (np.full(len(where), np.uint64(seed * 77 + k)) for seed in (2, 3))
                for x in range(k):
                    one = C.mix(one ^ words[where + x])
                    two = C.mix(two + words[where + x] * C._M2)
                found.append((text + i, where - first[text], np.full(len(where), k), one, two, mark))
    n = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
    if not found:
        return n, *(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    return n, *(np.concatenate(x) for x in zip(*found, strict=True))


def _items(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, text, _, length, one, two, mark = _windows(*C.utf8(batch.column(1)), width, gram, None, [], True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(length.astype(np.int32)), C.signed(one), C.signed(two), C.signed(mark)], ["item_id", "len", "one", "two", "mark"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, gram: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key) for each row of docs (doc_id, text), against benchmark (item_id, text).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A document's word is hit if it lies in
    an occurrence of any item's window. Null and empty texts have no words, items without words no window. Repeated rows and
    null ids are kept, each row by itself. Items of equal id are one item. Other columns are left aside. text_key is xxhash64 of the text.
    """
    if not 0 < gram <= width:
        raise ValueError("gram must be between 1 and width")
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(_items(width, gram), f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, len int, one long, two long, mark long")
    items = C.as_table(items.distinct(), "benchmark-windows")
    bit = F.shiftrightunsigned("mark", 64 - BITS)
    bits = items.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = np.zeros(1 << BITS - 3, np.uint8)
    for block, part in bits.toLocalIterator():
        # block 1 holds the bits 1 to 32768 in places 0 to 32767, block 0 the bit 0
        table = _put(table, block, np.frombuffer(bytes(part), np.uint8))
    lengths = sorted(r[0] for r in items.where(F.col("len") < width).select("len").distinct().collect())
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, text, start, length, one, two, _ = _windows(*C.utf8(batch.column(2)), width, gram, shared.value, lengths, False)
            order = np.argsort(text, kind="stable")
            values = pa.StructArray.from_arrays([pa.array(start[order].astype(np.int32)), pa.array(length[order].astype(np.int32)), C.signed(one[order]), C.signed(two[order])], ["start", "len", "one", "two"])
            ends = np.searchsorted(text[order], np.arange(len(n) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "text_key", "n_words", "windows"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    found = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, text_key long, n_words long, windows array<struct<start: int, len: int, one: long, two: long>>")
    # the row's number is settled in the written table
    found = C.as_table(found.withColumn("row", F.monotonically_increasing_id()), "document-windows")
    key = ["len", "one", "two"]
    probes = found.where(F.size("windows") > 0).select("row", F.explode("windows").alias("w")).select("row", "w.*")
    counts = probes.groupBy(*key).agg(F.count("*").alias("n"))
    total = found.agg(F.sum(F.size("windows"))).first()[0] or 0
    # by arithmetic fewer than SALTS rows
    hot = F.broadcast(counts.where(F.col("n") * SALTS > F.lit(total)).select(*key, F.lit(SALTS).alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    probes = probes.join(hot, key, "left").select("row", "start", *key, F.pmod(F.xxhash64("row"), salts).cast("int").alias("salt"))
    windows = items.select("item_id", *key).distinct().join(hot, key, "left").select("item_id", *key, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    hits = probes.join(windows, [*key, "salt"]).groupBy("row").agg(
        F.collect_set(F.struct("start", "len")).alias("at"),
        F.collect_set(F.col("item_id").cast("string")).alias("items"),
    )
    hit = F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))).cast("long")
    hits = hits.select("row", hit.alias("n_hit"), "items")
    # rows without windows don't move
    clean = found.where(F.size("windows") == 0).select("doc_id", "text_key", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    out = found.where(F.size("windows") > 0).select("doc_id", "text_key", "n_words", "row").join(hits, "row", "left")
    out = out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).union(clean)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "text_key",
    )


def _put(table: np.ndarray, block: int, bits: np.ndarray) -> np.ndarray:
    """Spark's bitmap block into the table: block k >= 1 has bit 32768 * (k - 1) + p + 1 at place p."""
    places = np.flatnonzero(np.unpackbits(bits, bitorder="little")) + (32768 * (block - 1) + 1 if block > 0 else 0)
    np.bitwise_or.at(table, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return table
