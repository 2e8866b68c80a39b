"""Ranked lexical search: the best documents for each query item, from an index of two levels.

The index has a row for each block of about 4 MB of text, with the postings of the items' terms in order of term. Its first level is a byte for each posting: the
posting's impact in steps of QUANTUM, rounded upward. Sums of bytes times term weights bound a score from above, and from below if each byte is taken as one less.
Its second level are the exact occurrences and lengths.

On Spark:

1. A pass over the texts makes the blocks. Documents, their terms and document frequencies are summed over the blocks; with them the
   impacts are known, and the index is a table in the shared folder.
2. Over the first level alone: each task keeps the k greatest lower bounds of each item; the kth greatest of all tasks is the item's bound.
3. Over both levels: every document whose upper bound reaches its item's bound is rescored in whole numbers. A task keeps the k best of each item, and so
   does a ranking of what the tasks kept, first by parts of the tasks and then over all.

A document among the k best has a score of at least the kth greatest lower bound, and its upper bound is no less; so none is lost.
Items are dealt into sets of about TERMS terms, of which each is one run of these steps; what is broadcast is one set's terms and weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .decontaminate import NO_WORD

#: Impacts are under MOST; a byte counts steps of QUANTUM of it.
MOST = 1_000_000
QUANTUM = -(-MOST // 255)
#: Terms of items in a set, about. Parts in which tasks' best are ranked before they meet.
TERMS, PARTS = 1 << 20, 64


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term in order, number of each text's terms)."""
    is_word, same = C.byte_table(NO_WORD)
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in C.steps(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = C.word_bounds(part, at, is_word)
        hashes.append(C.word_hashes(part, starts, ends, same))
        counts.append(np.diff(first))
    return np.concatenate(hashes), np.concatenate(counts)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches, 1):
        term, n = terms_of(*C.utf8(batch.column(1)))
        owner = np.repeat(np.arange(len(n)), n)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), C.signed(term)], ["item_id", "term"])


_BLOCK = "ids array<long>, n binary, terms binary, lists binary, docs binary, tfs binary, filled long, total long"


def _blocks(vocabulary):
    """Blocks of texts (doc_id, text): their ids and lengths, and for each term of the vocabulary in them the list of documents (ascending) and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in C.slices(batches, 1):
            hashes, n = terms_of(*C.utf8(batch.column(1)))
            owner = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            key, tfs = np.unique(at[hit] << 32 | owner[hit], return_counts=True)
            term = key >> 32
            cut = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            columns = [n, term[cut].astype(np.int32), np.r_[cut, len(term)].astype(np.int32), (key & 0xFFFFFFFF).astype(np.uint32), tfs.astype(np.uint32)]
            ids = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), batch.column(0).cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in columns), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["ids", "n", "terms", "lists", "docs", "tfs", "filled", "total"])

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for terms, lists in zip(*batch.columns, strict=True):
                df[np.frombuffer(terms.as_buffer(), np.int32)] += np.diff(np.frombuffer(lists.as_buffer(), np.int32))
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])

    return run


def lengthening(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of n terms: 25 + (75 * n * documents) div total."""
    if len(n) and int(n.max()) * documents * 75 >= 1 << 62:
        return np.array([25 + 75 * x * documents // total for x in n.tolist()], np.int64)
    return 25 + 75 * n * documents // max(total, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _impacts(documents: int, total: int):
    """First level: each posting's impact in steps of QUANTUM, upward."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, docs, tfs in zip(*(batch.column(c) for c in ("n", "docs", "tfs")), strict=True):
                m = lengthening(np.frombuffer(n.as_buffer(), np.int64), documents, total)
                out.append((-(-impact(np.frombuffer(tfs.as_buffer(), np.uint32), m[np.frombuffer(docs.as_buffer(), np.uint32)]) // QUANTUM)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "impacts"])

    return run


@dataclass
class Items:
    """A set of items: each one's terms (places in the vocabulary) and their weights times occurrences, one item after the other."""

    begin: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


class _Lists:
    """A block's lists as an item meets them."""

    def __init__(self, items: Items, terms, lists, docs, impacts) -> None:
        of, self.docs, self.impacts = np.frombuffer(terms.as_buffer(), np.int32), np.frombuffer(docs.as_buffer(), np.uint32), np.frombuffer(impacts.as_buffer(), np.uint8)
        lists = np.frombuffer(lists.as_buffer(), np.int32).astype(np.int64)
        at = np.minimum(np.searchsorted(of, items.terms), max(len(of) - 1, 0))
        there = of[at] == items.terms if len(of) else np.zeros(len(items.terms), bool)
        self.kept = np.r_[0, np.cumsum(there)][items.begin]
        self.from_, self.to, self.weights = lists[at[there]], lists[at[there] + 1], items.weights[there]

    def of(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the item's postings, their weights)."""
        mine = slice(self.kept[item], self.kept[item + 1])
        start, size = self.from_[mine], self.to[mine] - self.from_[mine]
        until = np.cumsum(size)
        return np.arange(until[-1] if len(until) else 0) + np.repeat(start - until + size, size), np.repeat(self.weights[mine], size)

    def bounds(self, item: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(greatest and least score of each of n documents, the postings and weights). Sums stay under 2**53."""
        at, weights = self.of(item)
        doc, byte = self.docs[at], self.impacts[at]
        most = np.bincount(doc, weights * byte, n).astype(np.int64)
        least = most - np.bincount(doc, weights * (byte > 0), n).astype(np.int64)
        return most * QUANTUM, least * QUANTUM, at, weights


def _lower_bounds(items, k: int):
    """(item, lows): a task's k greatest lower bounds over 0 of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = items.value
        n_items = len(wanted.begin) - 1
        best = np.zeros((n_items, k), np.int64)
        for batch in batches:
            for size, *level in zip(*batch.columns, strict=True):
                lists = _Lists(wanted, *level)
                for item in range(n_items):
                    low = lists.bounds(item, size.as_py())[1]
                    low = low[low > best[item, 0]]
                    if len(low):
                        both = np.r_[best[item], low]
                        best[item] = np.sort(np.partition(both, len(both) - k)[-k:])
        some = np.flatnonzero(best[:, -1] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([r[r > 0].tolist() for r in best[some]], pa.list_(pa.int64()))], ["item", "lows"])

    return run


def _rescored(items, reach, k: int, documents: int, total: int):
    """(item, doc_id, score): a task's k best documents of each item, among all whose upper bound reaches the item's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, least = items.value, reach.value
        n_items = len(wanted.begin) - 1
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * n_items
        for batch in batches:
            for ids, n, tfs, *level in zip(*batch.columns, strict=True):
                ids, size = ids.values, len(ids)
                null = np.asarray(ids.is_null())
                number = np.asarray(ids.fill_null(0))
                m = lengthening(np.frombuffer(n.as_buffer(), np.int64), documents, total)
                tfs = np.frombuffer(tfs.as_buffer(), np.uint32)
                lists = _Lists(wanted, *level)
                for item in range(n_items):
                    most, _, at, weights = lists.bounds(item, size)
                    could = (most > 0) & (most >= least[item])
                    if not could.any():
                        continue
                    doc = lists.docs[at]
                    mine = could[doc]
                    doc = doc[mine]
                    score = np.zeros(size, np.int64)
                    np.add.at(score, doc, weights[mine] * impact(tfs[at[mine]], m[doc]))
                    found = np.flatnonzero(score > 0)
                    s, d, x = (np.r_[a, b] for a, b in zip(held[item], (score[found], number[found], null[found]), strict=True))
                    order = np.lexsort((d, x, -s))[:k]
                    held[item] = s[order], d[order], x[order]
        count = [len(s) for s, _, _ in held]
        score, number, null = (np.concatenate([h[c] for h in held] or [np.zeros(0, t)]) for c, t in enumerate((np.int64, np.int64, bool)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n_items, dtype=np.int32), count)), pa.array(number, mask=null), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _ranked(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """rows with `rank` within their item, up to k: first among the rows of the same part of the tasks, then among what is left."""
    part = Window.partitionBy("item", "part").orderBy(*order)
    rows = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return rows.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def build_index(docs: DataFrame, vocabulary: np.ndarray) -> tuple[DataFrame, int, int, np.ndarray]:
    """(index of docs (doc_id, text) for the sorted hashes of a vocabulary, documents with terms, all their terms, documents with each term of the vocabulary)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    blocks, path = C._written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_blocks(shared), _BLOCK), "lexical-postings")
    documents, total = blocks.agg(F.coalesce(F.sum("filled"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    counted = blocks.select("terms", "lists").mapInArrow(_frequencies(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[np.asarray(counted["term"])] = np.asarray(counted["df"])
    index = C.as_table(blocks.drop("filled", "total").mapInArrow(_impacts(documents, total), "ids array<long>, n binary, terms binary, lists binary, docs binary, tfs binary, impacts binary"), "lexical-index")
    C._dropped(docs.sparkSession, path)
    return index, documents, total, df


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of docs (doc_id, text) for each of items (item_id, text), best first, equal scores by doc_id.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased; scores are in whole numbers. Null and empty texts have no terms and are in no
    result. Each row of docs is a document, repeated ones too; a null doc_id comes after equal scores with one. Rows of one item_id are one item, repeated rows
    of it once; an item without terms, or whose terms are nowhere, has no result. doc_id is read as a 64-bit number; other columns are left aside; whole texts of any length are
    read. Empty tables give an empty one. `terms` changes the plan only.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", F.col("text").cast("string").alias("text")).distinct().mapInArrow(_item_terms, f"item_id {kind}, term long")
    found = C.as_table(found.groupBy("item_id", "term").agg(F.count("*").alias("n")), "item-terms")
    sets = -(-found.count() // terms)
    results = []
    for number in range(sets):
        own = found.where(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == number).orderBy("item_id", "term").toArrow()
        if not len(own):
            continue
        term = np.asarray(own["term"].combine_chunks()).view(np.uint64)
        vocabulary = np.unique(term)
        index, documents, total, df = build_index(docs, vocabulary)
        if not total:
            return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
        weights = np.array([weight(documents, x) for x in df.tolist()], np.int64)
        at = np.searchsorted(vocabulary, term)
        names = own["item_id"].to_pylist()
        begin = np.flatnonzero([k == 0 or names[k] != names[k - 1] for k in range(len(names))])
        shared = spark.sparkContext.broadcast(Items(np.r_[begin, len(names)], at.astype(np.int32), weights[at] * np.asarray(own["n"])))
        lows = index.select(F.size("ids").alias("size"), "terms", "lists", "docs", "impacts").mapInArrow(_lower_bounds(shared, k), "item int, lows array<long>")
        lows = _ranked(lows.select("item", F.explode("lows").alias("low")), [F.desc("low")], k).where(F.col("rank") == k).select("item", "low").toArrow()
        reach = np.zeros(len(begin), np.int64)
        reach[np.asarray(lows["item"])] = np.asarray(lows["low"])
        best = index.select("ids", "n", "tfs", "terms", "lists", "docs", "impacts").mapInArrow(_rescored(shared, spark.sparkContext.broadcast(reach), k, documents, total), "item int, doc_id long, score long")
        best = _ranked(best, [F.desc("score"), F.asc_nulls_last("doc_id")], k)
        # the set's items: no more than its terms
        item = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(begin), dtype=np.int32)), "item_id": own["item_id"].take(pa.array(begin))}))
        results.append(C.as_table(best.join(F.broadcast(item), "item").select("item_id", "rank", "doc_id", "score"), "lexical-best"))
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


#: The same in DuckDB's SQL.
SEARCH_SQL = r"""
with words as (select row_number() over () as row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
asked as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select distinct item_id, text from benchmark)),
postings as (select row, doc_id, term, count(*) as tf from words group by all),
lengths as (select row, count(*) as n from words group by row),
corpus as (select count(*)::bigint as documents, coalesce(sum(n), 0)::bigint as total from lengths),
stretch as (select row, 25 + (75 * n * documents) // total as m from lengths, corpus),
weights as (select term, floor(1000 * ln((2 * documents + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*) as df from postings group by term), corpus),
scores as (select item_id, p.row, p.doc_id, sum(w * q.times * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from (select item_id, term, count(*) as times from asked group by all) q join postings p using (term) join weights using (term) join stretch using (row) group by all)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0) where rank <= 10
"""
