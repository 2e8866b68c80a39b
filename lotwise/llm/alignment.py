"""Cross-tokenizer alignment: which tokens of one vocabulary overlap which of another, by a static interval index and bisection.

Both tokenizers cut the same bytes (a space and the text). The tokens of B are an interval index that is built once for a batch; each token
of A asks it by two bisections for the tokens that it stabs. A gap between bytes that no token of either side spans is a group's boundary: tokens
of A and B between two boundaries belong together.

On Spark:

1. A pass over the texts tokenizes and aligns them. Each row of the table that it writes has a document's counts, its digest, and its distinct pairs of linked ids with how
   often each is linked there. Equal texts of a slice are aligned once.
2. A pass over that table counts in how many documents each pair stands. Tasks count in numpy arrays of bounded size before anything is shuffled.
3. The pairs in the most documents (HOT, a fixed number) are broadcast as arrays, and sum up each document's links. Only if there are more than HOT pairs,
   the others are joined with their counts by pair and summed by row. No such pair is in more than a HOT-th of all places, so none is a hot key.

Vocabulary files are read inside tasks through the public_tokenizers package.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import token_count

#: Pairs of ids whose counts are broadcast: those in the most documents.
HOT = 1 << 20
#: Bytes of text that a task aligns at once, about.
HELD = 1 << 20
#: Distinct pairs that a task counts before it hands them on.
COUNTED = 1 << 21
#: Bits of a pair of ids; the rest of 64 numbers the texts of a step.
PAIR_BITS = 40
#: What stands after an id: within a side of a group, between its sides, between groups.
ENDS = ",|;"


class Tokenizer:
    """Token ids of whole texts, and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], pieces: list[bytes]) -> None:
        self.encode, self.n = encode, len(pieces)
        self.sizes = np.array([*map(len, pieces)], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of each text's); of a text that the ids' bytes differ from, none."""
        rows = self.encode(texts)
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.concatenate([np.array(r, np.int64) for r in rows] or [np.zeros(0, np.int64)])
        raw = [t.encode() for t in texts]
        want = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.repeat(np.arange(len(rows)), n)
        same = np.bincount(text, self.sizes[ids], len(rows)).astype(np.int64) == want
        if not same.all():
            ids, text = ids[same[text]], text[same[text]]
        size = self.sizes[ids]
        made = self.bytes[np.arange(size.sum()) + np.repeat(self.begin[ids] - np.cumsum(size) + size, size)]
        different = np.flatnonzero(made != np.frombuffer(b"".join(r for r, s in zip(raw, same, strict=True) if s), np.uint8))
        if len(different):
            wrong = np.flatnonzero(same)[np.searchsorted(np.cumsum(want[same]), different, "right")]
            same[wrong] = False
            ids = ids[same[text]]
        return ids, np.where(same, n, 0)


def _byte_pieces(vocabulary: dict[str, int]) -> list[bytes]:
    byte = {c: b for b, c in enumerate(token_count.byte_symbols())}
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for piece, k in vocabulary.items():
        # the piece of an added token may hold characters that stand for no byte
        pieces[k] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return pieces


@lru_cache(maxsize=2)
def byte_level(name: str) -> Tokenizer:
    """A byte-level BPE file of the tokenizers library; strings of its special tokens are plain text.

    If the same vocabulary lies beside it as ranks, in the order of its merges, tiktoken gives the same ids in a quarter of the time and is used instead; a text
    that it refuses (its pattern gives up on very long runs) goes to the library.
    """
    import public_tokenizers
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = public_tokenizers.path(name)
    model = tokenizers.Tokenizer.from_file(path)
    model.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)["model"]
    pieces = _byte_pieces(spec["vocab"])

    def library(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]

    try:
        with open(public_tokenizers.path(name.removesuffix(".json") + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(x): int(k) for x, k in map(bytes.split, f)}
    except FileNotFoundError:
        return Tokenizer(library, pieces)
    merged = [spec["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["merges"]]
    if merged != sorted(merged) or any(pieces[k] != x for x, k in ranks.items()) or len(ranks) != 256 + len(merged):
        return Tokenizer(library, pieces)
    import tiktoken

    quick = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            try:
                out.append(quick.encode_ordinary(text))
            except BaseException as e:  # a panic of its regular expressions is no Exception
                if isinstance(e, KeyboardInterrupt | SystemExit | GeneratorExit):
                    raise
                out += library([text])
        return out

    return Tokenizer(encode, pieces)


@lru_cache(maxsize=2)
def piece_level(name: str) -> Tokenizer:
    """A sentencepiece file, for texts that come with the space that it would add."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    named = model.id_to_piece(list(range(model.vocab_size())))
    pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(named)]
    return Tokenizer(lambda texts: model.encode([t[1:] for t in texts], num_threads=1), pieces)


class IntervalIndex:
    """Intervals by start and end, both ascending, as tokens are; built once, then asked by bisection."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray) -> None:
        self.starts, self.ends = starts, ends

    def stabbed(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the first interval that it overlaps, and the one after the last."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, ends, "left")


def _within(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


class Aligned:
    """The alignment of some texts; texts without tokens (null, empty, or whose bytes a tokenizer changes) have no part in it."""

    def __init__(self, texts: list[str | None], a: str, b: str) -> None:
        one, two = byte_level(a), piece_level(b)
        self.n = n = len(texts)
        self.side = two.n
        if one.n * two.n > 1 << PAIR_BITS:
            raise ValueError("the vocabularies have too many pairs of ids")
        full = [" " + t for t in texts if t]
        places = np.array([k for k, t in enumerate(texts) if t], np.int64)
        (self.a, n_a), (self.b, n_b) = one.ids(full), two.ids(full)
        self.doc_a, self.doc_b = np.repeat(places, n_a), np.repeat(places, n_b)
        bad = (n_a == 0) | (n_b == 0)
        if bad.any():
            keep_a, keep_b = (np.repeat(~bad, x) for x in (n_a, n_b))
            self.a, self.doc_a, self.b, self.doc_b = self.a[keep_a], self.doc_a[keep_a], self.b[keep_b], self.doc_b[keep_b]
        size_a, size_b = one.sizes[self.a], two.sizes[self.b]
        # texts lie one after the other; both sides end where a text does
        self.end_a, self.end_b = np.cumsum(size_a), np.cumsum(size_b)
        index = IntervalIndex(self.end_b - size_b, self.end_b)
        self.first, after = index.stabbed(self.end_a - size_a, self.end_a)
        self.links = after - self.first
        self.closes = self.end_b[after - 1] == self.end_a if len(self.a) else np.zeros(0, bool)

    def counts(self) -> dict[str, np.ndarray]:
        links = np.bincount(self.doc_a, self.links, self.n).astype(np.int64)
        return {"n_a": _within(self.doc_a, self.n), "n_b": _within(self.doc_b, self.n), "n_groups": _within(self.doc_a[self.closes], self.n), "n_links": links}

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair of ids, how often it is linked there), by text and pair."""
        total = int(self.links.sum())
        until = np.cumsum(self.links)
        b = self.b[np.arange(total) + np.repeat(self.first - until + self.links, self.links)]
        key = np.sort(np.repeat(self.doc_a << PAIR_BITS | self.a * self.side, self.links) + b)
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if total else np.zeros(0, np.int64)
        key = key[cut]
        return key >> PAIR_BITS, key & (1 << PAIR_BITS) - 1, np.diff(np.r_[cut, total])

    def groups(self) -> list[bytes]:
        """Of each text `a1,a2|b1;a3|b2`: the ids of A and of B in each group."""
        bounds = self.end_a[self.closes]
        group_b = np.searchsorted(bounds, self.end_b, "left")
        last_b = bounds[group_b] == self.end_b if len(self.b) else np.zeros(0, bool)
        group_a = np.cumsum(self.closes) - self.closes
        # a token of A stands after all earlier ones of A and those of B in earlier groups; a token of B likewise, its own group's A included
        before = np.searchsorted(group_b, np.arange(len(bounds) + 1), "left")
        until = np.searchsorted(group_a, np.arange(len(bounds) + 1), "right")
        codes = np.zeros(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + before[group_a]] = self.a * len(ENDS) + self.closes
        codes[np.arange(len(self.b)) + until[group_b]] = self.b * len(ENDS) + 2 * last_b
        named = _named(int(max(self.a.max(initial=0), self.side)).bit_length())
        ends = np.cumsum(_within(self.doc_a, self.n) + _within(self.doc_b, self.n)) * named.itemsize
        padded = named[codes].tobytes()
        return [padded[i:j].translate(None, b"\0")[:-1] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


@lru_cache(maxsize=2)
def _named(bits: int) -> np.ndarray:
    """Each number and what stands after it, as bytes of one width."""
    return np.array([f"{k}{c}".encode() for k in range(1 << bits) for c in ENDS])


_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _aligned(a: str, b: str):
    """Each row's counts and digest, and its distinct pairs and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, 1, HELD):
            texts = batch.column(1).to_pylist()
            place = {t: k for k, t in enumerate(dict.fromkeys(texts))}
            made = Aligned([*place], a, b)
            doc, pair, times = made.pairs()
            cut = np.searchsorted(doc, np.arange(made.n + 1)).tolist()
            width = np.uint32 if byte_level(a).n * made.side <= 1 << 32 else np.uint64
            pair, times = pair.astype(width), times.astype(np.uint32)
            packed = [[x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)] for x in (pair, times)]
            sha = [hashlib.sha256(x).hexdigest() if x else "" for x in made.groups()]
            rows = pa.array([place[t] for t in texts], pa.int64())
            out = [*(pa.array(x) for x in made.counts().values()), pa.array(sha, pa.string()), *(pa.array(x, pa.binary()) for x in packed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(x.take(rows) for x in out)], [*_COLUMNS, "pairs", "times"])

    return run


def _unpacked(pairs: pa.Array, times: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, times) of a batch of packed rows, by row and pair."""
    n = [len(x.as_buffer()) // 4 for x in times]
    width = np.uint32 if sum(map(lambda x: len(x.as_buffer()), pairs)) == 4 * sum(n) else np.uint64
    row = np.repeat(np.arange(len(n)), n)
    return row, *(np.frombuffer(b"".join(x.as_buffer() for x in c), t).astype(np.int64) for c, t in ((pairs, width), (times, np.uint32)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): in how many of a task's documents each pair is linked."""

    def total(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pair, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pair, np.bincount(place, np.concatenate([n for _, n in held]), len(pair)).astype(np.int64)

    held, rows = [], 0
    for batch in C.slices(batches, 0, COUNTED):
        _, pair, _ = _unpacked(*batch.columns)
        held.append(np.unique(pair, return_counts=True))
        rows += len(held[-1][0])
        if rows > 2 * COUNTED:
            held = [total(held)]
            rows = len(held[0][0])
            if rows > COUNTED:
                yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["pair", "n"])
                held, rows = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([*map(pa.array, total(held))], ["pair", "n"])


def _summed(hot):
    """Each row's sums over links; pairs that aren't among the hot ones go into `cold`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = hot.value
        for batch in C.slices(batches, 0, COUNTED):
            row, pair, times = _unpacked(*batch.columns[:2])
            distinct, place = np.unique(pair, return_inverse=True)
            at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
            hit = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
            size = len(batch)
            # sums stay under 2**53
            sums = [np.bincount(row, times * np.where(hit, x[at] if len(x) else 0, 0)[place], size).astype(np.int64) for x in (best, n)]
            cold = ~hit[place]
            ends = np.searchsorted(row[cold], np.arange(size + 1)).astype(np.int32)
            cold = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(pair[cold]), pa.array(times[cold])], ["pair", "times"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *map(pa.array, sums), cold], [*batch.schema.names[2:], "n_best", "count_sum", "cold"])

    return run


def _aligned_table(docs: DataFrame, a: str, b: str) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_aligned(a, b), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")
    # the row's number is settled in the written table
    return C.as_table(out.withColumn("row", F.monotonically_increasing_id()), "aligned", compression="zstd")


def _pair_counts(aligned: DataFrame, side: int) -> DataFrame:
    counts = aligned.select("pairs", "times").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = C.as_table(counts.select("pair", F.expr(f"pair div {side}").alias("a_id"), (F.col("pair") % side).alias("b_id"), "n"), "pair-counts")
    # one row for each id of A at most
    most = counts.groupBy("a_id").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """(a_id, b_id, n, best) for each pair of ids linked in any row of docs (doc_id, text): in how many rows, and whether no other pair of its a_id is in more. Null, empty and changed texts link nothing."""
    return _pair_counts(_aligned_table(docs, a, b), piece_level(b).n).drop("pair")


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs (doc_id, text).

    A is a byte-level BPE file, B a sentencepiece file. Null and empty texts, and those whose tokens' bytes differ from a space and the text (a text with
    U+2581), have no tokens: zeros and ''. Each row counts as a document, repeated ones too; null ids stay; doc_id may be of any type; other
    columns are left aside; texts of any length are aligned whole. Ties of counts are all best. `hot` changes the plan only. An empty table gives an empty one.
    """
    aligned = _aligned_table(docs, a, b)
    counts = C.as_table(_pair_counts(aligned, piece_level(b).n), "pair-best")
    often = counts.orderBy(F.desc("n"), "pair").limit(hot).select("pair", "n", "best").toArrow().sort_by("pair")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(often.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair", "n", "best")))
    kinds = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in [*_COLUMNS, "row"])
    out = aligned.select("pairs", "times", *_COLUMNS, "row").mapInArrow(_summed(shared), f"{kinds}, n_best long, count_sum long, cold array<struct<pair: long, times: long>>")
    columns = [*_COLUMNS[:-1], "n_best", "count_sum", "groups_sha256"]
    if len(often) < hot:
        return out.select(*columns)
    out = C.as_table(out, "summed")
    cold = out.select("row", F.explode("cold").alias("c")).select("row", "c.pair", "c.times")
    cold = cold.join(counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    more = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
    return out.join(cold, "row", "left").select(*columns[:5], more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")
