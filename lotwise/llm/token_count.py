"""Token counts: byte-level BPE by rank-synchronous merging of ragged numpy arrays.

A batch's distinct pre-tokens lie one after the other in one array of symbols. In each round every sequence
finds its lowest-rank pair and all sequences apply theirs at once; sequences without a pair leave. What survives are the
tokens. Counts of pre-tokens already seen are kept in a table of bounded size. Vocabulary files are read inside
tasks through the public_tokenizers package; they aren't copied.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose counts a task keeps at most.
KEPT = 300_000
#: Bytes of text whose pre-tokens are held at once, about.
HELD = 1 << 20
#: A pre-token of more bytes is merged by itself, with its pairs kept by rank.
LONG = 512

#: The pre-tokens of byte-level BPE; the same for ASCII texts, in a form that `re` matches fast.
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ASCII = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, following = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else following))
        following += b not in printable
    return out


class RankMerger:
    """Counts the tokens of pre-tokens."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ids = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        key = ids[:, 0] << 32 | ids[:, 1]
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.merged = np.append(key[order], np.int64(1) << 62), np.append(order, len(order)), np.append(ids[order, 2], -1)
        self.none = len(order)
        self.byte = np.array([vocabulary[c] for c in byte_symbols()], np.int64)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token, none of which is empty."""
        out = np.zeros(len(words), np.int64)
        long = np.array([len(w) > LONG for w in words], bool)
        for k in np.flatnonzero(long):
            out[k] = self._long(words[k])
        out[~long] = self._ragged([w for w, x in zip(words, long, strict=True) if not x])
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs of symbols; symbol -1 is none."""
        pair = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        at = np.searchsorted(self.key, pair)
        return np.where(self.key[at] == pair, self.rank[at], self.none), self.merged[at]

    def _long(self, word: bytes) -> int:
        """As _ragged, for one sequence: a round looks only at the places of its lowest rank, which are kept by rank, not at all pairs again."""
        symbols = np.append(self.byte[np.frombuffer(word, np.uint8)], -1)
        n = len(word)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank, merged = self._ranks(symbols[:-1], symbols[1:])
        rank, merged = np.append(rank, self.none), np.append(merged, -1)
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def keep(at: np.ndarray) -> None:
            at = at[rank[at] < self.none]
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else ():
                r = int(rank[part[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(waiting, r)
                places[r].append(part)

        keep(np.arange(n))
        left = n
        while waiting:
            r = heapq.heappop(waiting)
            hit = np.unique(np.concatenate(places.pop(r)))
            hit = hit[rank[hit] == r]
            if not len(hit):
                continue
            # of hits that overlap (a pair of equal symbols in a run), every other one counts, from the left
            run = np.cumsum(np.r_[True, after[hit[:-1]] != hit[1:]])
            within = np.arange(len(hit)) - np.searchsorted(run, run)
            hit = hit[(within % 2 == 0) | (symbols[hit] != symbols[after[hit]])]
            gone = after[hit]
            symbols[hit] = merged[hit]
            after[hit] = after[gone]
            before[after[hit]] = hit
            rank[gone] = self.none
            left -= len(hit)
            touched = np.unique(np.r_[hit, before[hit[before[hit] >= 0]]])
            rank[touched], merged[touched] = self._ranks(symbols[touched], symbols[after[touched]])
            keep(touched)
        return left

    def _ragged(self, words: list[bytes]) -> np.ndarray:
        """All sequences at once: in each round every one applies its lowest-rank pair, until none has one."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        out = lengths.copy()
        while len(symbols) > 1:
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.searchsorted(self.key, pair)
            rank = np.where((self.key[at] == pair) & (owner[:-1] == owner[1:]), self.rank[at], self.none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.append(rank, self.none), first)
            size = np.diff(np.r_[first, len(owner)])
            hit = np.flatnonzero((rank == np.repeat(lowest, size)[:-1]) & (rank < self.none))
            if not len(hit):
                break
            # of hits that overlap (a pair of equal symbols in a run), every other one counts, from the left
            run = np.cumsum(np.r_[True, np.diff(hit) != 1])
            within = np.arange(len(hit)) - np.searchsorted(run, run)
            hit = hit[(within % 2 == 0) | (symbols[hit] != symbols[hit + 1])]
            symbols[hit] = self.merged[at[hit]]
            np.subtract.at(out, owner[hit], 1)
            stay = np.repeat(lowest < self.none, size)
            stay[hit + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return out


@lru_cache(maxsize=2)
def _loaded(name: str) -> tuple[RankMerger, list[str], dict[str, int]]:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    return RankMerger(model["vocab"], model["merges"]), [x["content"] for x in spec.get("added_tokens", [])], {}


def count_tokens(texts: list[str], name: str) -> list[int]:
    """Tokens of each text; an added token's string inside a text is that one token, as the library has it by default."""
    merger, added, known = _loaded(name)
    split = re.compile("|".join(map(re.escape, added))) if added else None
    pieces, extra = [], []
    for text in texts:
        extra.append(len(split.findall(text)) if split and any(x in text for x in added) else 0)
        parts = split.split(text) if extra[-1] else [text]
        pieces.append([w for p in parts for w in (_ASCII if p.isascii() else _ANY).findall(p)] if len(parts) > 1 else (_ASCII if text.isascii() else _ANY).findall(text))
    new = [*set().union(*pieces).difference(known)]
    if len(known) + len(new) > KEPT:
        known.clear()
        new = [*set().union(*pieces)]
    for i in range(0, len(new), 20_000):
        part = new[i : i + 20_000]
        known.update(zip(part, merger.counts([w.encode() for w in part]).tolist(), strict=True))
    return [sum(map(known.__getitem__, p)) + n for p, n in zip(pieces, extra, strict=True)]


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text).

    Null and empty texts have 0 tokens; null ids and repeated rows stay; other columns are left aside; a text of any length is counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            size = np.asarray(batch.column(2), np.int64)
            n, i = [], 0
            ends = np.cumsum(size)
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HELD, "right")))
                n += count_tokens(texts[i:j], tokenizer)
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = out.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
