"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted in numpy on a bounded sample of labelled rows and flattened into arrays, level by level, so that a
whole batch walks down all trees with array lookups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import learn

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Kinds of bytes that are counted.
KINDS = {
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "space": b" ",
    "line": b"\n",
    "stop": b".?!",
    "pause": b",;:",
    "pipe": b"|",
    "symbol": b"#$%&*@^~_=+<>{}[]\\/",
    "bang": b"!",
    "quote": b"\"'",
    "high": bytes(range(128, 256)),
}
FEATURES = ["log_bytes", "log_words", *KINDS, "word_bytes", "word_spread", "distinct", "repeated_next", "repeated_pairs", "words_a_line", "top_share"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    is_word, same = C.byte_table(SPACES)
    codes = np.full(256, len(KINDS), np.uint8)
    kind_of = {}
    for k, (_, members) in enumerate(KINDS.items()):
        for b in members:
            kind_of.setdefault(b, []).append(k)
    out = [np.zeros((0, len(FEATURES)))]
    masks = np.zeros((len(KINDS), 256), np.uint8)
    for b, ks in kind_of.items():
        masks[ks, b] = 1
    del codes
    for i, j in C.steps(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = np.diff(at)
        rows = np.zeros((len(n), len(FEATURES)))
        full = np.flatnonzero(n)
        if len(full):
            for k in range(len(KINDS)):
                hits = np.r_[0, np.cumsum(masks[k][part], dtype=np.int64)]
                rows[:, 2 + k] = (hits[at[1:]] - hits[at[:-1]]) / np.maximum(n, 1)
            starts, ends, first = C.word_bounds(part, at, is_word)
            words = np.diff(first)
            h = C.word_hashes(part, starts, ends, same)
            owner = np.repeat(np.arange(len(n)), words)
            length = (ends - starts).astype(float)
            total = lambda x, w=first: (s := np.r_[0, np.cumsum(x)])[w[1:]] - s[w[:-1]]
            w = np.maximum(words, 1)
            mean = total(length) / w
            key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
            new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            runs = np.flatnonzero(new)
            size = np.diff(np.r_[runs, len(key)])
            whose = (key[runs] >> np.uint64(44)).astype(np.int64)
            next_same = np.r_[(h[1:] == h[:-1]) & (owner[1:] == owner[:-1]), False] if len(h) else np.zeros(0, bool)
            pair = C.mix(h[:-1] * C._M1 + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
            inner = owner[1:] == owner[:-1] if len(h) > 1 else np.zeros(0, bool)
            pairs = np.sort((owner[1:][inner].astype(np.uint64) << np.uint64(44)) | (pair[inner] >> np.uint64(20)))
            again = np.flatnonzero(pairs[1:] == pairs[:-1])
            rows[:, 0], rows[:, 1] = np.log1p(n), np.log1p(words)
            k = 2 + len(KINDS)
            rows[:, k] = mean
            rows[:, k + 1] = np.sqrt(np.maximum(total(length**2) / w - mean**2, 0))
            rows[:, k + 2] = np.bincount(whose, minlength=len(n)) / w
            rows[:, k + 3] = total(next_same) / w
            rows[:, k + 4] = np.bincount((pairs[again] >> np.uint64(44)).astype(np.int64), minlength=len(n)) / w
            rows[:, k + 5] = words / (1 + rows[:, 2 + [*KINDS].index("line")] * n)
            top = np.zeros(len(n))
            np.maximum.at(top, whose, size)
            rows[:, k + 6] = top / w
        out.append(rows)
    return np.concatenate(out)


class Trees:
    """Boosted trees of one depth: node i's children are 2i+1 and 2i+2; a leaf's value sits at the last level."""

    def __init__(self, base: float, feature: np.ndarray, bound: np.ndarray, leaf: np.ndarray) -> None:
        self.base, self.feature, self.bound, self.leaf = base, feature, bound, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = (self.leaf.shape[1]).bit_length() - 1
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, feature[node]] > bound[node])
            out += leaf[node - len(feature)]
        return learn.sigmoid(out)


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 48, least: int = 5, ridge: float = 1.0) -> Trees:
    """Logistic boosting: gradients are summed into histograms of binned features, the split of most gain is taken at each node."""
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    inner = (1 << depth) - 1
    if not len(x) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    f = x.shape[1]
    flat = binned + np.arange(f) * bins
    margin = np.full(len(x), base)
    features, bounds, leaves = [], [], []
    for _ in range(rounds):
        prob = learn.sigmoid(margin)
        g, h = prob - y, prob * (1 - prob)
        feature, bound, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(len(x), np.int64)
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            if len(mine) >= 2 * least:
                cells = flat[mine].ravel()
                sums = [np.cumsum(np.bincount(cells, np.repeat(v[mine], f), f * bins).reshape(f, bins), axis=1) for v in (g, h)]
                count = np.cumsum(np.bincount(cells, minlength=f * bins).reshape(f, bins), axis=1)
                (gl, hl), gt, ht = sums, g[mine].sum(), h[mine].sum()
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(count < least) | (len(mine) - count < least)] = 0
                for c, e in enumerate(edges):
                    gain[c, len(e) :] = 0
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    feature[k], bound[k] = best // bins, edges[best // bins][best % bins]
            node[mine] = 2 * k + 1 + (x[mine, feature[k]] > bound[k])
        place = node - inner
        gs, hs = np.bincount(place, g, inner + 1), np.bincount(place, h, inner + 1)
        leaf = -rate * gs / (hs + ridge)
        margin += leaf[place]
        features.append(feature)
        bounds.append(bound)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(bounds), np.array(leaves))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = learn.SAMPLE_ROWS) -> Trees:
    """Trees from at most `rows` labelled rows that aren't held out; only their statistics come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(*C.utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    sample = learn.training_rows(docs, labels, label, rows)
    found = sample.mapInArrow(run, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return fit_trees(x, found["label"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text); labels (doc_id, quality) of held-out rows aren't used.

    Null texts count as empty and get the score of an empty document; null ids and repeated rows stay; other columns are left aside. Without
    labels every score is 0.5. Whole texts are read; doc_id may be of any type that labels share; equal texts have equal scores.
    """
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(trees.value.score(statistics(*C.utf8(batch.column(1)))))], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string"), learn.held_out().alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
