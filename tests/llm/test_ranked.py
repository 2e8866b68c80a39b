"""Ranked lexical search against a plain scorer, and the SQL twin on the driver's tables."""

import math
import re
from collections import Counter

import pytest

from lotwise.llm import ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    words = [(d, WORD.findall((t or "").translate(LOWER))) for d, t in docs]
    N, L = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        asked = Counter(x for t in {t for i, t in items if i == item} for x in WORD.findall((t or "").translate(LOWER)))
        scored = []
        for d, w in words:
            m = 100 - 75 + (75 * len(w) * N) // L if L else 0
            tf = Counter(w)
            score = sum(n * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, n in asked.items() if tf[t])
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def made(spark, docs, items, **more):
    # columns that clash with the operator's own
    a = spark.createDataFrame([(d, t, "x", 0, 1) for d, t in docs], "doc_id long, text string, rank string, item int, n long").repartition(4)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id string, text string, score string")
    return sorted((tuple(r) for r in ranked.ranked_search(a, b, **more).collect()), key=str)


DOCS = [(1, "the cat sat on the mat"), (2, "The CAT, the cat; THE cat!"), (3, "dogs and cats"), (4, None), (5, ""), (6, "... ---"), (None, "the cat sat on the mat"), (7, "the cat sat on the mat"), (7, "the cat sat on the mat"), (8, "Straße straße ÄÖ äö 42 42"), (9, "cat " * 3000 + "mat")]
ITEMS = [("a", "cat mat"), ("b", "the the the dog"), ("c", None), ("d", "..."), ("e", "straße 42 äö"), ("e", "straße 42 äö"), ("f", "mat"), ("f", "dogs"), ("g", "nowhere")]


@pytest.mark.parametrize("more", [{}, {"k": 3}, {"k": 1}, {"terms": 3}])
def test_equals_brute_force(spark, more):
    assert made(spark, DOCS, ITEMS, **more) == brute(DOCS, ITEMS, more.get("k", 10))


def test_many_ties_and_lengths(spark):
    docs = [(k, " ".join(f"w{(k * j) % 17}" for j in range(1, 2 + k % 40)) + (" rare" if k % 50 == 0 else "")) for k in range(600)] + [(1000 + k, "w1 w2 w3 rare") for k in range(60)]
    items = [(f"i{k}", f"w{k} w{k + 1} w{k} rare" if k % 2 else f"w{k} w3") for k in range(12)]
    assert made(spark, docs, items) == brute(docs, items)


def test_no_rows(spark):
    assert made(spark, DOCS[3:6], ITEMS) == [] == made(spark, DOCS[:0], ITEMS) == made(spark, DOCS, ITEMS[:0])


def test_impacts_round_upward():
    import numpy as np

    tf, n = np.arange(1, 2000), np.arange(1, 2000) * 3
    exact = ranked.impact(tf, ranked.lengthening(n, 500, 90_000))
    byte = -(-exact // ranked.QUANTUM)
    assert byte.max() <= 255 and (byte * ranked.QUANTUM >= exact).all() and ((byte - 1) * ranked.QUANTUM < exact).all()
    assert ranked.lengthening(np.array([1 << 40]), 1 << 30, 1 << 50).tolist() == [25 + 75 * (1 << 40) * (1 << 30) // (1 << 50)]
