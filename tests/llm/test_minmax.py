"""Min-max near-dedup against brute force over all pairs."""

import re

import numpy as np
import pytest
from lotwise.llm import minmax_dedup as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute(rows, width=3, percent=85):
    sets = [shingles(t, width) for _, t in rows]
    up = [*range(len(rows))]

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    comp = [least.get(root(i)) if sets[i] else d for i, (d, _) in enumerate(rows)]
    return sorted(((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, comp, strict=True)), key=str)


def made(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, "xx", 1, True) for d, t in rows], "doc_id long, text string, lang string, n long, kept boolean").repartition(3)
    return sorted((tuple(r) for r in M.minmax_dedup(docs, **more).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def words(rng, n, of=400):
    return [f"w{x}" for x in rng.integers(0, of, n)]


def families(seed, n=60):
    """Chains of edits (neighbours link, ends don't), copies of one text with edits each, and texts that share half."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n // 10):
        base = words(rng, int(rng.integers(12, 160)))
        now = list(base)
        for _ in range(5):
            rows.append(" ".join(now))
            now = list(now)
            for _ in range(max(1, len(now) // 60)):
                now[int(rng.integers(0, len(now)))] = f"x{rng.integers(0, 10**6)}"
        for _ in range(5):
            own = list(base)
            for _ in range(max(1, len(own) // 30)):
                own[int(rng.integers(0, len(own)))] = f"y{rng.integers(0, 10**6)}"
            rows.append(" ".join(own))
    half = words(rng, 100)
    rows += [" ".join(half + words(rng, k)) for k in (0, 3, 5, 8, 10, 12, 15, 20, 50, 100)]
    order = rng.permutation(len(rows))
    return [(int(k) * 3, rows[k]) for k in order]


@pytest.mark.parametrize("seed,share", [(1, M.SHARE), (2, 2), (3, 1)])
def test_families(spark, seed, share):
    rows = families(seed)
    assert made(spark, rows, share=share) == brute(rows)


def test_edges(spark):
    rows = [(5, "one"), (3, "ONE"), (9, "one two"), (2, None), (1, ""), (7, " \t\n"), (8, "one two three four"), (8, "one two three four"), (None, "one two three four"), (None, "alone here now"), (4, "a b c d"), (6, "a b c d ")]
    assert made(spark, rows) == brute(rows)
    assert made(spark, rows[:0]) == [] and made(spark, rows[3:6]) == brute(rows[3:6])


def test_hot_group_and_long_text(spark):
    rng = np.random.default_rng(5)
    base = words(rng, 300)
    rows = [(k, " ".join(base)) for k in range(200)]
    for k in range(200, 320):
        own = list(base)
        for _ in range(int(rng.integers(1, 9))):
            own[int(rng.integers(0, 300))] = f"z{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(own)))
    long = words(rng, 60_000, 10**6)
    rows += [(900, " ".join(long)), (901, " ".join(long[:58_000])), (902, " ".join(long[:40_000]))]
    assert made(spark, rows, share=16) == brute(rows)


def test_bounds():
    assert M.bands_for(85) == (2, 29) and M.least_equal(85) in range(170, 195) and M.least_equal(100) == 256
    assert M.bands_for(51) == (1, 69) and M.bands_for(100) == (2, 1)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    both = np.concatenate([a, a[:850], rng.integers(0, 1 << 63, 40).astype(np.uint64)])
    one, two = M.signatures(both, np.array([0, 900]))
    assert abs((one == two).mean() - 850 / 940) < 0.12


def test_other_thresholds(spark):
    rows = families(4, 40)
    assert made(spark, rows, width=5, percent=75) == brute(rows, 5, 75)
    assert made(spark, rows, width=1, percent=100) == brute(rows, 1, 100)
