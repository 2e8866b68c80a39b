"""Similar names of a catalog against brute force, and batched similarities against the standard library's."""

import difflib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lotwise.operators import names as N

_TEXT = st.text(alphabet="AB4 -é", max_size=14)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(_TEXT, _TEXT), max_size=20))
def test_ratios_equal_the_library(pairs):
    got = N.ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_ratios_of_long_texts():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ABCDE 12") for _ in range(n))
    pairs = [(text(n), text(m)) for n, m in ((5000, 30), (30, 5000), (150, 199), (300, 200), (0, 300), (1, 0), (900, 150))]
    assert N.ratios(*zip(*pairs, strict=True)).tolist() == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def similarity(a, b):
    return max(difflib.SequenceMatcher(None, a, b).ratio(), N.CONTAINED if a in b or b in a else 0.0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="AB4 -", max_size=12), min_size=1, max_size=6), st.lists(st.text(alphabet="AB4 -", max_size=12), min_size=1, max_size=10))
def test_no_bound_is_too_low(texts, keys):
    """Neither a cell's bound nor what is passed over for it costs a name its best key."""
    import pyarrow as pa

    cell = pa.table({"cell": [0] * len(keys), "key": keys})
    bounds = N._Profiles(N._profile(cell)).bounds(texts)
    models = [f"m{k}" for k in range(len(keys))]
    found = {x: (y, s) for x, y, s in N.best_of(texts, np.full(len(texts), 1e-9), keys, models)}
    for x, text in enumerate(texts):
        scores = [similarity(text, key) for key in keys]
        assert bounds[x, 0] >= max(scores) - 1e-12
        best = min(range(len(keys)), key=lambda k: (-scores[k], models[k]))
        assert found.get(x) == ((best, scores[best]) if scores[best] > 1e-9 else None)


def test_many_cells_equal_one_list(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["MSI", "ASUS", "PRIME", "B450", "Z390-A", "Z390-E", "TOMAHAWK", "MAX", "ROG", "X570", "WIFI", "AORUS", "5", "7"])
    models = sorted({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(90)} | {"", "msi!b450"})
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"", "qqq", "x" * 3000, "MSI " * 200})
    catalog = spark.createDataFrame([(m, 1) for m in models + models[:5] + [None]], "model string, name int")
    got = N.best_names(spark.createDataFrame([(n, "z") for n in names + names[:9] + [None]], "name string, model string"), catalog, 0.5, 8)
    rows = got.collect()
    plain = lambda t: " ".join("".join(c if c.isascii() and (c.isalnum() or c in "+- ") else " " for c in t.upper()).split())
    expected = {}
    for n in names:
        score, m = min((-similarity(plain(n), plain(m)), m) for m in models)
        if -score >= 0.5:
            expected[n] = (m, -score)
    assert len(rows) == len(expected) and {r["name"]: (r["model"], r["similarity"]) for r in rows} == expected


def test_empty_tables(spark):
    none = spark.createDataFrame([], "model string")
    assert N.best_names(spark.createDataFrame([("a",)], "name string"), none).count() == 0
    assert N.best_names(spark.createDataFrame([], "name string"), spark.createDataFrame([("a",)], "model string")).count() == 0
