"""The training-data operators against brute force, round trips and held-out accuracy, and on awkward rows."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lotwise.llm import common as C
from lotwise.llm import decontaminate, langid, media_tiff, ngram_join, packing, pii, quality, substring_dedup, token_count, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words string, held_out int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(r.randint(2, 8))) for _ in range(n))


def table(spark, texts):
    """Rows with nulls, extra columns whose names clash, and a repeated row."""
    rows = [(i, t, "en", "site.example.org", 5, 0.5, "w", 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def mixed(spark):
    base = prose(1, 300).split()
    near = [*base]
    near[50] = "changed"
    far = prose(2, 250).split() + base[100:170]
    texts = [(0, None), (1, ""), (2, "   \n\t "), (3, "one two"), (4, "One two"), (5, " ".join(base)), (6, " ".join(near)), (7, " ".join(far)), (8, " ".join(base)), (9, prose(3, 30_000)), (10, "a " * 400), (None, prose(4, 60)), (11, prose(5, 80)), (11, prose(5, 80)), (12, "x" * 5000), (13, "Straße ÉTÉ 日本語 \U0001f600 ok")]
    return table(spark, texts).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def linked(texts, percent=75):
    sets = {i: shingles(t) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and sets[j]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join(spark, mixed, empty):
    got = [tuple(r) for r in ngram_join.ngram_jaccard_join(mixed).select("doc_id", "n_shingles", "component_id").collect()]
    want = linked([(i, t) for i, t in pairs(mixed) if i is not None])
    assert len(got) == mixed.count() and {g[0]: g[1:] for g in got if g[0] is not None} == want
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def test_ngram_join_families(spark):
    """Families of near copies whose members differ from each other more than from their source."""
    r, texts = random.Random(8), []
    for family in range(4):
        base = prose(100 + family, 120).split()
        for _ in range(25):
            own = [*base]
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = prose(r.random(), 1)
            texts.append((len(texts), " ".join(own)))
    got = ngram_join.ngram_jaccard_join(table(spark, texts)).collect()
    assert {g["doc_id"]: (g["n_shingles"], g["component_id"]) for g in got} == linked(texts)


def test_ngram_join_common_shingles(spark):
    """Words in 1-grams: longer and shorter copies whose shared words are all in many other classes too."""
    r = random.Random(3)
    texts = []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(76)]
        sets = [base, base + [f"f{f}own{i}" for i in range(15)], r.sample(base, 60)]
        sets += [r.sample(base, 50) for _ in range(24)]
        texts += [" ".join(x) for x in sets]
    sets = [set(t.split()) for t in texts]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(table(spark, list(enumerate(texts))), width=1).collect()}
    lost = [(a, b) for a, b in sorted(want) if got[a] != got[b]]
    assert not lost
    assert len(set(got.values())) == len(texts) - len(spanning(len(texts), want))


def spanning(n, edges):
    parent, used = list(range(n)), []
    for a, b in sorted(edges):
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        if a != b:
            parent[b] = a
            used.append((a, b))
    return used


def test_decontamination(spark, mixed, empty):
    item_words = pairs(mixed)[5][1].split()
    items = [(1, " ".join(item_words[20:45]).upper() if item_words[20:45] else ""), (2, None), (3, ""), (4, "one, TWO"), (5, prose(77, 30)), (6, " ".join(item_words[30:42]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(LOWER))
    want = set()
    for i, t in pairs(mixed):
        w, hit, found = words(t), set(), set()
        for k, x in items:
            v = words(x)
            size = min(10, len(v))
            for a in range(len(v) - size + 1) if v else ():
                for b in range(len(w) - size + 1):
                    if w[b : b + size] == v[a : a + size]:
                        hit |= {*range(b, b + size)}
                        found.add(k)
        want.add((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    got = {tuple(r) for r in decontaminate.decontaminate(mixed, bench).drop("text_key").collect()}
    assert got == want
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(mixed, bench.limit(0)).collect())


def test_passages(spark, mixed, empty):
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(mixed).collect()}
    assert {5, 6, 7, 8, 11} == set(got)  # 11 is there twice, so each is a copy of the other
    assert got[8]["passages"][0]["end"] == 300 and got[7]["n_repeated"] >= 68 and got[8]["n_links"] > 0
    assert [got[k]["class_id"] for k in (5, 6, 7, 8, 11)] == [5, 6, 7, 5, 11] and got[8]["n_copies"] == got[11]["n_copies"] == 2
    assert {(r["a"], r["b"]) for r in substring_dedup.passage_links(mixed).collect()} >= {(5, 6)}
    assert substring_dedup.repeated_passages(empty).count() == substring_dedup.passage_links(empty).count() == 0


def test_passage_near_a_shared_line(spark):
    """A verbatim passage stays, though other words and a shared line after it make its chain unlike."""
    passage, line, texts = prose(21, 60), prose(22, 24), []
    for k in (0, 1):
        texts.append((k, " ".join([prose(30 + k, 40), passage, prose(40 + k, 40), line, prose(50 + k, 40)])))
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(table(spark, texts)).collect()}
    assert set(got) == {0, 1}
    for r in got.values():
        assert [tuple(x) for x in r["passages"]] == [(40, 100)] and r["n_links"] == 1
    assert [tuple(r) for r in substring_dedup.passage_links(table(spark, texts)).collect()] == [(0, 1)]


def test_all_partners_are_kept(spark):
    """Links between near copies that have exact copies, and of many texts that begin with one passage."""
    start, near = prose(60, 80), prose(61, 120)
    changed = near.split()
    changed[-1] = "changed"
    texts = [(k, start + " " + prose(70 + k, 30)) for k in range(6)] + [(k, near) for k in (10, 11)] + [(k, " ".join(changed)) for k in (20, 21)]
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(table(spark, texts)).collect()}
    links = {(r["a"], r["b"]) for r in substring_dedup.passage_links(table(spark, texts)).collect()}
    assert {10, 11, 20, 21} <= set(got) and (10, 20) in links
    assert all(got[k]["n_links"] == sum(got[k]["class_id"] in x for x in links) for k in got)
    reached = {0}
    for _ in range(6):
        reached |= {y for x in reached for link in links if x in link for y in link}
    assert reached == set(range(6))


def shared_words(texts, least=50):
    """Brute force: of each text the words that lie in an equal run of at least `least` words of another text."""
    split = {i: t.split() for i, t in texts}
    windows = {}
    for i, w in split.items():
        for k in range(len(w) - least + 1):
            windows.setdefault(tuple(w[k : k + least]), set()).add(" ".join(w))
    return {i: {x for k in range(len(w) - least + 1) if len(windows[tuple(w[k : k + least])]) > 1 for x in range(k, k + least)} for i, w in split.items()}


def shared_links(texts, least=50):
    """Brute force: pairs of different texts, by the least id of their copies, that have an equal run of `least` words."""
    windows, ids = {}, {}
    for i, t in texts:
        ids.setdefault(tuple(t.split()), i)
    for w, i in ids.items():
        for k in range(len(w) - least + 1):
            windows.setdefault(w[k : k + least], set()).add(i)
    return {(a, b) for s in windows.values() for a in s for b in s if a < b}


def members_meet(groups):
    """Pairs of the members of each group."""
    members = {}
    for r in groups:
        members.setdefault(r["group_id"], set()).add(r["doc_id"])
    return {(a, b) for s in members.values() for a in s for b in s if a < b}


def test_members_of_a_passage_are_linked_with_each_other(spark, monkeypatch):
    """Texts with runs of common passages, of lengths about the threshold, crowds among them: each pair that shares an equal run, and no other, is a link."""
    monkeypatch.setattr(substring_dedup, "BLOCK", 16)
    monkeypatch.setattr(substring_dedup, "PAIRED", 8)
    r = random.Random(77)
    runs = [prose(7000 + k, 90).split() for k in range(6)]
    texts = []
    for i in range(90):
        words = prose(7100 + i, 20).split()
        for k in r.sample(range(6), r.choice([1, 1, 2, 3])):
            # the first passage stands in most texts
            run, x = runs[0 if r.random() < 0.6 else k], r.randint(0, 45)
            words += run[x : x + r.choice([30, 45, 49, 50, 51, 56, 60, 90])] + prose(9000 + 10 * i + k, 12).split()
        texts.append((i, " ".join(words)))
    texts += [(1000, texts[3][1]), (1001, texts[3][1])]
    want = shared_links(texts)
    got = {x["doc_id"]: x for x in substring_dedup.repeated_passages(table(spark, texts)).collect()}
    assert {tuple(x) for x in substring_dedup.passage_links(table(spark, texts)).collect()} == want and len(want) > 400
    assert members_meet(substring_dedup.passage_groups(table(spark, texts)).collect()) == want
    for i, t in texts:
        links = sum((3 if i >= 1000 else i) in x for x in want)
        assert got[i]["n_links"] == links if links else i not in got or not got[i]["n_links"]
    surely = shared_words(texts)
    assert all(surely[i] <= {w for s, e in got[i]["passages"] for w in range(s, e)} for i, _ in texts if surely[i])


def test_near_copies_are_linked_with_each_other(spark):
    """Texts with other words changed each, so that no two share an equal run of 50 words: all pairs are links, not only those with one of them."""
    base, texts = prose(8000, 140).split(), []
    for i in range(9):
        words = [*base]
        # each changes a place of its own, and all change every 35th word
        for k in [*range(20, 140, 35), 5 + 14 * i]:
            words[k] = f"w{i}x{k}"
        texts.append((i, " ".join(words)))
    assert not shared_links(texts)
    got = {tuple(x) for x in substring_dedup.passage_links(table(spark, texts)).collect()}
    assert got == {(a, b) for a in range(9) for b in range(a + 1, 9)}
    assert all(x["n_links"] == 8 for x in substring_dedup.repeated_passages(table(spark, texts)).collect())


def test_passage_whose_parts_are_common(spark):
    """Parts of shared passages stand in many other texts too: every pair is found, and the other texts aren't."""
    texts, k = [], 1000
    for p in range(20):
        passage = prose(700 + p, 64).split()
        texts += [(2 * p + c, " ".join([prose(800 + 2 * p + c, 30), *passage, prose(900 + 2 * p + c, 30)])) for c in (0, 1)]
        for x in range(0, 50, 7):
            for y in range(6):
                texts.append((k, " ".join([prose(2000 + k, 30), *passage[x : x + 15], prose(9000 + k, 30)])))
                k += 1
    got = {r["doc_id"]: {w for s, e in r["passages"] for w in range(s, e)} for r in substring_dedup.repeated_passages(table(spark, texts)).collect()}
    want = {i: w for i, w in shared_words(texts).items() if w}
    assert set(got) == set(want) == set(range(40))
    assert all(got[i] == want[i] for i in want)


def test_passages_by_brute_force(spark):
    """Texts put together from shared and own runs: all that an exact run of 64 words covers is found, and nothing where no run of 43 words is shared."""
    r = random.Random(5)
    runs = [prose(300 + k, r.randint(20, 120)).split() for k in range(25)]
    texts = []
    for i in range(120):
        words = []
        for _ in range(r.randint(1, 4)):
            run = r.choice(runs)
            x = r.randint(0, len(run) - 10)
            words += prose(4000 + r.randint(0, 10**6), r.randint(5, 40)).split() + run[x : x + r.randint(10, 120)]
        texts.append((i, " ".join(words)))
    texts += [(i + 500, t) for i, t in texts[:4]]
    got = {r["doc_id"]: {w for s, e in r["passages"] for w in range(s, e)} for r in substring_dedup.repeated_passages(table(spark, texts)).collect()}
    surely, at_most, copies = shared_words(texts, 64), shared_words(texts, 43), [i for i, _ in texts if i >= 500 or i < 4]
    for i, t in texts:
        assert surely[i] <= got.get(i, set())
        if i in copies:
            assert i not in got or len(t.split()) >= 50
        elif not at_most[i]:
            assert i not in got


@pytest.mark.parametrize("turn", [0, 1])
def test_passage_that_stands_twice(spark, turn):
    passage = prose(80 + turn, 60)
    texts = [(0, " ".join([prose(90, 30), passage, prose(91, 50), passage, prose(92, 30)])), (1, " ".join([prose(93, 35), passage, prose(94, 35)]))]
    texts += [(2, "b " * 400), (3, "b " * 900)]
    got = {r["doc_id"]: [tuple(x) for x in r["passages"]] for r in substring_dedup.repeated_passages(table(spark, texts)).collect()}
    assert got == {0: [(30, 90), (140, 200)], 1: [(35, 95)], 2: [(0, 400)], 3: [(0, 900)]}


def test_chains_are_collinear():
    place, other = np.array([0, 9, 18, 30, 40]), np.array([100, 109, 5, 130, 140])
    chains = substring_dedup.chain(place, other, 20)
    assert [c.tolist() for c in chains] == [[0, 1, 3, 4]]
    a = np.arange(60, dtype=np.uint32)
    b = np.r_[np.arange(30), [999], np.arange(31, 60)].astype(np.uint32)
    assert substring_dedup.align(a, b, np.array([2, 40]), np.array([2, 40])) == (0, 60, 0, 60, 59)


def test_single_ties_are_aligned_as_chains():
    """All chains of one tie at once, against one by one: texts of few words that agree around the tie, near their ends too."""
    r = np.random.default_rng(9)
    a, b, a_at, b_at, places, others, want = [], [], [0], [0], [], [], []
    for k in range(400):
        p, o = int(r.integers(0, 70)), int(r.integers(0, 70))
        x, y = (r.integers(0, 30 if k % 2 else 10**6, n + 8 + int(r.integers(0, 70)), np.uint32) for n in (p, o))
        low, high = min(p, o), min(len(x) - p, len(y) - o)
        y[o - low : o + high] = np.where(r.random(low + high) < r.choice([0.05, 0.2, 0.5]), y[o - low : o + high], x[p - low : p + high])
        y[o : o + 8] = x[p : p + 8]
        for w, at, one in ((a, a_at, x), (b, b_at, y)):
            w.append(one)
            at.append(at[-1] + len(one))
        places.append(p)
        others.append(o)
        want += [(k, p - i, j - p) for i, j, _, _, _ in substring_dedup.alike(x, y, np.array([p]), np.array([o]), 43)]
    got = substring_dedup.alike_singles(np.concatenate(a), np.array(a_at), np.concatenate(b), np.array(b_at), np.array(places), np.array(others), 43)
    assert [*zip(*(g.tolist() for g in got), strict=True)] == want and len(want) > 40


def test_tokens_as_the_library(spark, mixed, empty):
    import public_tokenizers
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(100, "aaaaaaaaaaa aaaa   \n\n  it's <|endoftext|> x<|endoftext|>"), (101, "\x1c\x1d \x85   ½²  é १२३")]
    df = table(spark, pairs(mixed) + extra)
    for r, (i, t) in zip(token_count.token_counts(df).collect(), pairs(df), strict=True):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert tuple(r) == (i, len((t or "").encode()), n, n > 1024)
    assert token_count.token_counts(empty).count() == 0


def test_tiff_texts(spark, mixed, empty):
    got = media_tiff.text_media(mixed).collect()
    for r, (i, t) in zip(got, pairs(mixed), strict=True):
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert media_tiff.text_media(empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_coders(raw):
    raw = raw + raw[:50] * 9
    assert media_tiff.packbits_decode(media_tiff.packbits_encode(raw)) == raw
    assert media_tiff.lzw_decode(media_tiff.lzw_encode(raw)) == raw


@pytest.mark.parametrize("n", [*range(250, 262), *range(505, 520), 1020, 1021, 1022, 1023, 1024, 4094, 20_000])
def test_lzw_widths(n):
    raw = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    assert media_tiff.lzw_decode(media_tiff.lzw_encode(raw)) == raw


@pytest.mark.parametrize("compression", [media_tiff.NONE, media_tiff.LZW, media_tiff.DEFLATE, media_tiff.PACKBITS])
@pytest.mark.parametrize("tile", [0, 16])
def test_tiff_pages(spark, compression, tile):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 4, (37, 50)).astype(np.uint8), rng.integers(0, 256, (70, 33, 3)).astype(np.uint8)]
    for predictor, order in ((1, "<"), (2, ">")):
        file = media_tiff.write_tiff(pages, compression, predictor, strip_rows=9, tile=tile, order=order)
        back = [p.reshape(q.shape) for (_, _, p), q in zip(media_tiff.read_pages(file), pages, strict=True)]
        assert all((a == b).all() for a, b in zip(back, pages, strict=True))


def test_tiff_rows(spark):
    good = media_tiff.write_tiff([np.zeros((2, 3), np.uint8)] * 2)
    df = spark.createDataFrame([(1, bytearray(good), 9), (2, bytearray(b"no"), 9), (3, None, 9), (4, bytearray(good[:-20]), 9)], "id int, media binary, page int")
    got = media_tiff.tiff_pages(df).groupBy("id").agg(F.count("page").alias("n"), F.max("error").alias("e")).orderBy("id").collect()
    assert [r["n"] for r in got][:3] == [2, 0, 0] and got[1]["e"] and got[2]["e"] is None and got[3]["e"]


def naive_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@@..+-_ 0123456789()é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == naive_spans(text)


def test_pii(spark, mixed, empty):
    shown = [(20, "write to jo.doe@mail.example.org or +1 (202) 555-0143 now"), (21, "card 4111 1111 1111 1111, host 10.0.0.1 ok"), (22, "é" * 300 + " 4111111111111111")]
    df = table(spark, pairs(mixed) + shown)
    got = [tuple(r) for r in pii.op_result(pii.find_pii(df)).collect()]
    for (i, t), r in zip(pairs(df), got, strict=True):
        base = [f"{k}:{s}:{e}" for s, e, k in naive_spans(t or "")]
        assert r[0] == i and r[5] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r[6].split(","))
    clean = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert "@" not in clean[20]["text"] and clean[21]["text"] == "card [CARD], host [IP] ok" and clean[21]["n_chars"] == 25
    assert clean[0]["text"] is None and pii.redact(df).columns == df.columns and pii.find_pii(empty).count() == 0


def test_network_learns_hidden_spans():
    rng = np.random.default_rng(5)
    samples = [(prose(k, 12) + " ", f"{prose(k + 50, 1)}.{k}@mail{k % 9}.example.com", " " + prose(k + 90, 12), "email") for k in range(60)]
    tagger = pii.train(samples)
    hidden = [(prose(k + 500, 12) + " ", f"{prose(k + 600, 1)}{k} [at] mail{k % 9} [dot] example [dot] com".replace("é", "e"), " " + prose(k + 700, 12)) for k in range(40)]
    texts = [a + b + c for a, b, c in hidden]
    found = pii.added_spans(texts, [pii.base_spans(t) for t in texts], tagger)
    hits = sum(any(s >= len(a) - 1 and e <= len(a) + len(b) + 1 and kind == "email" for s, e, kind in f) for f, (a, b, _) in zip(found, hidden, strict=True))
    assert hits >= 30
    plain = [prose(k + 900, 60) + " 17 at the 4.0 dot" for k in range(40)]
    assert sum(map(len, pii.added_spans(plain, [[] for _ in plain], tagger))) <= 2
    x, y = pii.training_windows(samples, 6, rng)
    fresh = pii.Tagger(pii.Tagger.fresh(rng))
    _, grad = fresh.step(x, y)
    for name, at in (("xf", (2, 3)), ("hb", (1, 5)), ("move", (0, 1)), ("out", (3, 2))):
        kept = fresh.p[name][at]
        values = []
        for d in (1e-5, -1e-5):
            fresh.p[name][at] = kept + d
            values.append(fresh.step(x, y)[0])
        fresh.p[name][at] = kept
        assert grad[name][at] == pytest.approx((values[0] - values[1]) / 2e-5, rel=1e-3, abs=1e-6)


def labelled(spark):
    r, docs, labels = random.Random(4), [], []
    for i in range(400):
        words = prose(i, 60).split()
        toxic, bad = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(60), r.choice(["idiot", "stupid", "zurgh", "blarfo"]))
        if bad:
            words = [w + "$$$" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return table(spark, docs + [(1000, None), (1001, "")]), spark.createDataFrame(labels + [labels[0], (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_classifiers(spark, empty):
    docs, labels = labelled(spark)
    for f, label in ((toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")):
        got = f(docs, labels)
        assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
        held = got.where("held_out").join(labels.where(f"{label} is not null").groupBy("doc_id").agg(F.max(label).alias(label)), "doc_id").collect()
        assert len(held) > 50 and sum(r["predicted"] == r[label] for r in held) >= 0.95 * len(held)
        assert all(0 <= r["score"] <= 1 for r in got.collect())
        assert f(empty, labels).count() == 0 and f(docs, labels.limit(0)).count() == docs.count()


def test_held_out_labels_are_unseen(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, x).collect()} for x in (labels, flipped))
    assert one == two


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="idotscum", min_size=2, max_size=8))
def test_automaton(word):
    terms = ("idiot", "scum", "stoic", "custom")

    def edits(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    near = sorted((edits(word, t), k) for k, t in enumerate(terms) if edits(word, t) <= (1 if len(t) >= 5 else 0))
    found = toxicity.Lexicon(terms).closest(word)
    assert found == ((near[0][1], near[0][0]) if near else (-1, 0))
    if near:
        finder, raw = toxicity.Finder(terms), np.frombuffer(word.encode(), np.uint8)
        assert len(finder.candidates(raw, np.array([0]), np.array([len(raw)]))) == 1


def test_quoted_terms_count_less():
    rows = toxicity.Finder(("idiot",)).features(*_bytes(["you are an idiot", 'she said he wrote "that idiot there" and left', "you are an idoit"]))
    assert rows[0][0] > rows[1][0] and rows[1][1] > rows[0][1] and rows[2][2] > 0


def _bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]


def test_language(spark, mixed, empty):
    en, fr = "the and of that with river stone house under over", "le la les des une avec dans pour maison rivière"
    rows = [(i, " ".join(random.Random(i).choices((en, fr)[i % 2].split(), k=40)), ("en", "fr")[i % 2], "a.fr" if i % 2 else "b.com") for i in range(60)]
    rows += [(100, rows[0][1], "fr", "a.fr"), (101, None, "en", None), (102, "12 34", None, "b.com"), (103, "the", "en", "b.com"), (None, rows[1][1], None, None)]
    df = spark.createDataFrame([(*r, 3, 0.1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, confidence double")
    got = {r["doc_id"]: r for r in langid.language_id(df).collect()}
    assert all(got[i]["language"] == ("en", "fr")[i % 2] for i in range(60))
    assert got[100]["language"] == "en" and got[None]["language"] == "fr" and got[103]["accepted"] and not got[101]["accepted"] and got[102]["language"] is None
    assert langid.language_id(empty).count() == 0 and langid.language_id(mixed).count() == mixed.count()
    kept = langid.keep_languages(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["accepted"]}
    pages = spark.createDataFrame([(1, "http://x.example.fr/a", '<html lang="FR-be"><script>no</script><p>le la</p>')], "page_id long, url string, html string")
    r = langid.page_texts(pages).first()
    assert (r["lang"], r["source"], r["text"].split()) == ("fr", "x.example.fr", ["le", "la"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_best_fit(lengths):
    lengths.sort(reverse=True)
    bins, offsets, sizes = packing.best_fit(lengths, (10, 40, 100), 2)
    used = collections.Counter()
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        assert o == used[b]
        used[b] += n
    assert all(used[b] <= s and (s == 10 or used[b] > {40: 10, 100: 40}[s]) for b, s in enumerate(sizes))


def test_packing(spark, mixed, empty):
    got = packing.pack(mixed, capacities=(256, 1024)).collect()
    assert sum(r["length"] for r in got) == sum(len((t or "").encode()) + 1 for _, t in pairs(mixed))
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r["bin_offset"])
        ends = [r["bin_offset"] + r["length"] for r in rows]
        assert [r["bin_offset"] for r in rows] == [0, *ends[:-1]] and ends[-1] == rows[0]["bin_used"] <= rows[0]["bin_capacity"]
    assert packing.pack(empty).count() == 0
    zero = packing.pack(mixed, length=F.lit(0)).collect()
    assert len(zero) == mixed.count() and all(r["bin_id"] is None for r in zero)


def best_fit_twin(lengths, capacities, overhead):
    """Brute force: every open bin is looked at for every piece."""
    bins, out, rest = [], [], sum(lengths)
    for n in lengths:
        fits = [(b["free"], k) for k, b in enumerate(bins) if b["free"] >= n]
        if not fits:
            size = min((c for c in capacities if c >= n), key=lambda c: ((c + overhead) / min(c, rest), c))
            bins.append({"free": size, "used": 0})
            fits = [(size, len(bins) - 1)]
        k = min(fits)[1]
        out.append((k, bins[k]["used"]))
        bins[k]["free"] -= n
        bins[k]["used"] += n
        rest -= n
    return out, [min(c for c in capacities if c >= b["used"]) for b in bins]


def test_packing_as_brute_force_and_ids(spark):
    """One group's bins are those of the twin; ids come back as they are: null, very large, repeated, strings; repeated rows are dealt out."""
    r = random.Random(4)
    rows = [(2**60 + 7, "a" * 30), (2**60 + 9, "b" * 30), (None, "c" * 30), (None, "c" * 30), (-1, None)] + [(k, "x" * r.randint(0, 250)) for k in range(60)] + [(3, "same")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, capacities=(64, 128), overhead=4).collect()
    assert collections.Counter(r["doc_id"] for r in got if r["piece"] == 0) == collections.Counter(i for i, _ in rows)
    got.sort(key=lambda r: (r["bin_id"], r["bin_offset"]))
    lengths = sorted((r["length"] for r in got), reverse=True)
    placed, sizes = best_fit_twin(lengths, (64, 128), 4)
    assert collections.Counter((r["length"], r["bin_offset"], r["bin_capacity"]) for r in got) == collections.Counter((n, at, sizes[k]) for n, (k, at) in zip(lengths, placed, strict=True))
    many = packing.pack(spark.createDataFrame([("id", "w" * 99)] * 3000, "doc_id string, text string"), capacities=(100, 200), group_bins=4).collect()
    assert {r["doc_id"] for r in many} == {"id"} and len({r["bin_id"] >> 24 for r in many}) > 50


def test_jaccard_join_of_hot_lists(spark):
    """Lists cut into shares of two classes, families of unequal size over shared passages, against brute force."""
    r = random.Random(8)
    commons = [prose(50 + k, 25) for k in range(4)]
    texts = []
    for f in range(14):
        base = prose(100 + f, r.randint(12, 80)).split() + r.choice(commons).split()
        for _ in range(r.randint(1, 7)):
            words = base[: len(base) - r.randint(0, len(base) // 6)] + prose(r.randint(0, 10**6), r.randint(0, len(base) // 5)).split()
            if r.random() < 0.4:
                words[r.randrange(len(words))] = "changed"
            texts.append((len(texts), " ".join(words)))
    texts += [(900 + k, texts[k][1]) for k in range(9)] + [(950 + k, commons[k % 4]) for k in range(7)]
    r.shuffle(texts)
    for share in (2, 4096):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.ngram_jaccard_join(table(spark, texts).repartition(5), share=share).collect()}
        assert got == linked(texts)


def test_language_counts_every_declaration(spark):
    """More kinds of declaration than any limit, and a language that is rare in the corpus."""
    rows = [(k, prose(k, 40), f"x{k}" if k % 2 else "aa", "h", 1, 0.0, "", 0) for k in range(600)] + [(1000 + k, "ωδε " * 30 + prose(k, 3), "el", "h", 1, 0.0, "", 0) for k in range(6)]
    got = {r["doc_id"]: r for r in langid.language_id(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 606 and all(got[1000 + k]["language"] == "el" for k in range(6)) and got[0]["language"] == "aa"


def test_lookup_of_many_keys(spark, monkeypatch):
    """Beyond the broadcast's size hot keys are broadcast, the others shuffled, and null keys find nothing."""
    monkeypatch.setattr(C, "BROADCAST_ROWS", 10)
    keys = [k % 50 if k % 3 else 7 for k in range(600)]
    rows = spark.createDataFrame([(k, None if k % 11 == 0 else key) for k, key in enumerate(keys)], "id long, key long")
    table_ = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).withColumn("value", F.col("key") * 2)
    for least in (0, 49):
        got = C.looked_up(rows, table_.where(F.col("key") >= least), "key", "n", "id").collect()
        assert {(r["id"], r["value"]) for r in got} == {(k, 2 * key if k % 11 and key >= least else None) for k, key in enumerate(keys)} and len(got) == 600


def test_many_deals_in_few_partitions(spark, mixed, monkeypatch):
    """Several deals in one partition, one after the other: the same results."""
    want = [sorted(map(str, f(mixed).collect())) for f in (ngram_join.ngram_jaccard_join, substring_dedup.repeated_passages)]
    monkeypatch.setattr(C, "DEAL_BYTES", 5000)
    monkeypatch.setattr(C, "MOST_PARTS", 3)
    assert C.deals_for(mixed) > 20
    assert [sorted(map(str, f(mixed).collect())) for f in (ngram_join.ngram_jaccard_join, substring_dedup.repeated_passages)] == want


def test_bounded_samples(spark):
    """Of a doc_id that stands a great many times one row is a sample's; string ids work throughout."""
    docs = spark.range(5000).select(F.when(F.col("id") < 4900, F.lit("many")).otherwise(F.col("id").cast("string")).alias("doc_id"), F.concat(F.lit("text of words "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.length("doc_id") % 2).cast("int").alias("quality"), F.lit(1).alias("toxic")).distinct()
    for f, label in ((quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")):
        from lotwise.llm import learn

        sample = learn.training_rows(docs, labels, label, 50)
        assert sample.count() == min(50, sample.select("doc_id").distinct().count()) <= 50
        assert f(docs.where("doc_id <> 'many'"), labels).count() == 100


@pytest.mark.parametrize("word", ["idi€t", "idio€t", "stup€id", "路idiot", "IDIOT", "ÉCRIVAÎN", "écrivein"])
def test_misspellings_in_characters(word):
    finder = toxicity.Finder(("idiot", "stupid", "écrivain"))
    x = finder.features(*C.utf8(toxicity.folded(pa.array([f"you are {word} and so on"]))))
    assert x[0, [0, 1, 2, 3]].sum() > 0


def test_upper_case_spellings_are_read():
    assert pii.stretches("write to JANE.DOE [AT] EXAMPLE [DOT] ORG now", []) and pii._SHAPE["email"].search("JANE.DOE [AT] EXAMPLE [DOT] ORG") and pii._SHAPE["email"].search("JANE AT EXAMPLE DOT ORG")


def test_decontamination_keeps_repeated_rows(spark):
    """A window in very many rows, rows alike in all, and null ids: each row is returned by itself."""
    passage = prose(77, 12)
    rows = [(5, passage)] * 40 + [(None, passage)] * 30 + [(k, prose(k, 20)) for k in range(100, 120)] + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("a", passage), ("b", prose(78, 30))], "item_id string, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    assert collections.Counter((r["doc_id"], r["n_hit"]) for r in got) == collections.Counter((i, 12 if t == passage else 0) for i, t in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_network_on_hidden_spellings(spark):
    """Spans of the driver's documents respelled: most are found again, and nothing else is taken for a span, in documents without any either."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    tagger = pii.fit(docs.select("doc_id", "text"))
    rng = np.random.default_rng(5)
    found = hidden = elsewhere = 0
    for (text,) in docs.where("text is not null").orderBy(F.xxhash64("doc_id").desc()).limit(400).select("text").collect():
        out, at, where = "", 0, []
        for s, e, kind in pii.base_spans(text):
            if s >= at:
                out += text[at:s]
                where.append((len(out), kind))
                out += pii._variants(text[s:e], kind, rng)
                where[-1] += (len(out),)
                at = e
        out += text[at:]
        base = pii.base_spans(out)
        added = pii.added_spans([out], [base], tagger)[0]
        left = [(s, e, k) for s, k, e in where if (s, e) not in {x[:2] for x in base}]
        hidden += len(left)
        found += sum(any(s < z and a < e and k == kind for a, z, kind in added) for s, e, k in left)
        elsewhere += sum(not any(s < z and a < e for s, e, _ in left) for a, z, _ in added)
    assert hidden >= 20 and found >= 0.6 * hidden and elsewhere <= 1


def test_long_pretokens_as_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    own = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    r = random.Random(3)
    texts = ["".join(r.choice("abcdeést") for _ in range(n)) for n in (513, 900, 4000)] + ["a" * 3001, "ab" * 1500, "the" * 700, "!" * 2000]
    assert token_count.count_tokens(texts, "byte_bpe_50k.json") == [len(own.encode(t, add_special_tokens=False).ids) for t in texts]


def test_forms_of_texts(spark):
    """Every way of storing occurs, equal texts are stored alike, and what is read back is the text."""
    docs = spark.createDataFrame([(k, prose(k % 60, 1 + k % 60 * 3)) for k in range(120)], "doc_id long, text string")
    files = media_tiff.texts_to_tiff(docs, "doc_id", "text")
    pages = media_tiff.tiff_pages(files).collect()
    assert {r["compression"] for r in pages} == {media_tiff.LZW, media_tiff.PACKBITS, media_tiff.DEFLATE} and {r["predictor"] for r in pages} == {1, 2}
    assert len({bytes(r["media"])[:2] for r in files.collect()}) == 2
    got = {r["doc_id"]: bytes(r["pixels"]).rstrip(b" ").decode() for r in pages}
    assert got == {r["doc_id"]: r["text"] for r in docs.collect()}
    stored = {r["doc_id"]: r["media_sha256"] for r in media_tiff.text_media(docs).collect()}
    assert all(stored[k] == stored[k + 60] for k in range(60))


def test_pipeline_keeps_both_texts_of_an_id(spark):
    """A doc_id with two texts: both stay where nothing links them, one where they link; rows alike stay once."""
    a, b = prose(1, 60), prose(2, 60)
    docs = table(spark, [(1, a), (1, b), (2, a + " more"), (3, prose(3, 50)), (3, prose(3, 50)), (4, prose(4, 60)), (4, prose(4, 60) + " end"), (None, a)])
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect())
    rest = {k: v for k, v in got.items() if k[0] != 4}
    assert rest == {(1, a): 1, (1, b): 1, (3, prose(3, 50)): 1, (None, a): 1} and sum(v for k, v in got.items() if k[0] == 4) == 1


def test_pipeline_stages(spark, tmp_path):
    base = [(i, prose(i, 60)) for i in range(30)]
    words = base[4][1].split()
    base += [(50, base[3][1]), (51, prose(90, 30) + " " + base[2][1]), (52, prose(91, 60) + " mail me at jo.x@mail.example.org"), (53, "7 7 7"), (54, None)]
    docs = table(spark, base).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(words[10:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        before, after = {r["doc_id"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        want = {"language_id": {53, 54}, "ngram_jaccard_join": {50}, "benchmark_decontamination": {4}, "pii": set()}[name]
        assert before - set(after) == want
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert after[52].endswith("mail me at [EMAIL]")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(after)
