"""Cross-tokenizer alignment against the two libraries and a plain rebuild of groups and links."""

import hashlib
from collections import Counter, defaultdict

import pytest

from lotwise.llm import alignment

SCHEMA = "doc_id long, text string, lang string, n_a long"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    made, held = [], Counter()
    for doc_id, text in rows:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        spans = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
        a_at, b_at = spans(bytes_a), spans(bytes_b)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(a_at) for j, (x, y) in enumerate(b_at) if s < y and x < e]
        shared = sorted({e for _, e in a_at} & {e for _, e in b_at})
        groups = ";".join(",".join(str(i) for i, (_, e) in zip(a, a_at, strict=True) if low < e <= high) + "|" + ",".join(str(j) for j, (_, e) in zip(b, b_at, strict=True) if low < e <= high) for low, high in zip([0, *shared], shared, strict=False))
        made.append((doc_id, a, b, len(shared), links, groups))
        held.update(set(links))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(d, len(a), len(b), g, len(x), sum(held[p] == best[p[0]] for p in x), sum(held[p] for p in x), hashlib.sha256(s.encode()).hexdigest() if s else "") for d, a, b, g, x, s in made]


TEXTS = [
    "Tokenizers cut the same bytes in different ways, don't they?",
    "Ünïcödé und Straße — “Zitat”, 12345 67,8 € 🙂🙂",
    "   three leading spaces, two trailing  ",
    " ",
    "  ",
    "\n\n\ttabs\tand\nlines\r\n",
    "a ▁ b",
    "<|endoftext|> <s> </s> <0x41> <unk>",
    "日本語のテキスト と 한국어",
    "nul\x00byte ﬁ ﬂ    x",
    "antidisestablishmentarianism " * 5,
    "x" * 700,
    "(" * 300 + " " * 40 + ")" * 7,
    "",
    None,
    "Tokenizers cut the same bytes in different ways, don't they?",
]


@pytest.fixture(scope="module")
def rows():
    return [(k if k != 5 else None, t) for k, t in enumerate(TEXTS)]


@pytest.mark.parametrize("hot", [1 << 20, 7, 0])
def test_equals_brute_force(spark, rows, hot):
    docs = spark.createDataFrame([(d, t, "xx", 1) for d, t in rows], SCHEMA).repartition(3)
    made = [tuple(r) for r in alignment.align(docs, hot=hot).select(*COLUMNS).collect()]
    assert sorted(made, key=str) == sorted(brute(rows), key=str)


def test_driver_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 1500]
    made = [tuple(r) for r in alignment.align(docs.where("coalesce(length(text), 0) < 1500")).select(*COLUMNS).collect()]
    assert len(short) > 50
    assert sorted(made, key=str) == sorted(brute(short), key=str)


def test_pair_counts_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a")], "doc_id long, text string")
    found = alignment.pair_counts(docs).collect()
    assert max(r["n"] for r in found) == 3 and all(r["best"] for r in found if r["n"] == 3)
    none = alignment.align(docs.where("doc_id > 9"))
    assert none.columns == COLUMNS and none.count() == 0


def test_long_text(spark):
    text = "word " * 200_000 + "y" * 100_000
    made = alignment.align(spark.createDataFrame([("k", text)], "doc_id string, text string")).first()
    assert made["doc_id"] == "k" and made["n_a"] > 200_000 and made["n_groups"] <= min(made["n_a"], made["n_b"])
    assert made["n_links"] == made["n_a"] + made["n_b"] - made["n_groups"]
