"""Toxicity: a Levenshtein automaton walked along a lexicon's trie finds abusive terms and their misspellings; what stands
around each of them tells quotation from abuse.

A word is looked up once for each task: words that have neither the front nor the back half of a term can't be within
one edit of it and are passed over in numpy; for the others, the automaton of the word is intersected with the trie. Each
hit is scored by its context window; the window scores of a document and their density are the inputs of a small logistic
model. The lexicon is a list of everyday terms and, as abuse differs by language and community, terms learned from labelled rows:
words of toxic documents that hardly any clean one has and that stand after many different words (which what is copied along does not).
Lexicon and model are fitted on a bounded sample of labelled rows. Terms learned from a document would flatter its own hits, so the model's inputs come from
two halves of the sample, each read with the terms that the other half teaches; the lexicon used in the end is learned from both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import learn

#: The lexicon (a parameter): everyday terms of abuse.
LEXICON = (
    "bastard", "brainless", "clown", "coward", "creep", "cretin", "disgusting", "dimwit", "dumbass", "filthy", "fool", "freak",
    "garbage", "halfwit", "hateful", "idiot", "ignorant", "imbecile", "jerk", "liar", "loser", "lowlife", "maggot", "moron", "nasty", "nitwit", "parasite",
    "pathetic", "pervert", "pig", "rat", "repulsive", "retard", "scum", "scumbag", "shithead", "skank", "sleazy", "slimy", "stupid", "swine", "trash", "twerp",
    "ugly", "vermin", "vile", "wimp", "worthless", "wretched",
)
#: Labelled rows that lexicon and model are fitted on at most.
SAMPLE_ROWS = 20_000
#: Learned terms at most; a learned term stands after this many different words and has this share of toxic documents.
LEARNED, NEIGHBOURS, SHARE = 2000, 4, 0.85
#: Shorter terms count only as they are spelled.
EDIT_FROM = 5
#: Words to either side of a hit that make up its context.
WINDOW = 12
#: Looked-up words that a task keeps.
KEPT = 200_000
#: Bytes between words; and between spellings that marks hold together, which are looked up too if none of their words is a hit.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
OUTER = bytes(b for b in SEPARATORS if chr(b) not in "'-@")
_REPORTED = re.compile(r"\b(?:said|says|wrote|writes|called|calls|quoted?|quotes|according|reported|reports|replied|asked|claimed|dit|sagte|dijo)\b")
_DIRECT = re.compile(r"\b(?:you|your|you're|youre|ur|u|all of you|du|tu|vous)\b")
#: Quotation marks of folded texts: an apostrophe between letters is none.
_MARKS = re.compile("\"|(?<![^\\W_])'|'(?![^\\W_])")
#: What punctuation beyond ASCII is folded to.
FOLDED = (("[\u201c-\u201f\u00ab\u00bb\u2039\u203a\u300c-\u300f\u301d-\u301f\uff02]", '"'), ("[\u2018-\u201b\u02bc\uff07]", "'"), ("[\u2010\u2011]", "-"), ("[\u00a1\u00b7\u00bf\u2000-\u206f\u3000-\u303f\uff01-\uff0f\uff1a-\uff20]", " "))
FEATURES = ["exact_abuse", "exact_quote", "near_abuse", "near_quote", "density", "any_exact", "many", "kinds", "clustered", "direct"]


class Lexicon:
    """A trie of terms, intersected with the automaton of a word."""

    def __init__(self, terms: tuple[str, ...], edits: int = 1) -> None:
        self.terms, self.edits = terms, edits
        self.longest = max(map(len, terms), default=0)
        self.trie: dict = {}
        for k, term in enumerate(terms):
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = k

    def closest(self, word: str) -> tuple[int, int]:
        """(term, edits) of the nearest term within reach, the first of equals; (-1, 0) if there is none.

        The automaton's state after some letters of a term is the band of edit distances to the word's prefixes of about that length; a branch ends
        where every distance is over the bound, and where one edit more would be, only letters of the band are tried. Two neighbours that are swapped are one edit. Short terms allow none.
        """
        k, n = self.edits, len(word)
        best, far = (k + 1, -1), k + 1
        if n > self.longest + k:
            return -1, 0
        # (node, letters so far, distances to the prefixes of `depth - k` to `depth + k` letters, the same a letter before, last letter)
        stack = [(self.trie, 0, tuple(min(j, far) if 0 <= j <= n else far for j in range(-k, k + 1)), None, "")]
        while stack:
            node, depth, row, before, last = stack.pop()
            term = node.get("")
            if term is not None and 0 <= n - depth + k <= 2 * k and row[n - depth + k] <= (k if len(self.terms[term]) >= EDIT_FROM else 0):
                best = min(best, (row[n - depth + k], term))
            near = node if min(row) < k else {word[j] for j in range(max(0, depth - k - 1), min(n, depth + k + 1))} & node.keys()
            for c in near:
                if c == "":
                    continue
                new, left = [], far
                for p in range(2 * k + 1):
                    j = depth + 1 - k + p
                    if j < 0 or j > n:
                        left = far
                    elif j == 0:
                        left = min(depth + 1, far)
                    else:
                        left = min(left + 1, row[p] + (word[j - 1] != c), row[p + 1] + 1 if p < 2 * k else far)
                        if before is not None and j > 1 and word[j - 1] == last and word[j - 2] == c:
                            left = min(left, before[p] + 1)
                    new.append(left)
                if min(new) <= k:
                    stack.append((node[c], depth + 1, tuple(new), row, c))
        return (best[1], best[0]) if best[1] >= 0 else (-1, 0)


class Finder:
    """Hits of a lexicon in batches of UTF-8 texts."""

    def __init__(self, terms: tuple[str, ...] = LEXICON, edits: int = 1) -> None:
        self.lexicon = Lexicon(terms, edits)
        self.is_word, self.same = C.byte_table(SEPARATORS)
        self.is_outer, _ = C.byte_table(OUTER)
        self.halves: dict[tuple[bool, int], np.ndarray] = {}
        for term in terms:
            exact = len(term) < EDIT_FROM or edits == 0
            cut = len(term) if exact else len(term) // 2
            swapped = term[: cut - 1] + term[cut] + term[cut - 1] + term[cut + 1 :] if 0 < cut < len(term) else term
            for form in {term, swapped}:
                raw, reach = form.encode(), 0 if exact else edits
                at = len(form[:cut].encode())
                for back, half in ((False, raw[:at][:8]), (True, raw[at:][-8:])):
                    for n in range(max(1, len(form) - reach), len(form) + reach + 1) if half else ():
                        table = self.halves.setdefault((back, len(half)), np.zeros(1 << 20, bool))
                        table[self._place(np.array([int.from_bytes(half, "little")], np.uint64), np.array([n]))] = True
        self.every = edits > 1
        self.known: dict[int, int] = {}

    @staticmethod
    def _place(half: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (C.mix(half ^ length.astype(np.uint64) << np.uint64(56)) >> np.uint64(44)).astype(np.int64)

    def candidates(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Words that may be near a term: one edit leaves the front or the back half of the term as it is."""
        # in characters: bytes that don't continue one
        begun = np.r_[0, np.cumsum((low & 0xC0) != 0x80)]
        length = begun[ends] - begun[starts]
        fits = length <= self.lexicon.longest + self.lexicon.edits
        if self.every:
            return np.flatnonzero(fits)
        padded = np.zeros(len(low) + 8, np.uint8)
        padded[:-8] = low
        eight = np.ndarray((len(low) + 1,), "<u8", padded, strides=(1,))
        near = np.zeros(len(starts), bool)
        for (back, n), table in self.halves.items():
            at = np.maximum(ends - n, 0) if back else starts
            near |= table[self._place(eight[at] & C._KEEP[n], length)]
        return np.flatnonzero(near & fits)

    def look_up(self, hashes: np.ndarray, word_of) -> np.ndarray:
        """Of each hash 2 * term + edits, or -1."""
        out = np.empty(len(hashes), np.int64)
        for k, h in enumerate(hashes.tolist()):
            found = self.known.get(h)
            if found is None:
                term, d = self.lexicon.closest(word_of(k))
                found = self.known[h] = -1 if term < 0 else 2 * term + min(d, 1)
                if len(self.known) > KEPT:
                    self.known.clear()
            out[k] = found
        return out

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """FEATURES of each text; texts come folded."""
        out = [np.zeros((0, len(FEATURES)))]
        for i, j in C.steps(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, first = C.word_bounds(part, at, self.is_word)
            n = np.diff(first)
            rows = np.zeros((j - i, len(FEATURES)))
            low = self.same[part]
            # spellings of several words that marks hold together, each in the place of its first word
            outer, until, _ = C.word_bounds(part, at, self.is_outer)
            begin, words = np.searchsorted(starts, outer), np.searchsorted(starts, until)
            joined = words - begin > 1
            begin, words = begin[joined], words[joined]
            place_of, all_starts, all_ends = np.r_[np.arange(len(starts)), begin], np.r_[starts, outer[joined]], np.r_[ends, until[joined]]
            could = self.candidates(low, all_starts, all_ends)
            hashes = C.word_hashes(part, all_starts[could], all_ends[could], self.same)
            distinct, sample, place = np.unique(hashes, return_index=True, return_inverse=True)
            found = self.look_up(distinct, lambda k, c=could, x=sample: low[all_starts[c[x[k]]] : all_ends[c[x[k]]]].tobytes().decode("utf-8", "replace"))
            hit = found[place] >= 0
            where, what = could[hit], found[place][hit]
            single = where < len(starts)
            hits = np.sort(where[single])
            group = where[~single] - len(starts)
            alone = np.searchsorted(hits, begin[group]) == np.searchsorted(hits, words[group])
            keep = np.r_[np.flatnonzero(single), np.flatnonzero(~single)[alone]]
            where, what = place_of[where[keep]], what[keep]
            order = np.argsort(where, kind="stable")
            where, what = where[order], what[order]
            doc = np.searchsorted(first, where, "right") - 1
            own = np.searchsorted(doc, np.arange(j - i + 1))
            for d in np.flatnonzero(np.diff(own)):
                mine = slice(own[d], own[d + 1])
                rows[d] = self._document(low, at[d], at[d + 1], starts, ends, first[d], first[d + 1], where[mine], what[mine])
            rows[:, 4] /= np.maximum(n, 20)
            out.append(rows)
        return np.concatenate(out)

    @staticmethod
    def _document(low, begin, end, starts, ends, first, last, where, what) -> np.ndarray:
        row = np.zeros(len(FEATURES))
        for w, x in zip(where.tolist(), what.tolist(), strict=True):
            a, b = max(first, w - WINDOW), min(last - 1, w + WINDOW)
            before = low[starts[a] : starts[w]].tobytes().decode("utf-8", "replace")
            after = low[ends[w] : min(ends[b] + 3, end)].tobytes().decode("utf-8", "replace")
            # the term itself is a letter here
            marks, closing = len(_MARKS.findall(before + "x")), len(_MARKS.findall("x" + after))
            quoted = 0.6 * (marks % 2 == 1 and closing > 0) + 0.4 * bool(_REPORTED.search(before)) + 0.2 * (marks > 0 and closing > 0)
            quoted = min(1.0, quoted)
            near = x & 1
            row[2 * near] += 1 - quoted
            row[2 * near + 1] += quoted
            row[9] += bool(_DIRECT.search(before[-40:] + " " + after[:40]))
        exact = where[(what & 1) == 0]
        row[4] = len(exact)
        row[5] = len(exact) > 0
        row[6] = len(exact) > 1
        row[7] = len(set((what[(what & 1) == 0] >> 1).tolist()))
        row[8] = int((np.diff(exact) <= 4 * WINDOW).sum())
        row[[0, 1, 2, 3, 7, 8, 9]] = np.log1p(row[[0, 1, 2, 3, 7, 8, 9]])
        return row


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(scale, weights with the constant last) by Newton steps on the penalised likelihood."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9) if len(x) else np.ones(len(FEATURES))
    z = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    w[-1] = -2.0
    penalty = np.full(len(w), ridge * max(1, len(y)) / 100)
    penalty[-1] = 1e-6
    for _ in range(steps if len(y) else 0):
        p = learn.sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return scale, w


_WORDS = re.compile(r"[^\W\d_]{4,40}")


def folded(column: pa.Array) -> pa.Array:
    """Texts in lower case and with ASCII's quotation marks, hyphens and spaces in place of others and of more punctuation: the one folding of texts and of learned terms."""
    out = pc.utf8_lower(column)
    if not pc.all(pc.string_is_ascii(out), min_count=0).as_py():
        for pattern, sign in FOLDED:
            out = pc.replace_substring_regex(out, pattern, sign)
    return out


def learned_terms(sample: DataFrame) -> list[str]:
    """Terms from labelled rows (text, label): bounded lists, counted as grouped aggregations."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, left = [], []
            for text in folded(batch.column(0)).to_pylist():
                words = _WORDS.findall(text)
                own = {*zip(words[1:], words[:-1], strict=True)}
                word += [x for x, _ in own]
                left += [x for _, x in own]
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(left, pa.string())], ["word", "left"])

    near = sample.where("label = 1").select("text").mapInArrow(pairs, "word string, left string").groupBy("word", "left").agg(F.count("*").alias("n"))
    often = near.groupBy("word").agg(F.count("*").alias("lefts")).where(F.col("lefts") >= NEIGHBOURS).orderBy(F.desc("lefts"), "word").limit(20 * LEARNED)
    wanted = frozenset(r["word"] for r in often.select("word").collect())
    if not wanted:
        return []

    def has(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, y) for text, y in zip(folded(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in wanted.intersection(_WORDS.findall(text))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32())], ["word", "label"])

    counts = sample.select("text", "label").mapInArrow(has, "word string, label int").groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    kept = counts.where((F.col("toxic") >= SHARE * F.col("n")) & (F.col("toxic") >= 3)).orderBy(F.desc("toxic"), "word").limit(LEARNED)
    return [r["word"] for r in kept.collect()]


def fit(docs: DataFrame, labels: DataFrame, terms: tuple[str, ...] = LEXICON, rows: int = SAMPLE_ROWS) -> tuple[tuple[str, ...], np.ndarray, np.ndarray]:
    """(lexicon, scales, weights) from at most `rows` labelled rows that aren't held out. Without both labels, fixed weights: hits outside quotation count."""
    sample = C.as_table(learn.training_rows(docs, labels, "toxic", rows), "toxicity-sample")
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")
    lexicon = lambda part: tuple(dict.fromkeys([*terms, *learned_terms(part)]))
    by_half = [lexicon(sample.where(half != k)) for k in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Finder(x) for x in by_half]
        for batch in batches:
            side = np.asarray(batch.column(3))
            x = np.zeros((len(side), len(FEATURES)))
            for k, finder in enumerate(finders):
                x[side == k] = finder.features(*C.utf8(folded(batch.column(1).filter(pa.array(side == k)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = sample.select("doc_id", "text", "label", half.alias("half")).mapInArrow(run, f"doc_id {kind}, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    terms = lexicon(sample)
    x, y = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES)), found["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return terms, np.ones(len(FEATURES)), np.array([2.0, -0.5, 0.5, 0, 0, 0, 1.0, 0, 0, 0.5, -3.0])
    return terms, *fit_logistic(x, y)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, terms: tuple[str, ...] = LEXICON) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text); labels (doc_id, toxic) of held-out rows aren't used.

    Null and empty texts have no hits; null ids and repeated rows stay; other columns are left aside. Whole texts are read, in lower case; equal texts have
    equal scores. Of terms equally near a word the first counts. doc_id may be of any type that labels share; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, scale, w = model.value
        finder = Finder(lexicon)
        for batch in batches:
            x = finder.features(*C.utf8(folded(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(learn.sigmoid(x / scale @ w[:-1] + w[-1]))], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string"), learn.held_out().alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
