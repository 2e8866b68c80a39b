"""PII: exact patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans the patterns miss.

The network is trained in numpy from labelled spans: the patterns' own spans in a bounded sample of documents and spelled-out
variants of them ("name at host dot com", digits in groups) put into the same surroundings. It reads windows around digits, at
signs and spelled-out separators, which any such span has. Windows overlap; their emissions are averaged where they do, by how much each sees to both sides, and one
Viterbi pass over each stretch of windows settles the spans globally. Spans of the patterns always stay; those of the network are added where
they overlap none, if they look like their kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import sigmoid

KINDS = ("email", "ip", "card", "phone")
#: Documents that the network is trained on at most (those of least hash of doc_id that may have a span), and spans of theirs (of least hash too).
SAMPLE_ROWS, SAMPLE_SPANS = 400, 4000
#: Characters of a window, and from one window's start to the next one's.
WINDOW, STRIDE = 64, 32
HIDDEN, STEPS, BATCH, SEED = 12, 160, 48, 11
#: Least probability of a span of the network against there being none in its place.
LEAST = 0.95

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the patterns, leftmost and without overlap within a kind, by start, then kind as in KINDS. Linear in the text's length."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        # the local part is the run of its characters before the sign, but for what an earlier match took
        start = at
        while start > free and _NO_LOCAL.match(text[start - 1]) is None:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), 0))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((*m.span(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


# --- the network ---

#: Character classes: fixed groups, then rare letters by themselves matter little.
_CLASS = np.full(128, 1, np.int64)
for _k, _group in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "@", ".", "-", "+", "(", ")", "_%", " ", "\n\t\r", ",;:!?", "[]{}<>"], 2):
    for _c in _group:
        _CLASS[ord(_c)] = _k
# letters of the spelled-out separators are told apart
for _k, _c in enumerate("atdoATDO", 16):
    _CLASS[ord(_c)] = 16 + (_k - 16) % 4
CLASSES = 20
#: Labels: 0 outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
_TRIGGER = re.compile(r"[0-9@]|\b(?i:at|dot)\b|[\[(](?i:at|dot)[\])]")
#: A window speaks the louder, the more it sees to both sides.
_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
#: What a span of the network must look like.
_SHAPE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+(?:@| ?[\[(](?i:at)[\])] ?| (?i:at) )[A-Za-z0-9-]+(?:(?:\.| ?[\[(](?i:dot)[\])] ?| (?i:dot) )[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?:[0-9]{1,3}(?:\.| ?[\[(](?i:dot)[\])] ?| (?i:dot) )){3}[0-9]{1,3}"),
    "card": re.compile(r"[0-9](?:[ .\-/]{0,2}[0-9]){11,18}"),
    "phone": re.compile(r"(?:\+|00)?[0-9(](?:[ ().\-/]{0,2}[0-9]){8,14}"),
}


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(code < 128, _CLASS[np.minimum(code, 127)], 0)


class Tagger:
    """Two LSTMs over one-hot classes, a linear layer and CRF transitions."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = params

    @staticmethod
    def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
        p = {}
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
            p["h" + d] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            p["b" + d] = np.zeros(4 * HIDDEN)
            p["b" + d][HIDDEN : 2 * HIDDEN] = 1
        p["out"], p["bias"] = rng.normal(0, 0.2, (2 * HIDDEN, LABELS)), np.zeros(LABELS)
        p["move"] = np.zeros((LABELS, LABELS))
        return p

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, t = x.shape
        h, c = np.zeros((n, HIDDEN), self.p["xf"].dtype), np.zeros((n, HIDDEN), self.p["xf"].dtype)
        out, tape = np.empty((n, t, HIDDEN), h.dtype), []
        wx, wh, b = self.p["x" + d], self.p["h" + d], self.p["b" + d]
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = wx[x[:, k]] + h @ wh + b
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = (h, c)
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[:, k] = h
            if keep:
                tape.append((k, i, f, o, g, th, *before))
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._lstm(x, "f", False)[0], self._lstm(x, "b", False)[0]], axis=2) @ self.p["out"] + self.p["bias"]

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of the CRF's likelihood for labels y."""
        n, t = x.shape
        tapes, hs = {}, {}
        for d in "fb":
            hs[d], tapes[d] = self._lstm(x, d, True)
        both = np.concatenate([hs["f"], hs["b"]], axis=2)
        e, move = both @ self.p["out"] + self.p["bias"], self.p["move"]
        lse = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for k in range(1, t):
            a[:, k] = e[:, k] + lse(a[:, k - 1, :, None] + move, 1)
        for k in range(t - 2, -1, -1):
            b[:, k] = lse(move + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2)
        z = lse(a[:, -1], 1)
        rows = np.arange(n)[:, None]
        gold = e[rows, np.arange(t), y].sum(1) + move[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(a + b - z[:, None, None])
        de[rows, np.arange(t), y] -= 1
        grad = {"move": np.zeros_like(move)}
        for k in range(1, t):
            grad["move"] += np.exp(a[:, k - 1, :, None] + move + (e[:, k] + b[:, k])[:, None, :] - z[:, None, None]).sum(0)
        np.subtract.at(grad["move"], (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        grad["out"], grad["bias"] = both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, LABELS), de.sum((0, 1))
        dboth = de @ self.p["out"].T
        for s, d in enumerate("fb"):
            dh_out = dboth[:, :, s * HIDDEN : (s + 1) * HIDDEN]
            gx, gh = np.zeros_like(self.p["x" + d]), np.zeros_like(self.p["h" + d])
            gb, dh, dc = np.zeros_like(self.p["b" + d]), np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            for k, i, f, o, g, th, h0, c0 in reversed(tapes[d]):
                dh = dh + dh_out[:, k]
                dc = dc + dh * o * (1 - th**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                np.add.at(gx, x[:, k], dz)
                gh += h0.T @ dz
                gb += dz.sum(0)
                dh, dc = dz @ self.p["h" + d].T, dc * f
            grad |= {"x" + d: gx, "h" + d: gh, "b" + d: gb}
        return float((z - gold).mean()), {k: v / n for k, v in grad.items()}

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The likeliest labels of one stretch."""
        t, move = len(e), self.p["move"]
        score, back = e[0].copy(), np.zeros((t, LABELS), np.int64)
        for k in range(1, t):
            all_ = score[:, None] + move
            back[k] = all_.argmax(0)
            score = all_.max(0) + e[k]
        out = np.empty(t, np.int64)
        out[-1] = score.argmax()
        for k in range(t - 1, 0, -1):
            out[k - 1] = back[k, out[k]]
        return out

    def surety(self, e: np.ndarray, labels: np.ndarray, start: int, end: int) -> float:
        """Probability of a labelled span against `outside` throughout its place, emissions and transitions taken together."""
        around = np.r_[labels[start - 1 : start], labels[start:end], labels[end : end + 1]]
        none = around.copy()
        none[1 if start else 0 :][: end - start] = 0
        ahead = e[np.arange(start, end), labels[start:end]].sum() - e[start:end, 0].sum()
        return float(sigmoid(ahead + self.p["move"][around[:-1], around[1:]].sum() - self.p["move"][none[:-1], none[1:]].sum()))


def _variants(text: str, kind: str, rng: np.random.Generator) -> str:
    """The span as it is, or as people spell it to hide it, now and then in upper case."""
    out = _respelled(text, kind, rng)
    return out.upper() if rng.random() < 0.2 else out


def _respelled(text: str, kind: str, rng: np.random.Generator) -> str:
    way = rng.integers(4)
    if kind == "email":
        at, dot = [("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)")][way]
        return text.replace("@", at).replace(".", dot) if way else text
    if kind == "ip":
        return text.replace(".", [".", "[dot]", " dot ", "."][way])
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        return text if way == 0 else "-/. "[way].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    digits = re.sub(r"\D", "", text)
    return [text, f"+{digits[:2]}/{digits[2:5]}/{digits[5:]}", f"00{digits}", f"({digits[1:4]}) {digits[4:7]}.{digits[7:]}"][way]


def training_windows(samples: list[tuple[str, str, str, str]], n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(classes, labels) of n windows from (text before, span, text after, kind); a third hold no span but near misses, a fifth begin within a span."""
    xs, ys = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for r in range(n):
        before, span, after, kind = samples[rng.integers(len(samples))]
        label = 1 + 2 * KINDS.index(kind)
        if rng.random() < 0.33:
            label = 0
            digits = "".join(map(str, rng.integers(0, 10, rng.integers(1, 9))))
            span = [digits, f"{digits[:2]}.{digits[2:3]}", f"CC BY {digits[:1]}.0", "at the dot", f"looked at {digits} of", f"v{digits[:1]}.{digits[1:3]}", "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, 40))][rng.integers(7)]
        else:
            span = _variants(span, kind, rng)
        inside = int(rng.integers(1, len(span))) if label and len(span) > 2 and rng.random() < 0.3 else 0
        span = span[inside:]
        left = 0 if inside else int(rng.integers(0, max(1, WINDOW - min(len(span), WINDOW)) + 1))
        text = (before[len(before) - left :] if left else "") + span + after
        got = min(left, len(before))
        x = classes(text[:WINDOW])
        xs[r, : len(x)] = x
        end = min(WINDOW, got + len(span))
        if label:
            ys[r, got:end] = label + 1
            if not inside:
                ys[r, got] = label
    return xs, ys


def train(samples: list[tuple[str, str, str, str]], steps: int = STEPS, seed: int = SEED) -> Tagger:
    """Adam on the CRF's likelihood. Samples of our own making stand in for kinds that there are none of."""
    rng = np.random.default_rng(seed)
    words = " lorem tion ander over quando piece under station "
    made = [("email", "jo.doe7@mail3.example.org"), ("ip", "203.0.113.57"), ("card", "4111111111111111"), ("phone", "+1 (202) 555-0143")]
    samples = samples + [(words * 2, span, words * 2, kind) for kind, span in made for _ in range(max(1, len(samples) // 40))]
    tagger = Tagger(Tagger.fresh(rng))
    first = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    second = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    for s in range(1, steps + 1):
        _, grad = tagger.step(*training_windows(samples, BATCH, rng))
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            tagger.p[k] = tagger.p[k] - 0.03 * min(1, 2 - 2 * s / (steps + 1)) * (first[k] / (1 - 0.9**s)) / (np.sqrt(second[k] / (1 - 0.99**s)) + 1e-8)
    tagger.p = {k: v.astype(np.float32) for k, v in tagger.p.items()}
    return tagger


def stretches(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Parts of a text to be read: WINDOW / 2 characters around each trigger that no base span holds, joined where they touch."""
    out: list[list[int]] = []
    k = 0
    for m in _TRIGGER.finditer(text):
        while k < len(base) and base[k][1] <= m.start():
            k += 1
        if k < len(base) and base[k][0] <= m.start():
            continue
        a, b = max(0, m.start() - WINDOW // 2), min(len(text), m.end() + WINDOW // 2)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def added_spans(texts: list[str], bases: list[list[tuple[int, int, str]]], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """The network's spans of each text that overlap no base span."""
    jobs = []  # (text, start of its stretch, classes of the stretch)
    for t, text in enumerate(texts):
        jobs += [(t, a, classes(text[a:b])) for a, b in stretches(text, bases[t])] if text else []
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not jobs:
        return out
    windows, where = [], []
    for j, (_, _, x) in enumerate(jobs):
        for s in range(0, max(1, len(x) - STRIDE), STRIDE):
            w = np.zeros(WINDOW, np.int64)
            w[: len(x[s : s + WINDOW])] = x[s : s + WINDOW]
            windows.append(w)
            where.append((j, s))
    total = [np.zeros((len(x), LABELS), np.float32) for _, _, x in jobs]
    times = [np.zeros(len(x), np.float32) for _, _, x in jobs]
    for k in range(0, len(windows), 512):
        e = tagger.emissions(np.stack(windows[k : k + 512]))
        for (j, s), one in zip(where[k : k + 512], e, strict=True):
            n = min(WINDOW, len(total[j]) - s)
            total[j][s : s + n] += one[:n] * _WEIGHT[:n, None]
            times[j][s : s + n] += _WEIGHT[:n]
    for (t, a, _), e, n in zip(jobs, total, times, strict=True):
        e = e / n[:, None]
        labels = tagger.viterbi(e)
        k = 0
        while k < len(labels):
            if labels[k] == 0:
                k += 1
                continue
            kind = (labels[k] - 1) // 2
            end = k + 1
            while end < len(labels) and labels[end] == 2 * kind + 2:
                end += 1
            # the span's exact ends are those of what has the kind's shape around it
            low, high = _run_ends(texts[t], max(0, a + k - 8), min(len(texts[t]), a + end + 8))
            m = _SHAPE[KINDS[kind]].search(texts[t], low, high)
            if m and m.start() < a + end and m.end() > a + k and tagger.surety(e, labels, k, end) >= LEAST and _plausible(m[0], KINDS[kind]) and _whole(texts[t], *m.span()) and not any(s < m.end() and m.start() < f for s, f, _ in bases[t]):
                out[t].append((m.start(), m.end(), KINDS[kind]))
            k = end
    return [_apart(x) for x in out]


def _plausible(span: str, kind: str) -> bool:
    """A card's digits have a right check digit, and an address's parts are bytes, however they are spelled."""
    if kind == "card":
        return luhn(re.sub(r"\D", "", span))
    return kind != "ip" or all(int(x) <= 255 for x in re.findall(r"[0-9]+", span))


def _whole(text: str, start: int, end: int) -> bool:
    """A span neither begins nor ends inside a longer run of letters and digits."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def _run_ends(text: str, low: int, high: int) -> tuple[int, int]:
    """Both places moved outward to the next space, by a window at most."""
    first, last = max(0, low - WINDOW), min(len(text), high + WINDOW)
    while low > first and not text[low - 1].isspace():
        low -= 1
    while high < last and not text[high].isspace():
        high += 1
    return low, high


def _apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for s in sorted(set(spans)):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, spans: int = SAMPLE_SPANS) -> Tagger:
    """A tagger trained on the surroundings of at most `spans` base spans in at most `rows` documents; only those surroundings come to the driver.

    A span longer than a window can't be shown whole and is left aside. Rows that repeat a doc_id count once, with their least text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, at, parts = [], [], []
            for text, h in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                for s, e, kind in base_spans(text):
                    if e - s <= WINDOW:
                        order.append(h)
                        at.append(s)
                        parts.append({"a": text[max(0, s - WINDOW) : s], "b": text[s:e], "c": text[e : e + WINDOW], "d": kind})
            kind = pa.struct([(x, pa.string()) for x in "abcd"])
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(at, pa.int32()), pa.array(parts, kind)], ["h", "at", "s"])

    marked = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9]{3}|@")).select(F.xxhash64("doc_id").alias("h"), "text")
    # first the bound on the hash, from numbers alone; then the texts under it, which stay in their tasks
    bound = marked.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if bound is None:
        return train([])
    chosen = marked.where(F.col("h") <= bound).groupBy("h").agg(F.min("text").alias("text"))
    found = chosen.mapInArrow(run, "h long, at int, s struct<a: string, b: string, c: string, d: string>").orderBy(F.xxhash64("h", "at"), "h", "at", "s").limit(spans).collect()
    found.sort(key=lambda r: (r["h"], r["at"], tuple(r["s"])))
    return train([tuple(r["s"]) for r in found])


def _tagged(docs: DataFrame, tagger: Tagger, keep: list[str], names: list[str], ddl: str, make) -> DataFrame:
    """docs' columns keep (the text last) through make(texts, base spans, all spans), in batches."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                texts = [x or "" for x in part.column(len(keep)).to_pylist()]
                bases = [base_spans(x) for x in texts]
                added = added_spans(texts, bases, shared.value)
                spans = [sorted(b + a, key=lambda s: (s[0], KINDS.index(s[2]))) for b, a in zip(bases, added, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *make(texts, bases, spans)], names)

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, ddl)


def find_pii(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) for each row of docs (doc_id, text).

    base and spans are kind:start:end, comma-joined, by start, in code points; the numbers count base spans. Null texts are empty; null
    ids and repeated rows stay; other columns are left aside; whole texts are read.
    """
    tagger = fit(docs.select("doc_id", F.col("text").cast("string").alias("text")), rows)
    joined = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)

    def make(texts, bases, spans):
        counts = [pa.array([sum(k == kind for _, _, k in b) for b in bases], pa.int64()) for kind in KINDS]
        return [*counts, pa.array(map(joined, bases), pa.string()), pa.array(map(joined, spans), pa.string())]

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string"
    return _tagged(docs, tagger, ["doc_id"], names, ddl, make)


def redact(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with each span in `text` replaced by its kind in brackets, and n_chars, if there is such a column, set anew; all columns stay, null texts too."""
    tagger = fit(docs.select("doc_id", F.col("text").cast("string").alias("text")), rows)
    others = [c for c in docs.columns if c not in ("text",)]

    def clean(text: str, spans: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for s, e, kind in spans:
            if s >= at:
                out += [text[at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        return "".join([*out, text[at:]]) if spans else text

    def make(texts, bases, spans):
        return [pa.array([clean(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())]

    plain = docs.withColumn("_null", F.col("text").isNull())
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others) + ", _null boolean, _clean string"
    out = _tagged(plain, tagger, [*others, "_null"], [*others, "_null", "_clean"], ddl, make)
    out = out.withColumn("text", F.when(~F.col("_null"), F.col("_clean")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_null"), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op_result(found: DataFrame) -> DataFrame:
    """The spans of find_pii as a digest of the base ones and the list of all."""
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
