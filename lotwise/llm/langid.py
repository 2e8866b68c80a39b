"""Language ID by Bayesian evidence fusion.

Four sources of evidence are multiplied: the likelihood of the text's byte trigrams, the declared markup language (through
how often each declaration goes with each language), the address suffix, and a prior of the host, smoothed towards its
suffix's prior and that towards the corpus's. Counts behind priors and declarations are grouped aggregations over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Buckets of byte trigrams.
GRAMS = 1 << 16
#: Rows that the trigram profile of a language is fitted on, about (those of least hash of doc_id that declare it), and languages that are fitted, the most declared.
SAMPLE_ROWS, LANGUAGES = 1500, 256
#: A language is known if this many rows declare it.
LEAST_ROWS = 5
#: The text counts as this many independent trigrams at most; neighbours tell much the same.
EVIDENCE = 200
#: Weight of the parent's distribution in a host's and a suffix's prior, in rows.
STRENGTH = 20.0
#: Country suffixes that speak for a language.
SUFFIX_LANGUAGE = {"at": "de", "de": "de", "es": "es", "fr": "fr", "it": "it", "mx": "es", "nl": "nl", "pt": "pt", "uk": "en", "us": "en"}


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram at each byte, texts' offsets in it); trigrams that reach into the next text are left out."""
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    low[~letter] = 32
    x = low.astype(np.uint32)
    n = len(x)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros_like(offsets)
    code = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    bucket = (code >> np.uint32(16)).astype(np.int64)
    use = letter[:-2] | letter[1:-1] | letter[2:]
    use &= ~((low[:-2] == 32) & (low[1:-1] == 32))
    edges = offsets[1:-1]
    for back in (1, 2):
        at = edges - back
        use[at[(at >= 0) & (at < n - 2)]] = False
    kept = np.r_[0, np.cumsum(use)]
    return bucket[use], kept[np.minimum(offsets, n - 2)]


class Profiles:
    """Log likelihoods of trigrams in each known language."""

    def __init__(self, languages: list[str], table: np.ndarray) -> None:
        self.languages, self.table = languages, table

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tempered log likelihoods of each text, its trigrams)."""
        sums, counts = [], []
        for i, j in C.steps(offsets):
            bucket, at = _trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = np.diff(at)
            total = np.zeros((len(n), len(self.languages)))
            full = np.flatnonzero(n)
            if len(full):
                for k in range(len(self.languages)):
                    total[full, k] = np.add.reduceat(self.table[k][bucket], at[full], dtype=np.float64)
            sums.append(total)
            counts.append(n)
        if not sums:
            return np.zeros((0, len(self.languages))), np.zeros(0, np.int64)
        total, n = np.concatenate(sums), np.concatenate(counts)
        return total * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None], n


def fit(docs: DataFrame, text: str = "text", declared: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, most: int = LANGUAGES) -> Profiles:
    """Profiles of the `most` languages declared most, each from a sample of about `rows` rows (all that there are if they are fewer); only fixed-size counts come to the driver.

    A null key or declaration isn't sampled; rows that repeat a key and a declaration count once, with their least text.
    """
    declares = F.col(declared).cast("string").alias("_language")
    ids = docs.where(F.col(key).isNotNull() & F.col(declared).isNotNull())
    often = ids.groupBy(declares).agg(F.count("*").alias("n"), F.approx_count_distinct(key, 0.02).alias("keys")).where(F.col("n") >= LEAST_ROWS).orderBy(F.desc("n"), "_language").limit(most)
    # the share of the hashes' range that holds about `rows` keys; at most `most` rows of two values
    bounds = [(r["_language"], -(2.0**63) + 2.0**64 * min(1.0, rows / max(r["keys"], 1))) for r in often.collect()]
    if not bounds:
        return Profiles([], np.zeros((0, GRAMS), np.float32))
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bounds, "_language string, bound double"))
    under = ids.select(declares, F.xxhash64(key).alias("h"), F.col(text).cast("string").alias("text")).join(bounds, "_language").where(F.col("h").cast("double") <= F.col("bound"))
    sample = C.as_table(under.groupBy("_language", "h").agg(F.min("text").alias("text")).select("_language", "text"), "language-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            data, offsets = C.utf8(batch.column(1))
            languages = np.asarray(batch.column(0).to_pylist(), object)
            bucket, at = _trigrams(data, offsets)
            owner = np.repeat(np.arange(len(languages)), np.diff(at))
            for name in set(languages):
                mine = languages == name
                counts[name] = counts.get(name, 0) + np.bincount(bucket[mine[owner]], minlength=GRAMS)
                seen[name] = seen.get(name, 0) + int(mine.sum())
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([*counts]), pa.array([seen[x] for x in counts], pa.int64()), pa.array([x.astype(np.int64).tobytes() for x in counts.values()], pa.binary())], ["language", "n", "counts"])

    counts: dict[str, np.ndarray] = {}
    seen: dict[str, int] = {}
    for name, n, part in sample.mapInArrow(run, "language string, n long, counts binary").collect():
        counts[name] = counts.get(name, 0) + np.frombuffer(part, np.int64)
        seen[name] = seen.get(name, 0) + n
    known = sorted(counts)
    table = np.array([np.log((counts[x] + 0.1) / (counts[x].sum() + 0.1 * GRAMS)) for x in known], np.float32).reshape(len(known), GRAMS)
    return Profiles(known, table)


def suffix_of(host: Column) -> Column:
    """The last label of a host or of an address's host, null if there is no dot."""
    name = F.regexp_extract(F.lower(host.cast("string")), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)", 1)
    found = F.regexp_extract(name, r"\.([a-z]+)$", 1)
    return F.when(found != "", found)


def scored(docs: DataFrame, profiles: Profiles, text: str = "text", declared: str = "lang", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Columns keep, and _declared, _host, _suffix, _ll (log likelihoods), _n (trigrams), _top (likeliest by text, -1 without text)."""
    keep = [c for c in (docs.columns if keep is None else keep)]
    place = len(keep)
    chosen = docs.select(*keep, F.col(declared).cast("string").alias("_declared"), F.col(host).cast("string").alias("_host"), F.col(text).cast("string").alias("_text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ll, n = own.score(*C.utf8(batch.column(place + 2)))
            top = np.where(n > 0, ll.argmax(axis=1), -1) if len(own.languages) else np.full(len(batch), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(own.languages)), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: place + 2], lists, pa.array(n, pa.int64()), pa.array(top.astype(np.int32))], [*keep, "_declared", "_host", "_ll", "_n", "_top"])

    return chosen.mapInArrow(run, f"{ddl}, _ll array<double>, _n long, _top int").withColumn("_suffix", suffix_of(F.col("_host")))


def evidence(rows: DataFrame, profiles: Profiles) -> tuple[DataFrame, DataFrame | None, dict]:
    """(log priors of each host, log likelihoods of each declaration, both as arrays by language; what is the same for all rows): grouped aggregations over all rows."""
    spark, known = rows.sparkSession, profiles.languages
    if not known:
        return spark.createDataFrame([], "_host string, _prior array<double>, _rows long"), None, {}
    counted = [F.count_if(F.col("_top") == k).cast("double").alias(f"c{k}") for k in range(len(known))]
    by_host = C.as_table(rows.groupBy("_host", "_suffix").agg(*counted, F.count("*").alias("_rows")), "host-counts")
    sums = [F.sum(f"c{k}").alias(f"c{k}") for k in range(len(known))]
    total = np.array([x or 0.0 for x in by_host.agg(*sums).first()])
    overall = (total + 1) / (total.sum() + len(known))
    counts = lambda p="": F.array(*(F.col(f"{p}c{k}") for k in range(len(known))))
    smooth = lambda c, parent: F.zip_with(c, parent, lambda x, p: (x + STRENGTH * p) / (F.aggregate(c, F.lit(0.0), lambda a, y: a + y) + STRENGTH))
    base = F.array(*(F.lit(float(x)) for x in overall))
    by_suffix = by_host.groupBy("_suffix").agg(*sums).select("_suffix", smooth(counts(), base).alias("_parent"))
    joined = by_host.where("_host is not null").join(by_suffix, by_host["_suffix"].eqNullSafe(by_suffix["_suffix"]), "left").drop(by_suffix["_suffix"])
    hosts = joined.select("_host", F.transform(smooth(counts(), F.coalesce("_parent", base)), lambda p: F.log(p)).alias("_prior"), "_rows")
    by_declared = C.as_table(rows.where("_declared is not null").groupBy("_declared").agg(*counted, F.count("*").alias("_rows")), "declaration-counts")
    n = by_declared.agg(*sums, F.count("*").alias("kinds")).first()
    all_of = [(n[f"c{k}"] or 0.0) + n["kinds"] + 1 for k in range(len(known))]
    likely = F.array(*(F.log((F.col(f"c{k}") + 1) / F.lit(all_of[k])) for k in range(len(known))))
    declared = C.as_table(by_declared.select("_declared", likely.alias("_likely"), "_rows"), "declaration-likelihoods")
    suffix = {s: [0.0 if x == lang else -2.0 for x in known] for s, lang in SUFFIX_LANGUAGE.items() if lang in known}
    return C.as_table(hosts, "host-priors"), declared, {"default": np.log(overall).tolist(), "suffix": suffix}


def _by_suffix(table: dict[str, list[float]], size: int) -> Column:
    none = F.array(*[F.lit(0.0)] * size)
    if not table:
        return none
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.create_map(*pairs)[F.col("_suffix")], none)


def fused(rows: DataFrame, profiles: Profiles, hosts: DataFrame, declared: DataFrame | None, more: dict, least: float = 0.5) -> DataFrame:
    """rows with language, confidence, text_language, accepted in place of the helper columns."""
    known = profiles.languages
    helpers = ["_declared", "_host", "_suffix", "_ll", "_n", "_top"]
    rest = [c for c in rows.columns if c not in helpers]
    if not known:
        return rows.select(*rest, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("accepted"))
    names = F.array(*map(F.lit, known))
    joined = C.looked_up(rows, hosts, "_host", "_rows", "_ll")
    joined = C.looked_up(joined, declared, "_declared", "_rows", "_ll")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    prior = F.coalesce("_prior", F.array(*map(F.lit, more["default"])))
    log_p = add(add(F.col("_ll"), prior), add(F.coalesce("_likely", F.array(*[F.lit(0.0)] * len(known))), _by_suffix(more["suffix"], len(known))))
    joined = joined.withColumn("_lp", log_p).withColumn("_max", F.array_max("_lp"))
    joined = joined.withColumn("_sum", F.aggregate("_lp", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_max"))))
    confidence = F.when(F.col("_n") > 0, 1 / F.col("_sum")).otherwise(F.lit(0.0))
    language = F.when(F.col("_n") > 0, F.get(names, F.array_position("_lp", F.col("_max")).cast("int") - 1))
    by_text = F.when(F.col("_top") >= 0, F.get(names, F.col("_top")))
    return joined.select(*rest, language.alias("language"), confidence.alias("confidence"), by_text.alias("text_language"), (confidence >= least).alias("accepted"))


def language_id(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", least: float = 0.5) -> DataFrame:
    """(doc_id, language, confidence, text_language, accepted) for each row of docs.

    A row is accepted if its likeliest language has a posterior of at least `least`. Null, empty and letterless texts have
    no language, confidence 0, and aren't accepted. A null declaration or host is no evidence; null ids and repeated rows stay; ties
    go to the language that sorts first. Other columns are left aside. Without any declared language nothing is known and nothing accepted.
    """
    profiles = fit(docs, text, declared)
    rows = C.as_table(scored(docs, profiles, text, declared, host, ["doc_id"]), "language-scores")
    return fused(rows, profiles, *evidence(rows, profiles), least)


def markup_language(html: Column) -> Column:
    """The primary language that an HTML page declares, in lower case, or null."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    return F.when(found != "", found)


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source) of pages (page_id, url, html): visible text, declared language and host."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("doc_id"), visible.alias("text"), markup_language(html).alias("lang"), F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z]+://([^/?#:]*)", 1)).alias("source"))


def keep_languages(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of docs (doc_id, text, lang, source, ...) that language_id accepts, with all their columns.

    Rows move with their texts only if hosts or declarations are too many to broadcast (common.BROADCAST_ROWS).
    """
    profiles = fit(docs)
    counts = evidence(scored(docs, profiles, keep=["doc_id"]), profiles)
    out = fused(scored(docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns], F.col("lang"), F.col("source"), F.col("text")), profiles, keep=[f"d_{c}" for c in docs.columns]), profiles, *counts, least)
    return out.where("accepted").select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])
