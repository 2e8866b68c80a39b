"""Matching of references: neighbours with a ratio test, agreement within models, fuzzy names, discovery, gap queues, greedy clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.shared import as_table
from .names import best_names, ratios


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


# What becomes of a candidate reference, and what its references say of a model.
APPROVE, BY_HAND, REVIEW, TOO_LITTLE = "approve", "manual_approval", "manual_review", "insufficient_evidence"
NO_REFERENCE, CONFIRMED, CONFLICT, UNCERTAIN = "no_reference", "reference_confirmed", "reference_conflict", "reference_uncertain"


def recommendation(agreeing: Column, conflicting: Column, by_hand: Column, least: int = 2) -> Column:
    """What to do with a candidate that so many others of its model agree and conflict with: `least` that agree, itself included, and none against it settle it, unless its source needs a person."""
    settled = (agreeing > 0) & (agreeing >= least - 1) & (conflicting == 0)
    return F.when(settled & ~by_hand, APPROVE).when(settled, BY_HAND).when(agreeing > 0, REVIEW).otherwise(TOO_LITTLE)


def verification(references: Column, score: Column, good: Column, inlier_ratio: Column, least_score: float = 0.58, least_good: int = 18, least_inliers: float = 0.32, conflict: float = 0.42) -> Column:
    """What the best match says: confirmed if its matches, their inliers and its score all suffice. A model without references has none; one whose references matched nothing is in conflict."""
    sure = (F.coalesce(good, F.lit(0)) >= least_good) & (F.coalesce(inlier_ratio, F.lit(0.0)) >= least_inliers) & (score >= least_score)
    return F.when(~references, NO_REFERENCE).when(sure, CONFIRMED).when(F.coalesce(score, F.lit(0.0)) < conflict, CONFLICT).otherwise(UNCERTAIN)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts."""
    return pd.Series(ratios([x or "" for x in a], [y or "" for y in b]))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.95 if one contains the other, else their similarity as sequences."""
    x, y = X.normalized(a), X.normalized(b)
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.95).otherwise(sequence_ratio(x, y))


def identified(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """text, confidence, source, stated_text, confirmation of each item from candidate names in its listing and in its images: the whole chain.

    items are (item_id, listing, visual), the latter two arrays of names in order. Of an item's names on one side the one counts that is most like a catalog model; of
    equals the more specific, then the earlier one. Names of generic tokens alone don't count. catalog is (model).
    """
    # names are taken from texts once, whoever asks
    items = as_table(items.select("item_id", "listing", "visual"), "items")
    sides = {"listing": items.select("item_id", F.posexplode("listing").alias("pos", "name")), "visual": items.select("item_id", F.posexplode("visual").alias("pos", "name"))}
    names = sides["listing"].select("name").union(sides["visual"].select("name"))
    # below 0.60 a match isn't used, but the name that was nearest is still what a listing says
    known = as_table(best_names(names, catalog, 1e-9), "known")
    out = items.select("item_id")
    for side, rows in sides.items():
        s = X.specificity(F.col("name"))
        scored = rows.where(~X.only_generic(F.col("name"))).join(known, "name").select("item_id", F.struct("similarity", s["points"], s["length"], (-F.col("pos")).alias("p")).alias("by"), F.struct("name", "model", "similarity").alias("r"))
        best = scored.groupBy("item_id").agg(F.max_by("r", "by").alias("r"))
        out = out.join(best.select("item_id", F.col("r.name").alias(f"{side}_raw"), F.col("r.model").alias(f"{side}_key"), F.col("r.similarity").alias(f"{side}_score")), "item_id", "left").withColumn(f"{side}_score", F.coalesce(f"{side}_score", F.lit(0.0)))
    used = lambda side: F.coalesce(F.when(F.col(f"{side}_score") >= 0.60, F.col(f"{side}_key")), F.col(f"{side}_raw"))
    a, b = used("listing"), used("visual")
    both = a.isNotNull() & b.isNotNull()
    return out.withColumns({"agreement": F.when(both, name_similarity(a, b)).otherwise(F.lit(0.0)), "conflict": both & X.models_conflict(a, b)})


def source_type(host: Column, domains: dict[str, tuple[str, ...]], marketplaces: tuple[str, ...] = ()) -> Column:
    """The first type of source whose domains a host belongs to, "ebay" for any marketplace, null for others."""
    out = F.coalesce(*(F.when(X.domain_matches(host, own), name) for name, own in domains.items()), F.when(X.domain_matches(host, marketplaces), "ebay"))
    return out


# Why a found image isn't taken.
REJECTIONS = ("missing_required_fields", "unapproved_domain", "insufficient_model_evidence", "unsupported_image_url", "duplicate_image_url")


def discovery(rows: DataFrame, domains: dict[str, tuple[str, ...]], marketplaces: tuple[str, ...] = (), free: tuple[str, ...] = (), least: float = 0.6) -> DataFrame:
    """Rows (id, model, title, page_url, image_url) with ratio, source_type, by_hand and rejection: the first reason that holds, null if accepted.

    domains are those of each type of source; hosts of `marketplaces` are one more type. An empty text is a missing one. A model's tokens may stand in the title or in either address.
    Only rows without another fault count as the first of an image, in order of id. Sources of the `free` types need no person.
    """
    missing, unapproved, little, unsupported, again = REJECTIONS
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    ratio = F.when(text("model") == "", 0.0).otherwise(X.token_overlap(text("model"), F.concat_ws(" ", text("title"), text("page_url"), text("image_url"))))
    kind = source_type(X.url_host(text("page_url")), domains, marketplaces)
    lacks = (text("model") == "") | (text("page_url") == "") | (text("image_url") == "")
    out = rows.withColumns({"ratio": F.round(ratio, 4), "source_type": kind})
    fault = F.when(lacks, missing).when(F.col("source_type").isNull(), unapproved).when(ratio < least, little).when(~F.lower(text("image_url")).rlike("^https?://"), unsupported)
    out = out.withColumn("_f", fault)
    w = Window.partitionBy(X.model_key(F.col("model")), "image_url", F.col("_f").isNull()).orderBy("id")
    out = out.withColumn("_n", F.row_number().over(w))
    by_hand = ~F.coalesce(F.col("source_type").isin(*free), F.lit(False)) if free else F.lit(True)
    return out.withColumns({"rejection": F.coalesce("_f", F.when(F.col("_n") > 1, again)), "by_hand": by_hand}).drop("_f", "_n")


# What still needs references, what is searched for, and where.
OPEN_STATUSES = ("no_reference", "reference_conflict", "reference_uncertain")
REVIEWED_STATUSES = ("reference_conflict", "reference_uncertain")
SEARCHES = ('"{}" motherboard official product image', '"{}" motherboard review high resolution', '"{}" motherboard ebay')
SOURCES = ("manufacturer", "review_site", "ebay")
REQUIRED_FIELDS = ("page_url", "image_url", "title")


def gap_queue(verified: DataFrame, identified: DataFrame) -> DataFrame:
    """(item_id, model, status, identity_score, queries, sources, next_action, human_review): items of a known model whose references don't settle it.

    verified is (item_id, model, status, identity_score), identified (item_id, board); the board's name counts before the model.
    """
    out = verified.join(identified, "item_id", "left").withColumn("model", F.coalesce("board", "model")).where(F.col("model").isNotNull() & F.col("status").isin(*OPEN_STATUSES))
    texts = F.array(*(F.concat(*(F.lit(part) if part else F.col("model") for part in (t.split("{}")[0], "", t.split("{}")[1]))) for t in SEARCHES))
    return out.select("item_id", "model", "status", F.coalesce("identity_score", F.lit(0.0)).alias("identity_score"), texts.alias("queries"), F.array(*map(F.lit, SOURCES)).alias("sources"), F.lit("collect_reference_candidates").alias("next_action"), F.col("status").isin(*REVIEWED_STATUSES).alias("human_review"))


def gap_order() -> list[Column]:
    """What a person must look at first, then by model and item."""
    return [(~F.col("human_review")).asc(), F.col("model"), F.col("item_id")]


def discovery_requests(queue: DataFrame, most: int = 8) -> DataFrame:
    """(item_id, model, query, maximum_results, required_fields): a request for each search of the gap queue."""
    return queue.select("item_id", "model", F.explode("queries").alias("query"), F.lit(most).alias("maximum_results"), F.array(*map(F.lit, REQUIRED_FIELDS)).alias("required_fields"))


def with_models(results: DataFrame, queue: DataFrame) -> DataFrame:
    """results (item_id, model) with the queue's model where they have none of their own; the last of an item's in the queue counts."""
    known = queue.groupBy("item_id").agg(F.max("model").alias("_m"))
    return results.join(known, "item_id", "left").withColumn("model", F.coalesce(X.nonempty(F.col("model")), "_m")).drop("_m")


def homographies(rows: DataFrame) -> DataFrame:
    """(id, h): the homography that maps the four points `source` to the four points `target`, null where they don't define one. A batch's systems are solved as one stack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [(k, s, t) for k, (s, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)) if s and t and len(s) == len(t) == 4]
            out: list[list[float] | None] = [None] * len(batch)
            if given:
                h, sure = four_point(*(np.array([g[c] for g in given], float) for c in (1, 2)))
                for (k, _, _), row, ok in zip(given, h, sure, strict=True):
                    out[k] = row.tolist() if ok else None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["id", "h"])

    return rows.select("id", "source", "target").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, h array<double>")


def _full_rank(a: np.ndarray) -> np.ndarray:
    """Whether square matrices (n, k, k) have full rank as matrix_rank tells it; it is asked only about those that their inverse leaves open."""
    out = np.zeros(len(a), bool)
    with np.errstate(all="ignore"):
        # an exactly singular one fails the whole stack's inverse
        fair = np.linalg.det(a) != 0
        inverse = np.linalg.inv(np.where(fair[:, None, None], a, np.eye(a.shape[-1])))
        norm = lambda m: np.sqrt((m * m).sum(axis=(1, 2)))
        # the least singular value is 1 / |inverse| at least, the greatest |a| at most
        out[fair & (norm(a) * norm(inverse) < 1e10)] = True
    rest = np.flatnonzero(~out)
    if len(rest):
        out[rest] = np.linalg.matrix_rank(a[rest]) == a.shape[-1]
    return out


def four_point(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((n, 9) homographies, whether each is one) of points (n, 4, 2): stacked systems of eight equations. A singular system, as of three points on a line, has none."""
    x, y, u, v = source[..., 0], source[..., 1], target[..., 0], target[..., 1]
    one, none = np.ones_like(x), np.zeros_like(x)
    first = np.stack([x, y, one, none, none, none, -u * x, -u * y], axis=-1)
    second = np.stack([none, none, none, x, y, one, -v * x, -v * y], axis=-1)
    a, b = np.concatenate([first, second], axis=1), np.concatenate([u, v], axis=1)
    scale = np.abs(a).max(axis=(1, 2), keepdims=True)
    scaled = np.divide(a, scale, out=np.zeros_like(a), where=scale > 0)
    sure = np.isfinite(scaled).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    scaled[~sure] = np.eye(8)
    sure &= _full_rank(scaled)
    a = np.where(sure[:, None, None], a, np.eye(8))
    h = np.linalg.solve(a, np.where(sure[:, None], b, 0.0)[..., None])[..., 0]
    return np.concatenate([h, np.ones((len(h), 1))], axis=1), sure
