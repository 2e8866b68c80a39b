"""Joins, upserts, set operations, shards, leases and monitoring over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .ranking import placed


def last_wins(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(pos))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def left_with_default(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    out = left.join(right, key, "left")
    return out.withColumns({c: F.coalesce(c, d) for c, d in defaults.items()})


# Where a merged row is from.
MERGE_SOURCES = {"off": "legacy_clip", "only": "phase2_spatial", "old": "legacy_fallback", "new": "phase2_only_available", "both": "phase2_spatial_with_legacy_reference"}


def merged(legacy: DataFrame, spatial: DataFrame, key: str, mode: str = "on") -> DataFrame:
    """Two detectors' rows (key, cpu_state, value_score, review_reasons) as one for each key, full outer.

    "on" takes the spatial row where there is one and notes where both differ; a legacy row alone is to be reviewed. "off" wants the legacy row and "only" the
    spatial one: the job fails on a key that lacks it. legacy_state and legacy_score keep the other detector's answer, detector_source tells where the row is from.
    """
    columns = ("cpu_state", "value_score", "review_reasons")
    out = legacy.select(key, F.struct(*columns).alias("_o")).join(spatial.select(key, F.struct(*columns).alias("_n")), key, "full")
    o, n = F.col("_o"), F.col("_n")
    need = lambda row, name: F.when(row.isNotNull(), row).otherwise(F.raise_error(F.concat(F.lit(f"no {name} result for "), F.col(key).cast("string"))))
    if mode not in ("on", "off", "only"):
        raise ValueError(f"mode is on, off or only, not {mode}")
    if mode == "on":
        row, source = F.coalesce(n, o), F.when(n.isNull(), MERGE_SOURCES["old"]).when(o.isNull(), MERGE_SOURCES["new"]).otherwise(MERGE_SOURCES["both"])
    else:
        row, source = need(o, "legacy") if mode == "off" else need(n, "spatial"), F.lit(MERGE_SOURCES[mode])
    both, alone = (o.isNotNull() & n.isNotNull(), n.isNull()) if mode == "on" else (F.lit(False), F.lit(False))
    out = out.select(key, row.alias("_row"), source.alias("detector_source"), both.alias("_both"), alone.alias("_alone"), (both & ~o["cpu_state"].eqNullSafe(n["cpu_state"])).alias("_differ"), "_o")
    why = F.coalesce(F.col("_row.review_reasons"), F.array().cast("array<string>"))
    noted = F.when(F.col("_differ") & ~F.array_contains(why, "detector_disagreement"), F.concat(why, F.array(F.lit("detector_disagreement")))).when(F.col("_alone"), F.array(F.lit("phase2_missing"))).otherwise(why)
    return out.select(
        key,
        F.col("_row.cpu_state").alias("cpu_state"),
        F.col("_row.value_score").alias("value_score"),
        noted.alias("review_reasons"),
        (F.col("_differ") | F.col("_alone") | (F.size(why) > 0)).alias("needs_review"),
        F.when(F.col("_both"), F.col("_o.cpu_state")).alias("legacy_state"),
        F.when(F.col("_both"), F.col("_o.value_score")).alias("legacy_score"),
        "detector_source",
    )


def reconciled(base: DataFrame, focused: DataFrame, key: str, least_identity: float = 0.58, least_confidence: float = 0.50) -> DataFrame:
    """base rows (key, cpu_state, cpu_confidence, value_score, review_reasons, needs_review), overridden by focused ones (key, f_state, f_confidence, f_score, f_review,
    identity) that are sure enough and name a state; scores add up.

    Where a focused row isn't, it is noted and the row is to be reviewed; where it overrides another state, that is noted in place of 'unclear'. A key without a focused row stays as it is.
    """
    out = base.join(focused, key, "left")
    there = F.col("f_state").isNotNull() | F.col("f_confidence").isNotNull() | F.col("identity").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    use = there & (zero("identity") >= least_identity) & (zero("f_confidence") >= least_confidence) & F.coalesce(F.col("f_state") != "unclear", F.lit(False))
    changed = use & ~F.col("f_state").eqNullSafe(F.col("cpu_state"))
    why = F.coalesce("review_reasons", F.array().cast("array<string>"))
    unsure = F.lit("focused_socket_detection_inconclusive")
    reasons = F.when(changed, X.edited(why, ("socket_state_unclear",), F.lit("full_image_overridden_by_reference_socket_region"))).when(there & ~use & ~F.array_contains(why, unsure), F.concat(why, F.array(unsure))).otherwise(why)
    return out.select(
        key,
        F.when(use, F.col("f_state")).otherwise(F.col("cpu_state")).alias("cpu_state"),
        F.when(use, F.col("f_confidence")).otherwise(F.col("cpu_confidence")).alias("cpu_confidence"),
        (F.col("value_score") + F.when(use, F.coalesce("f_score", F.lit(0))).otherwise(0)).alias("value_score"),
        reasons.alias("review_reasons"),
        F.when(changed, F.coalesce("f_review", F.lit(False))).when(there & ~use, True).otherwise(F.col("needs_review")).alias("needs_review"),
        use.alias("overridden"),
    )


#: A ledger row is one item as one version of the detector saw one state of its listing.
LEDGER_KEY = ["item_id", "detector_version", "listing_hash"]


def code_version(files: DataFrame) -> DataFrame:
    """(detector_version): 16 hex digits over all files (path, content), in order of path: any change of code or configuration is another version.

    The digest is over each file's path and digest, so only those come together.
    """
    each = files.select("path", F.sha2("content", 256).alias("d")).groupBy().agg(F.array_sort(F.collect_list(F.struct("path", "d"))).alias("f"))
    return each.select(F.substring(F.sha2(F.concat_ws("\n", F.transform("f", lambda x: F.concat_ws(" ", x["path"], x["d"]))), 256), 1, 16).alias("detector_version"))


def pending(rows: DataFrame, ledger: DataFrame, version: str) -> DataFrame:
    """rows (item_id, listing_hash) that the ledger (LEDGER_KEY) hasn't got for a version of the detector; a null hash there counts as 'legacy'."""
    done = ledger.select("item_id", "detector_version", F.coalesce("listing_hash", F.lit("legacy")).alias("listing_hash"))
    return rows.withColumn("detector_version", F.lit(version)).join(done, LEDGER_KEY, "left_anti")


def ledger_merged(ledger: DataFrame, listings: DataFrame, results: DataFrame, version: str, now: str) -> DataFrame:
    """The ledger (LEDGER_KEY, first_seen_at, last_seen_at, cpu_state, value_score, result_hash) after a run at `now`.

    listings are (item_id, listing_hash), results (item_id, cpu_state, value_score). A listing without a result changes nothing. first_seen_at stays; all else is the run's.
    """
    at = F.lit(now).cast("timestamp_ntz")
    seen = listings.join(results, "item_id").select("item_id", F.lit(version).alias("detector_version"), "listing_hash", F.struct("cpu_state", "value_score", X.fingerprint(("cpu_state", F.col("cpu_state")), ("value_score", F.col("value_score"))).alias("result_hash")).alias("_r"))
    old = ledger.withColumn("listing_hash", F.coalesce("listing_hash", F.lit("legacy")))
    out = old.join(seen, LEDGER_KEY, "full")
    new = F.col("_r").isNotNull()
    return out.select(*LEDGER_KEY, F.coalesce("first_seen_at", at).alias("first_seen_at"), F.when(new, at).otherwise(F.col("last_seen_at")).alias("last_seen_at"), *(F.when(new, F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) for c in ("cpu_state", "value_score", "result_hash")))


def ledger_order() -> list[Column]:
    """Latest first; ids compare as text."""
    return [F.desc("last_seen_at"), F.col("item_id").cast("string").desc()]


def upserted(ledger: DataFrame, news: DataFrame, key: list[str]) -> DataFrame:
    """Ledger rows (key, first_seen, last_seen, score) merged with new ones (key, seen, score): first_seen stays, the rest is replaced."""
    out = ledger.join(news.withColumnRenamed("score", "_s"), key, "full")
    return out.select(*key, F.coalesce("first_seen", "seen").alias("first_seen"), F.coalesce("seen", "last_seen").alias("last_seen"), F.coalesce("_s", "score").alias("score"))


def retained(rows: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows not older than a number of days before now, which is given; the bound itself stays."""
    return rows.where(F.col(at) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days"))


def shard_of(key: Column, n: int) -> Column:
    """First 8 bytes of the SHA-256, big-endian, modulo n."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")


def canary_bucket(key: Column) -> Column:
    """First 4 bytes of the SHA-256 as a share of their range."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


# What decides, by mode, and why a run isn't healthy.
TRAINED, FALLBACK = "trained", "fallback"
HEALTH_REASONS = ("search_errors", "gallery_error_rate", "image_error_rate", "review_rate", "model_drift")


def backend(bucket: Column, fraction: float, mode: Column | str = "auto", has_model: Column | bool = True) -> Column:
    """Which detector an item goes to: the fallback without a model or in its mode, the model in its own, and in any other mode the model for a share of the items."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    model = F.lit(has_model) if isinstance(has_model, bool) else has_model
    return F.when((mode == FALLBACK) | ~F.coalesce(model, F.lit(False)), FALLBACK).when(mode == TRAINED, TRAINED).when(bucket < fraction, TRAINED).otherwise(FALLBACK)


def health(runs: DataFrame, results: DataFrame, key: str = "run", most_search: int = 3, most_gallery: float = 0.20, most_images: float = 0.15, most_review: float = 0.60) -> DataFrame:
    """(key, healthy, reasons, search_errors, gallery_error_rate, image_error_rate, review_rate): how each run went.

    runs has a row for each run (key, listings_found, processed, search_errors, gallery_errors, image_download_errors: numbers, rollback_recommended); results has its items (key, needs_review), and
    is counted before it is joined. A run without results has a review rate of 0; nulls count as 0 and false.
    """
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    review = results.groupBy(key).agg(F.avg(F.coalesce(F.col("needs_review"), F.lit(False)).cast("double")).alias("review_rate"))
    rates = {"gallery_error_rate": n("gallery_errors") / F.greatest(n("listings_found"), F.lit(1)), "image_error_rate": n("image_download_errors") / F.greatest(n("processed"), F.lit(1)), "review_rate": F.coalesce("review_rate", F.lit(0.0)), "search_errors": n("search_errors")}
    out = runs.drop("review_rate").join(review, key, "left").withColumns(rates)
    tests = (F.col("search_errors") > most_search, F.col("gallery_error_rate") > most_gallery, F.col("image_error_rate") > most_images, F.col("review_rate") > most_review, F.coalesce("rollback_recommended", F.lit(False)))
    why = F.array_compact(F.array(*(F.when(test, reason) for test, reason in zip(tests, HEALTH_REASONS, strict=True))))
    return out.select(key, (F.size(why) == 0).alias("healthy"), why.alias("reasons"), "search_errors", *(F.round(c, 4).alias(c) for c in ("gallery_error_rate", "image_error_rate", "review_rate")))


def shard_sizes(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(shard, items) with empty shards; shard_of tells each row's, and its ids are the rows themselves."""
    counts = rows.groupBy(shard_of(F.col(key).cast("string"), n).alias("shard")).agg(F.count("*").alias("items"))
    return rows.sparkSession.range(n).select(F.col("id").cast("int").alias("shard")).join(counts, "shard", "left").select("shard", F.coalesce("items", F.lit(0)).cast("long").alias("items"))


def seeded_split(rows: DataFrame, key: str, seed: int, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """rows with `split`: of all n rows in the order of a seeded hash the first floor(n * train) train, the next floor(n * validation) validate, the rest test.

    Sizes are exact. Places come from ranges of the hash (see ranking.placed), so no task ranks all rows. The order is a hash's, not another generator's.
    """
    order = [F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.col(key)]
    there = placed(rows, order, "_place")
    # as many as the ranges hold: the greatest place
    n = there.agg(F.max("_place")).first()[0] or 0
    first, second = int(n * train), int(n * validation)
    split = F.when(F.col("_place") <= first, "train").when(F.col("_place") <= first + second, "val").otherwise("test")
    return there.withColumn("split", split).drop("_place")


def checked_union(parts: list[DataFrame], key: str) -> DataFrame:
    """All parts as one; an error if a key comes twice."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = F.count("*").over(Window.partitionBy(key))
    return out.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string")))).otherwise(F.lit(True))).drop("_n")


def replaced(table: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """Rows of news in place of those with their key, or added."""
    return table.join(news, key, "left_anti").unionByName(news)


def recovered(shards: DataFrame, now: str, stale_minutes: int = 60) -> DataFrame:
    """shards (status, worker_id, error, updated_at) with those that have run for too long without a word given back to be tried again."""
    at = F.lit(now).cast("timestamp_ntz")
    stale = (F.col("status") == "running") & (F.col("updated_at") < at - F.expr(f"interval {int(stale_minutes)} minutes"))
    return shards.withColumns({
        "worker_id": F.when(~stale, F.col("worker_id")),
        "error": F.when(stale, F.lit("stale_assignment")).otherwise(F.col("error")),
        "updated_at": F.when(stale, at).otherwise(F.col("updated_at")),
        "status": F.when(stale, F.lit("retry")).otherwise(F.col("status")),
    })


def lease_events(shards: DataFrame, events: DataFrame, retries: int = 2) -> DataFrame:
    """shards (run, shard, status, attempts, worker_id, error, updated_at) after one event for each of some (run, shard, event, detail, at).

    claim (detail: worker) takes a pending shard or one to be retried, complete ends one, fail (detail: error) gives it back until its attempts are used up. Other
    events, and claims of shards that aren't free, change nothing.
    """
    out = shards.join(events, ["run", "shard"], "left")
    e, free = F.col("event"), F.col("status").isin("pending", "retry")
    claim, done, failed = (e == "claim") & free, e == "complete", e == "fail"
    status = F.when(claim, "running").when(done, "completed").when(failed, F.when(F.col("attempts") <= retries, "retry").otherwise("failed")).otherwise(F.col("status"))
    changed = F.coalesce(claim | done | failed, F.lit(False))
    return out.select(
        "run", "shard", status.alias("status"),
        (F.col("attempts") + F.when(claim, 1).otherwise(0)).alias("attempts"),
        F.when(claim, F.col("detail")).otherwise(F.col("worker_id")).alias("worker_id"),
        F.when(failed, F.col("detail")).when(~changed, F.col("error")).alias("error"),
        F.when(changed, F.col("at")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def run_states(shards: DataFrame) -> DataFrame:
    """(run, status): failed if a shard is, completed if all are, pending if nothing was begun, else running."""
    s = F.col("status")
    return shards.groupBy("run").agg(F.when(F.bool_or(s == "failed"), "failed").when(F.every(s == "completed"), "completed").when(F.every(s == "pending"), "pending").otherwise("running").alias("status"))


def first_claimable(shards: DataFrame, run: str) -> DataFrame:
    """Of each run the first shard that is pending or to be retried."""
    w = Window.partitionBy(run).orderBy("shard")
    return shards.where(F.col("status").isin("pending", "retry")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def evaluated(expected: DataFrame, results: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, expected_cpu_state, actual_cpu_state, correct, socket_localized) for each row of expected (key, expected_cpu_state), against results (key, cpu_state, socket_localized_images).

    An item without a result isn't correct and not localized.
    """
    found = results.select(key, F.col("cpu_state").alias("actual_cpu_state"), F.col("socket_localized_images").alias("_n"))
    out = expected.select(key, "expected_cpu_state").join(found, key, "left")
    right = F.coalesce(F.col("actual_cpu_state") == F.col("expected_cpu_state"), F.lit(False))
    return out.select(key, "expected_cpu_state", "actual_cpu_state", right.alias("correct"), (F.coalesce("_n", F.lit(0)) > 0).alias("socket_localized"))


def evaluation(rows: DataFrame) -> DataFrame:
    """One row: items, correct, accuracy and socket_localized of evaluated rows; no items have an accuracy of 0."""
    correct = F.count_if("correct")
    return rows.agg(F.count("*").alias("items"), correct.alias("correct"), F.round(correct / F.greatest(F.count("*"), F.lit(1)), 4).alias("accuracy"), F.count_if("socket_localized").alias("socket_localized"))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean confidence and review rate of each group of rows (confidence, needs_review)."""
    return rows.groupBy(*by).agg(F.count("*").alias("samples"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("needs_review").cast("double")).alias("review_rate"))


def monitored(rows: DataFrame, by: list[str], state: str = "cpu_state") -> DataFrame:
    """(by, sample_count, mean_confidence, review_rate, class_frequencies) of rows (cpu_confidence, needs_review, state), to four places; one group without `by`.

    Rows are counted by state first, so what is gathered of a group is one entry for each state.
    """
    name = F.coalesce(F.col(state), F.lit("unclear"))
    per = rows.groupBy(*by, name.alias("_s")).agg(F.count("*").alias("_n"), F.sum(F.coalesce("cpu_confidence", F.lit(0.0))).alias("_c"), F.sum(F.coalesce(F.col("needs_review"), F.lit(False)).cast("int")).alias("_r"))
    n = F.sum("_n")
    out = per.groupBy(*by).agg(n.alias("sample_count"), F.round(F.sum("_c") / n, 4).alias("mean_confidence"), F.round(F.sum("_r") / n, 4).alias("review_rate"), F.array_sort(F.collect_list(F.struct("_s", "_n"))).alias("_f"))
    return out.withColumn("class_frequencies", F.map_from_entries(F.transform("_f", lambda x: F.struct(x["_s"], F.round(x["_n"] / F.col("sample_count"), 4))))).drop("_f")


def drift_reasons(now: str, before: str, drop: float, review: float, delta: float) -> Column:
    """What two structs of `monitored` differ in, in a fixed order; nothing if there is no earlier sample."""
    a, b = F.col(now), F.col(before)
    labels = F.array_union(F.map_keys(a["class_frequencies"]), F.coalesce(F.map_keys(b["class_frequencies"]), F.array().cast("array<string>")))
    share = lambda s, x: F.coalesce(F.try_element_at(s["class_frequencies"], x), F.lit(0.0))
    found = reasons(
        confidence_drop=F.coalesce(b["mean_confidence"], F.lit(0.0)) - a["mean_confidence"] > drop,
        review_rate=a["review_rate"] > review,
        class_frequency_shift=F.exists(labels, lambda x: F.abs(share(a, x) - share(b, x)) > delta),
    )
    return F.when(F.coalesce(b["sample_count"], F.lit(0)) > 0, found).otherwise(F.lit(""))


def next_baseline(now: str, before: str, update: bool, least: int = 30) -> Column:
    """The struct that later runs are compared with: this run's, if that is asked for and it has enough rows, else the one before."""
    return F.when(F.lit(update) & (F.col(now)["sample_count"] >= least), F.col(now)).otherwise(F.col(before))


def frequencies(rows: DataFrame, label: str) -> DataFrame:
    """(label, share) of all rows; rows are read once and counted by label, and the counts' total is theirs."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_c"))
    return counts.select(label, (F.col("_c") / F.sum("_c").over(Window.partitionBy())).alias("share"))


def frequency_shift(now: DataFrame, before: DataFrame, label: str, limit: float) -> DataFrame:
    """(label, now_share, before_share, delta, shifted) over labels of either."""
    out = now.withColumnRenamed("share", "now_share").join(before.withColumnRenamed("share", "before_share"), label, "full").fillna(0.0, ["now_share", "before_share"])
    return out.withColumn("delta", F.abs(F.col("now_share") - F.col("before_share"))).withColumn("shifted", F.col("delta") > limit)


def reasons(**tests: Column) -> Column:
    """Names of the tests that hold, in order, comma-joined."""
    return F.concat_ws(",", *(F.when(t, n) for n, t in tests.items()))
