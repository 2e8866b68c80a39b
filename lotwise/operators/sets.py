"""Small relational operators on labels, lists, look-ups and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_of(rows: DataFrame, key: str, labels: tuple[str, ...], score: str = "score") -> DataFrame:
    """(key, label, score): the label of most score among `labels` for each key; of equals the last by name."""
    best = F.max(F.struct(F.col(score).alias("score"), "label")).alias("best")
    return rows.where(F.col("label").isin(*labels)).groupBy(key).agg(best).select(key, "best.label", "best.score")


def maxima_wide(rows: DataFrame, key: str, labels: dict[str, str], score: str = "score") -> DataFrame:
    """One column for each entry of labels (name: label): the greatest score of that label, 0 if there is none."""
    return rows.groupBy(key).agg(*(F.coalesce(F.max(F.when(F.col("label") == x, F.col(score))), F.lit(0.0)).alias(name) for name, x in labels.items()))


def ordered_distinct(rows: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """(key, values): each key's distinct values, in the order in which they first come; one row for each key and value is shuffled."""
    first = rows.groupBy(key, value).agg(F.min(pos).alias("pos"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("value")))), lambda x: x["value"])
    return first.groupBy(key).agg(listed.alias("values"))


def is_subset(values: Column, allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(values, F.array(*map(F.lit, allowed)))) == 0


def looked_up(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """rows with table's value; the job fails on a key that table lacks."""
    joined = rows.join(table.select(key, value), key, "left")
    missing = F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn(value, F.coalesce(F.col(value), missing.cast(table.schema[value].dataType)))


def map_total(values: Column) -> Column:
    """Sum of a map's values."""
    return F.aggregate(F.map_values(values), F.lit(0.0), lambda a, x: a + x)


def ordered_corners(points: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left: by least and greatest sum and difference of coordinates."""
    by = lambda value: F.array_sort(F.transform(points, lambda p: F.struct(value(p).alias("v"), p.alias("p"))))
    sums, differences = by(lambda p: p[0] + p[1]), by(lambda p: p[1] - p[0])
    pick = lambda a, k: F.element_at(a, k)["p"]
    return F.array(pick(sums, 1), pick(differences, 1), pick(sums, -1), pick(differences, -1))


def quad_size(points: Column) -> Column:
    """struct(width, height) of four points in whole pixels, one at least: the longer of opposite sides."""
    c = ordered_corners(points)
    side = lambda i, j: F.hypot(c[i][0] - c[j][0], c[i][1] - c[j][1])
    whole = lambda *x: F.greatest(F.lit(1), F.bround(F.greatest(*x)).cast("int"))
    return F.struct(whole(side(1, 0), side(2, 3)).alias("width"), whole(side(3, 0), side(2, 1)).alias("height"))


def repaired_top_right(points: Column, width: Column, height: Column, least: float = 0.04) -> Column:
    """struct(applied, reason, x, y, inset_ratio): a top right corner that lies well short of the lower right one is moved along the top edge to above it.

    It stays where the top edge is vertical, and where the new corner would lie outside the image by more than a twentieth of its height.
    """
    c = ordered_corners(points)
    tl, tr, br, bl = (c[k] for k in range(4))
    board = F.greatest(F.lit(1.0), F.hypot(br[0] - bl[0], br[1] - bl[1]))
    inset, dx = br[0] - tr[0], tr[0] - tl[0]
    y = tl[1] + (tr[1] - tl[1]) / dx * (br[0] - tl[0])
    inside = (y >= height * -0.05) & (y <= height * 1.05) & (br[0] >= 0) & (br[0] <= width)
    reason = F.when(inset <= board * least, "top_right_not_materially_inset").when(F.abs(dx) < 1e-6, "top_edge_is_vertical").when(~inside, "inferred_corner_outside_image").otherwise("extended_straight_top_edge_to_right_pcb_edge")
    applied = reason == "extended_straight_top_edge_to_right_pcb_edge"
    return F.struct(applied.alias("applied"), reason.alias("reason"), F.when(applied, br[0]).otherwise(tr[0]).alias("x"), F.when(applied, y).otherwise(tr[1]).alias("y"), F.round(inset / board, 4).alias("inset_ratio"))


def layout_status(found: DataFrame, expected: tuple[str, ...], key: str = "item_id", counted: tuple[str, ...] = ()) -> DataFrame:
    """(key, name, status) for each key and expected name: PASS if found has it (with how many, for `counted` names), else MISSING."""
    counts = found.where(F.col("label").isin(*expected)).groupBy(key, "label").agg(F.count("*").alias("n"))
    names = found.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, expected))).alias("name"))
    each = names.join(counts.withColumnRenamed("label", "name"), [key, "name"], "left")
    number = F.when(F.col("name").isin(*counted), F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise("")
    return each.select(key, "name", F.when(F.col("n").isNull(), "MISSING").otherwise(F.concat(F.lit("PASS"), number)).alias("status"))


def any_match(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, matched): whether any of a key's texts has a pattern."""
    return rows.groupBy(key).agg(F.coalesce(F.bool_or(F.col(text).rlike(pattern)), F.lit(False)).alias("matched"))


def difference(values: Column, allowed: tuple[str, ...]) -> Column:
    """What a list has beyond some values, sorted."""
    return F.array_sort(F.array_except(values, F.array(*map(F.lit, allowed))))


def positional_distances(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, distance): rows of a and b (keys, x, y) that share their keys, and how far apart they are."""
    return a.alias("a").join(b.alias("b"), keys).select(*keys, F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")).alias("distance"))


# What speaks against training now, in order.
BLOCKERS = ("disabled", "insufficient_total_labels", "insufficient_new_labels", "training_cooldown", "failure_limit")


def training_blockers(enabled: Column, total: Column, trained_with: Column, last_training: Column, now: Column, failures: Column, least: int = 200, least_new: int = 50, days: int = 7, most_failures: int = 3) -> Column:
    """What speaks against training at `now` with so many labels, of which some were there at the last training; empty if nothing does. A model that was never trained has no cooldown."""
    cooling = F.coalesce(now < last_training + F.expr(f"interval {int(days)} days"), F.lit(False))
    tests = (~enabled, total < least, total - F.coalesce(trained_with, F.lit(0)) < least_new, cooling, F.coalesce(failures, F.lit(0)) >= most_failures)
    return F.array_compact(F.array(*(F.when(test, why) for test, why in zip(tests, BLOCKERS, strict=True))))
