"""Expected value, price ranges and rankings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


@dataclass(frozen=True)
class ValueModel:
    """What parts are worth, what risks cost, and what a deal must bring."""

    premium_rate: float = 0.0
    target_profit: float = 60.0
    target_roi: float = 0.35
    least_confidence: float = 0.75
    board: float = 35.0
    cpu: float = 70.0
    cooler: float = 25.0
    ram: float = 30.0
    nvme: float = 25.0
    premium_chipset: float = 35.0
    unclear: float = 20.0
    disagreement: float = 25.0
    damage: float = 80.0
    cover: float = 5.0
    seen: float = 0.38


# Chipsets that add to a board's price, and what a state is called among the reasons.
PREMIUM_CHIPSETS = ("Z370", "Z390", "Z490", "Z590", "Z690", "Z790", "X370", "X470", "X570", "X670", "B650", "B550")
STATE_REASONS = {"cooler_attached_cpu_highly_likely": "cooler_attached", "visible_cpu_likely": "cpu_visible", "empty_socket_likely": "empty_socket", "socket_cover_likely": "socket_cover"}


def cents(amount: Column) -> Column:
    """An amount to two places as doubles are rounded: 1.005 is a little less than it looks, so it makes 1.0."""
    return F.round(amount * 100) / 100


def chipset_bonus(title: Column, m: ValueModel = ValueModel()) -> Column:
    names = F.array(*map(F.lit, PREMIUM_CHIPSETS))
    return F.when(F.exists(names, lambda t: F.contains(F.upper(title), t)), m.premium_chipset)


def confidence(own: Column, maxima: Column, needs_review: Column) -> Column:
    """A state's confidence, the greatest of the maxima if it has none, less a quarter if it is to be reviewed, from 0 to 1."""
    base = F.coalesce(own, F.array_max(F.map_values(maxima)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * F.when(needs_review, 0.75).otherwise(F.lit(1.0))))


def estimate(rows: DataFrame, m: ValueModel = ValueModel()) -> DataFrame:
    """rows (title, current_bid, shipping, cpu_state, cpu_confidence, needs_review, review_reasons, damage_score, maxima) with costs, values and a recommendation.

    maxima maps labels to scores. breakdown has the parts that were seen, reasons what speaks for the state and for a review.
    """
    state, maxima = F.col("cpu_state"), F.coalesce("maxima", F.create_map().cast("map<string,double>"))
    parts = [
        ("motherboard", F.lit(m.board)),
        ("cpu", F.when(state.isin("cooler_attached_cpu_highly_likely", "visible_cpu_likely"), m.cpu)),
        ("cooler_cpu_bonus", F.when(state == "cooler_attached_cpu_highly_likely", m.cooler)),
        ("ram", F.when(X.map_value(maxima, "ram_dimm", "ram") >= m.seen, m.ram)),
        ("nvme", F.when(X.map_value(maxima, "nvme_ssd", "nvme") >= m.seen, m.nvme)),
        ("premium_chipset", chipset_bonus(F.col("title"), m)),
    ]
    entries = F.filter(F.array(*(F.struct(F.lit(name).alias("part"), value.alias("value")) for name, value in parts)), lambda e: e["value"].isNotNull())
    why = F.coalesce("review_reasons", F.array().cast("array<string>"))
    damaged = F.array_contains(why, "possible_physical_damage") | (F.coalesce("damage_score", F.lit(0.0)) >= m.seen)
    cost_if = lambda test, cost: F.when(test, cost).otherwise(F.lit(0.0))
    risk = cost_if(state == "unclear", m.unclear) + cost_if(F.array_contains(why, "detector_disagreement"), m.disagreement) + cost_if(damaged, m.damage) + cost_if(state == "socket_cover_likely", m.cover)
    named = F.coalesce(*(F.when(state == k, F.array(F.lit(v))) for k, v in STATE_REASONS.items()), F.array().cast("array<string>"))
    out = rows.withColumns({
        "breakdown": F.map_from_entries(entries),
        "gross": F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["value"]),
        "risk": risk,
        "premium": F.col("current_bid") * m.premium_rate,
        "cost": F.col("current_bid") * (1 + m.premium_rate) + F.col("shipping"),
        "confidence": confidence(F.col("cpu_confidence"), maxima, F.col("needs_review")),
        "reasons": F.concat(named, F.array_sort(F.array_distinct(why))),
    })
    out = out.withColumn("net", F.greatest(F.lit(0.0), F.col("gross") - F.col("risk")))
    out = out.withColumn("profit", F.col("net") - F.col("cost"))
    by_roi = F.when(F.col("net") > F.col("shipping"), (F.col("net") - F.col("shipping")) / (1 + m.target_roi)).otherwise(F.lit(0.0))
    out = out.withColumn("max_bid", F.greatest(F.lit(0.0), F.least(F.col("net") - F.col("shipping") - m.target_profit, by_roi)))
    out = out.withColumn("roi", F.when(F.col("cost") > 0, F.col("profit") / F.col("cost")))
    choice = F.when(F.col("confidence") < m.least_confidence, "review").when((F.col("current_bid") <= F.col("max_bid")) & (F.col("profit") > 0), "bid").otherwise("pass")
    return out.withColumn("recommendation", choice)


def ranking(pos: str = "pos") -> list[Column]:
    """Bids first, then by profit and confidence; earlier rows before later ones."""
    return [F.when(F.col("recommendation") == "bid", 0).otherwise(1), F.desc("profit"), F.desc("confidence"), F.col(pos)]


def top_by_recommendation(rows: DataFrame, k: int = 20) -> DataFrame:
    """The first k rows of each recommendation; for a category of any size each task keeps k before rows are shuffled."""
    w = Window.partitionBy("recommendation").orderBy(*ranking())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked_values_of(rows: DataFrame, key: list[str], value: str, ranks: dict[str, Column], width: float = 50.0) -> DataFrame:
    """(key, samples, one column for each of ranks): the values that stand at given ranks (from 0, by `samples`) in the sorted values of each key.

    Equal values are counted first. Runs of values as wide as `width` are summed, a rank is looked up among its key's runs and then among its run's
    values; so no key's values ever meet in one row or one task, however many they are.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")).withColumn("_run", F.floor(F.col("_v") / width))
    runs = counts.groupBy(*key, "_run").agg(F.sum("_n").alias("_in"))
    by_key = Window.partitionBy(*key)
    up_to = by_key.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"_before": F.coalesce(F.sum("_in").over(up_to), F.lit(0)), "samples": F.sum("_in").over(by_key)})
    wanted = runs.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), r.cast("long").alias("rank")) for n, r in ranks.items()))).alias("_w")).where((F.col("_w.rank") >= F.col("_before")) & (F.col("_w.rank") < F.col("_before") + F.col("_in")))
    near = counts.join(wanted.select(*key, "_run", "_before", "samples", "_w"), [*key, "_run"])
    within = Window.partitionBy(*key, "_run", "_w").orderBy("_v")
    ends = near.withColumn("_end", F.col("_before") + F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    hit = ends.where((F.col("_end") > F.col("_w.rank")) & (F.col("_end") - F.col("_n") <= F.col("_w.rank")))
    return hit.groupBy(*key).agg(F.first("samples").alias("samples"), *(F.max(F.when(F.col("_w.name") == n, F.col("_v"))).alias(n) for n in ranks))


def price_ranges(outcomes: DataFrame, key: tuple[str, ...] = ("model",), least: int = 3) -> DataFrame:
    """(key, samples, median, low, high) of keys with enough outcomes (key, realized): a fifth from either end is left out of the range."""
    n = F.col("samples")
    ranks = {"low": F.greatest(F.lit(0), F.floor(n * 0.2) - 1), "high": F.least(n - 1, F.floor(n * 0.8)), "_m": F.floor((n - 1) / 2), "_k": F.floor(n / 2)}
    per = ranked_values_of(outcomes, [*key], "realized", ranks).where(n >= least)
    return per.select(*key, n.cast("int").alias("samples"), ((F.col("_m") + F.col("_k")) / 2).alias("median"), "low", "high")


def market_lookup(items: DataFrame, empirical: DataFrame, catalog: DataFrame, defaults: DataFrame) -> DataFrame:
    """items (component_type, model) with price, a struct (median, low, high, samples), and price_source: own outcomes, else the catalog's row, else the type's default.

    catalog and defaults are (component_type, model, median, low, high, samples), the defaults without model. A null model has the default; an unknown type has no price.
    """
    names = ("median", "low", "high", "samples")
    price = lambda name: F.struct(*(F.col(c).cast("int" if c == "samples" else "double").alias(c) for c in names)).alias(name)
    out = items.join(empirical.select("component_type", "model", price("_e")), ["component_type", "model"], "left")
    out = out.join(catalog.select("component_type", "model", price("_c")), ["component_type", "model"], "left")
    out = out.join(defaults.select("component_type", price("_d")), "component_type", "left")
    source = F.when(F.col("_e").isNotNull(), "purchase_outcomes").when(F.col("_c").isNotNull(), "catalog").when(F.col("_d").isNotNull(), "default")
    return out.withColumns({"price": F.coalesce("_e", "_c", "_d"), "price_source": source}).drop("_e", "_c", "_d")
