"""Exact places in an order over all rows, without a task that sees them all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import as_table


def placed(rows: DataFrame, order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """rows with their place in an order, from 1: ranges of the order, the rows before each range, and a rank within it.

    Spark samples the order for range bounds, so ranges are of about one size, and the rows are written once, so that each stays in the range that it was counted in. Only
    the number of rows of each range, `parts` numbers (by default the session's shuffle partitions), comes to the driver. Rows that are equal in all of `order` stand next to each other in
    no fixed order and may make a large range: end `order` (columns of rows, or expressions of them, with their directions) with a key. Nulls stand where the order puts them. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_order{k}" for k in range(len(order))]
    there = as_table(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranked")
    sizes = {r["__range"]: r["count"] for r in there.groupBy("__range").count().collect()}
    before = dict(zip(sorted(sizes), accumulate((sizes[p] for p in sorted(sizes)), initial=0), strict=False))
    offset = F.create_map(*(F.lit(x) for p, n in before.items() for x in (p, n))) if before else F.create_map().cast("map<int,int>")
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return there.withColumn(name, F.element_at(offset, F.col("__range")).cast("long") + rank).drop("__range")

