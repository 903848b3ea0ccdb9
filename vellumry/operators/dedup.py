"""One row per key: newest wins, first wins; and ids for rows that have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumry.session import written


def ranked_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of each key the first row in this order. Rank-limited windows shed most rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def newest_wins(files: DataFrame, key: str, changed: str, path: str, claimed: str | None = None) -> DataFrame:
    """The newest file of each id, ties by path; a claimed path wins over all. Files without an id never collide."""
    order = ([F.desc(claimed)] if claimed else []) + [F.desc(changed), F.asc(path)]
    return ranked_first(files.where(F.col(key).isNotNull()), [key], *order).unionByName(files.where(F.col(key).isNull()))


def first_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    return ranked_first(rows, keys, F.asc(position))


def assigned_ids(rows: DataFrame, start: int, order: str, into: str = "ID") -> DataFrame:
    """Consecutive ids from start + 1, in this order.

    Rows are range-partitioned and sorted once and written with their places, so ids follow from what was written, whatever runs again; counts of the partitions,
    of which there are few, give what lies before each.
    """
    placed = written(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__place", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    here = F.col("__place") - F.shiftleft(part, 33) + 1
    return placed.join(F.broadcast(before), part == F.col("__part")).withColumn(into, F.lit(start) + F.col("__before") + here).drop("__part", "__before", "__n", "__place")


def next_id(df: DataFrame, key: str = "ID", least: int = 1) -> DataFrame:
    return df.agg(F.greatest(F.coalesce(F.max(key), F.lit(0)) + 1, F.lit(least)).alias("next_id"))
