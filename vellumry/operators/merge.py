"""Row-level changes as new generations of a table: replace, insert if absent, slice replacement, key differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows stay; new ones come only under keys that weren't there."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def replace_slice(old: DataFrame, new: DataFrame, inside: Column) -> DataFrame:
    """Rows of old inside the slice go, all of new come; rows for which the condition is null stay."""
    return old.where(~F.coalesce(inside, F.lit(False))).unionByName(new)


def without_owned(rows: DataFrame, column: str, owned: DataFrame, owner: str = "ID") -> DataFrame:
    """Rows whose column names none of the owned ids."""
    return rows.join(owned.select(F.col(owner).alias("__own")).distinct(), F.col(column) == F.col("__own"), "left_anti")


def key_changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change): created, changed or deleted; what is alike is left out."""
    a, b = old.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__in_a")), new.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    change = F.when(F.col("__in_a").isNull(), "created").when(F.col("__in_b").isNull(), "deleted").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return a.join(b, keys, "full_outer").withColumn("change", change).where("change IS NOT NULL").select(*keys, "change")


def change_counts(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row of an import's counters: how many keys of new are created, updated and skipped (alike), and how many of old alone stay as they are."""
    a, b = old.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__in_a")), new.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    both, alike = F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull(), F.col("__a").eqNullSafe(F.col("__b"))
    return a.join(b, keys, "full_outer").agg(
        F.count_if(F.col("__in_a").isNull()).alias("created"), F.count_if(both & ~alike).alias("updated"), F.count_if(both & alike).alias("skipped"), F.count_if(F.col("__in_b").isNull()).alias("kept")
    )
