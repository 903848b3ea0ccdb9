"""Differences between stores: two-way manifest differences, and three-way reconciliation against a baseline."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CATEGORIES = ("created", "updated_from_file", "deleted_from_file", "written_from_wordpress", "deleted_from_wordpress", "moved", "unchanged", "conflicts")
DIRECTIONS, DELETIONS, PREFERENCES = ("bidirectional", "canonical_to_wordpress", "wordpress_to_canonical"), ("preserve", "managed"), ("none", "prefer_canonical", "prefer_wordpress")
_FROM_FILE, _FROM_STORE = ("created", "updated_from_file", "deleted_from_file"), ("written_from_wordpress", "deleted_from_wordpress")


def manifest_diff(seen: DataFrame, listed: DataFrame, key: str = "path") -> DataFrame:
    """(key, status): new, changed, unchanged or deleted, by modification time and size."""
    a = seen.select(key, F.col("mtime").alias("__m"), F.col("size").alias("__s"))
    b = listed.select(key, F.col("mtime").alias("__n"), F.col("size").alias("__t"))
    same = F.col("__m").eqNullSafe(F.col("__n")) & F.col("__s").eqNullSafe(F.col("__t"))
    status = F.when(F.col("__s").isNull(), "new").when(F.col("__t").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def three_way(canonical: DataFrame, store: DataFrame, baseline: DataFrame, key: str, digest: str = "digest") -> DataFrame:
    """(key, c, w, b): the identities of each resource on all sides, null where it is absent."""
    side = lambda df, name: df.select(key, F.col(digest).alias(name))
    return side(canonical, "c").join(side(store, "w"), key, "full_outer").join(side(baseline, "b"), key, "full_outer")


def _allowed(category: Column, direction: str, move: Column) -> Column:
    if direction == "bidirectional":
        return F.lit(True)
    own = _FROM_FILE if direction == DIRECTIONS[1] else _FROM_STORE
    return category.isin(*own) | ((category == "moved") & (move == direction)) | ~category.isin(*_FROM_FILE, *_FROM_STORE, "moved")


def classify(states: DataFrame, direction: str = "bidirectional", deletion: str = "preserve", preference: str = "none") -> DataFrame:
    """Add category and reason to (c, w, b) and, where given, moved, move_direction, unmanaged and proven (all default to false or null).

    What each side did since the baseline decides; then what the direction and the deletion policy disallow becomes a conflict; then a preference may
    settle conflicts. The truth table is enumerated in the tests.
    """
    if direction not in DIRECTIONS or deletion not in DELETIONS or preference not in PREFERENCES:
        raise ValueError(f"unknown policy: {direction}, {deletion}, {preference}")
    have = set(states.columns)
    opt = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    c, w, b = F.col("c"), F.col("w"), F.col("b")
    move = F.col("move_direction") if "move_direction" in have else F.lit(None).cast("string")
    alike, c_new, w_new = c.eqNullSafe(w), ~c.eqNullSafe(b), ~w.eqNullSafe(b)
    settled = F.when(opt("moved", False) & c.isNotNull(), "moved").when(opt("unmanaged", False) & F.lit(direction == DIRECTIONS[2]), "written_from_wordpress").otherwise("unchanged")
    fresh = F.when(w.isNull(), "created").when(c.isNull(), "written_from_wordpress").otherwise("conflicts")
    from_file = F.when(c.isNull(), "deleted_from_file").otherwise("updated_from_file")
    from_store = F.when(w.isNull(), "deleted_from_wordpress").otherwise("written_from_wordpress")
    first = F.when(alike, settled).when(b.isNull(), fresh).when(c_new & ~w_new, from_file).when(w_new & ~c_new, from_store).otherwise("conflicts")
    x = states.withColumn("__cat", first)
    cat = F.col("__cat")
    why = F.when(cat != "conflicts", None).when(b.isNull(), "divergent_without_baseline").otherwise("both_sides_changed")
    barred = ~cat.isin("conflicts", "unchanged") & ~_allowed(cat, direction, move)
    x = x.withColumn("__why", F.when(barred, "direction_disallows_change").otherwise(why)).withColumn("__cat", F.when(barred, "conflicts").otherwise(cat))
    unproven = F.col("__cat").isin("deleted_from_file", "deleted_from_wordpress") & (F.lit(deletion != "managed") | ~opt("proven", False))
    x = x.withColumn("__why", F.when(unproven, "deletion_not_proven").otherwise(F.col("__why"))).withColumn("__cat", F.when(unproven, "conflicts").otherwise(F.col("__cat")))
    if preference != "none":
        to, side = ("updated_from_file", c) if preference == "prefer_canonical" else ("written_from_wordpress", w)
        won = (F.col("__cat") == "conflicts") & side.isNotNull() & _allowed(F.lit(to), direction, move)
        x = x.withColumn("__why", F.when(won, None).otherwise(F.col("__why"))).withColumn("__cat", F.when(won, to).otherwise(F.col("__cat")))
    return x.withColumnsRenamed({"__cat": "category", "__why": "reason"})


def outcomes(entries: DataFrame) -> DataFrame:
    """Add effect and next to classified (c, w, b): to_store, to_files, drop_from_store, drop_from_files or null; and the identity that both sides then agree on, which
    is the next baseline (null: none). Conflicts and what is unchanged change nothing and keep their baseline."""
    cat = F.col("category")
    effect = F.when(cat.isin("created", "updated_from_file"), "to_store").when(cat == "written_from_wordpress", "to_files").when(cat == "deleted_from_file", "drop_from_store").when(cat == "deleted_from_wordpress", "drop_from_files")
    after = F.when(cat.isin("created", "updated_from_file", "moved"), F.col("c")).when(cat == "written_from_wordpress", F.col("w")).when(cat.isin("conflicts", "unchanged"), F.col("b"))
    return entries.withColumn("effect", effect).withColumn("next", after)


def applied(entries: DataFrame) -> DataFrame:
    """The states (c, w, b) that outcomes() leads to, other columns as they are; resources that are then on no side are gone. Nothing is moved any more."""
    x = outcomes(entries)
    c = F.when(F.col("effect") == "to_files", F.col("w")).when(F.coalesce(F.col("effect") != "drop_from_files", F.lit(True)), F.col("c"))
    w = F.when(F.col("effect") == "to_store", F.col("c")).when(F.coalesce(F.col("effect") != "drop_from_store", F.lit(True)), F.col("w"))
    after = x.withColumns({"c": c, "w": w, "b": F.col("next")}).drop("category", "reason", "effect", "next")
    after = after.withColumn("moved", F.lit(False)) if "moved" in after.columns else after
    return after.where("c IS NOT NULL OR w IS NOT NULL")


def validated(states: DataFrame, key: str) -> DataFrame:
    """(c, w, b) states as they are; a key that is null or repeats, or a resource that is on no side, raises."""
    bad = states.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("c", "w", "b").isNull()).alias("absent")).where((F.col("n") > 1) | (F.col("absent") > 0) | F.col(key).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][key]} has {bad[0].n} states, {bad[0].absent} of them on no side")
    return states


def category_counts(entries: DataFrame) -> DataFrame:
    """(category, n) for all eight categories, zeros included."""
    spark = entries.sparkSession
    every = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    return every.join(entries.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def keyset_page(entries: DataFrame, key: str, after: str | None, n: int) -> DataFrame:
    """The n entries that follow key `after`; 1 to 1000."""
    if not 1 <= n <= 1000:
        raise ValueError("a page has 1 to 1000 entries")
    rest = entries if after is None else entries.where(F.col(key) > after)
    return rest.orderBy(key).limit(n)


def suffix_digest(entries: DataFrame, key: str, digest: str, after: str | None) -> DataFrame:
    """A digest of what follows `after`: order-free sums of row hashes, so it needs no gathering in one task."""
    rest = entries if after is None else entries.where(F.col(key) > after)
    h = F.xxhash64(key, digest)
    return rest.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum((h % 1000003).cast("long")), F.lit(0)).alias("s"))


def apply_order(entries: DataFrame, deleted: str = "is_delete", depth: str = "depth", key: str = "resource_id") -> DataFrame:
    """Parents before children; deletions last, children before parents."""
    return entries.orderBy(F.col(deleted), F.when(F.col(deleted), -F.col(depth)).otherwise(F.col(depth)), key)


def _row_hash(rows: DataFrame) -> Column:
    """A hash of each row, of the columns that can be named and hashed; it depends on nothing else, so a task that runs again deals rows out alike."""
    names = [c.lower() for c in rows.columns]
    plain = [f.name.replace("`", "``") for f in rows.schema if names.count(f.name.lower()) == 1 and not re.search(r"\bmap<|\bvariant\b", f.dataType.simpleString())]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def priority_match(rows: DataFrame, targets: DataFrame, pairs: list[tuple[str, str]], ident: str, strict: bool = False) -> DataFrame:
    """Match rows to targets by the first of several key pairs that finds exactly one target; adds `matched`. Keys that aren't unique match nothing, or raise if strict,
    and so does then a row that has a key but no target.

    Rows may lack a key, and many may share one, so a task's share of them isn't bounded by its share of keys: those without a key are spread by a hash of the whole row, and
    rows stream past a hash table of the task's targets, one entry a key, instead of being sorted.
    """
    out, found, spread = rows, [], _row_hash(rows)
    for k, (own, other) in enumerate(pairs):
        one = targets.where(F.col(other).isNotNull()).groupBy(F.col(other).alias(f"__k{k}")).agg(F.min(ident).alias(f"__m{k}"), F.count(F.lit(1)).alias(f"__n{k}"))
        place = F.when(F.col(own).isNull(), spread).otherwise(F.lit(1))  # the other side's is always 1, but not as a literal, which would leave the join's key
        out = out.join(one.hint("shuffle_hash"), (F.col(own) == F.col(f"__k{k}")) & (place == F.least(F.col(f"__n{k}"), F.lit(1))), "left")
        found.append(F.when(F.col(f"__n{k}") == 1, F.col(f"__m{k}")))
    matched = F.coalesce(*found)
    if strict:
        several = F.coalesce(*[F.when(F.col(f"__n{k}") > 1, F.lit(True)) for k in range(len(pairs))], F.lit(False))
        keyed = F.coalesce(*[F.col(own).cast("string") for own, _ in pairs])
        matched = F.when(several & matched.isNull(), F.raise_error(F.concat(F.lit("several targets for "), keyed)).cast(dict(targets.dtypes)[ident])).when(matched.isNull() & keyed.isNotNull(), F.raise_error(F.concat(F.lit("no target for "), keyed)).cast(dict(targets.dtypes)[ident])).otherwise(matched)
    return out.withColumn("matched", matched).drop(*[f"__{x}{k}" for x in "kmn" for k in range(len(pairs))])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def store_digest(rows: DataFrame, *columns: Column) -> DataFrame:
    """(n, digest) of all rows: 60-bit prefixes of SHA-256 combined by exclusive or, so partial results combine and nothing is gathered."""
    h = F.sha2(F.concat_ws("\x1f", *[c.cast("string") for c in columns]), 256)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.conv(F.left(h, F.lit(15)), 16, 10).cast("bigint")).alias("digest"))
