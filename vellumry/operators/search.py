"""Content search: contains-matching without case, needles from LIKE patterns, and pages of the newest matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A search backend: (posts, needle) -> DataFrame of ID.
Backend = Callable[[DataFrame, str], DataFrame]


def needle_of_pattern(pattern: str) -> str | None:
    """The literal in a %literal% pattern, unescaped; None if there is an unescaped wildcard inside or none around."""
    if len(pattern) < 2 or pattern[0] != "%" or pattern[-1] != "%":
        return None
    out, k, inner = [], 0, pattern[1:-1]
    while k < len(inner):
        c, after = inner[k], inner[k + 1 : k + 2]
        if c == "\\" and after and after in "%_\\'":
            out.append(after)
            k += 2
        elif c == "'" and after == "'":
            out.append("'")
            k += 2
        elif c in "%_":
            return None
        else:
            out.append(c)
            k += 1
    return "".join(out)


def contains_nocase(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(needle)))


def matching_ids(posts: DataFrame, needle: str, text: str = "post_content", backend: Backend | None = None) -> DataFrame:
    """(ID) of posts whose text contains the needle, ascending; an empty needle matches nothing."""
    if not needle:
        return posts.select("ID").where(F.lit(False))
    if backend is not None:
        return backend(posts, needle).select("ID").orderBy("ID")
    return posts.where(contains_nocase(F.col(text), needle)).select("ID").orderBy("ID")


def newest_matches(posts: DataFrame, needle: str, order: str, n: int = 20) -> DataFrame:
    """The n newest matches by column `order`, ties by ID. Rows are ranked without their text, which joins only the few that stay."""
    if not needle:
        return posts.limit(0)
    top = posts.where(contains_nocase(F.col("post_content"), needle)).select("ID", order).orderBy(F.desc(order), "ID").limit(n)
    return top


def with_content(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """Fill in empty or missing post_content of rows by ID."""
    own = contents.select("ID", F.col("post_content").alias("__stored"))
    return rows.join(own, "ID", "left").withColumn("post_content", F.coalesce(F.nullif("post_content", F.lit("")), "__stored")).drop("__stored")


def where_like(posts: DataFrame, pattern: str, text: str = "post_content") -> DataFrame:
    """Rows that match LIKE pattern without case; a %literal% pattern becomes a plain contains."""
    needle = needle_of_pattern(pattern)
    if needle is None:
        return posts.where(F.ilike(F.col(text), F.lit(pattern)))
    return posts.where(contains_nocase(F.col(text), needle)) if needle else posts.where(F.lit(False))


def counts_of(posts: DataFrame, needles: list[str], text: str = "post_content") -> DataFrame:
    """(needle, n) of texts that hold each needle, in one pass; empty needles and those that nothing holds are left out."""
    found = F.array_compact(F.array(*[F.when(contains_nocase(F.col(text), x), F.lit(x)) for x in dict.fromkeys(needles) if x]))
    return posts.select(F.explode(found).alias("needle")).groupBy("needle").agg(F.count(F.lit(1)).alias("n"))
