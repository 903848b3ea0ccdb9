"""Posts with their metadata and taxonomies: grouping into nested form, joins, receipts, normalisation, audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def post_terms(relations: DataFrame, taxonomy: DataFrame, terms: DataFrame) -> DataFrame:
    """(object_id, taxonomy, slug)."""
    return relations.join(taxonomy, "term_taxonomy_id").join(terms, "term_id").select("object_id", "taxonomy", "slug")


def term_map(taxonomy: DataFrame, terms: DataFrame) -> DataFrame:
    """('taxonomy::slug', term_taxonomy_id)."""
    return taxonomy.join(terms, "term_id").select(F.concat_ws("::", "taxonomy", "slug").alias("term_key"), "term_taxonomy_id")


def grouped_meta(meta: DataFrame) -> DataFrame:
    """(post_id, meta_key, values) in order of meta_id; one value is a list of one."""
    pairs = F.array_sort(F.collect_list(F.struct("meta_id", "meta_value")))
    return meta.groupBy("post_id", "meta_key").agg(F.transform(pairs, lambda p: p["meta_value"]).alias("values"))


def public_meta(meta: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """Without internal keys (leading _), but for those allowed."""
    ok = ~F.col("meta_key").startswith("_")
    return meta.where(ok | F.col("meta_key").isin(*allow) if allow else ok)


def grouped_terms(pairs: DataFrame, distinct: bool = True) -> DataFrame:
    """(object_id, taxonomy, slugs), sorted; distinct for reconciliation, with repeats for files."""
    gather = F.collect_set("slug") if distinct else F.collect_list("slug")
    return pairs.groupBy("object_id", "taxonomy").agg(F.array_sort(gather).alias("slugs"))


def audit(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """How many keys are on both sides and on one only."""
    a, b = rows.select(key).distinct().withColumn("__a", F.lit(1)), files.select(key).distinct().withColumn("__b", F.lit(1))
    x = a.join(b, key, "full_outer")
    return x.agg(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("both_sides"), F.count_if(F.col("__b").isNull()).alias("missing_files"), F.count_if(F.col("__a").isNull()).alias("orphan_files"))


def without_transport(rows: DataFrame) -> DataFrame:
    """Without columns that only carry a row about: those that begin with _ and `filter`."""
    return rows.drop(*[c for c in rows.columns if c.startswith("_") or c == "filter"])


def of_content_types(posts: DataFrame, excluded: tuple[str, ...], column: str = "post_type") -> DataFrame:
    return posts.where(~F.col(column).isin(*excluded)) if excluded else posts


def without_drafts(posts: DataFrame, status: str = "post_status") -> DataFrame:
    """Without auto-drafts; posts whose status isn't known stay."""
    return posts.where(F.coalesce(F.col(status) != "auto-draft", F.lit(True)))


def installed(options: DataFrame, *site: str) -> DataFrame:
    """(site columns, installed): whether the site's options hold a siteurl that isn't empty."""
    has = F.count_if((F.col("option_name") == "siteurl") & (F.coalesce("option_value", F.lit("")) != ""))
    return options.groupBy(*site).agg((has > 0).alias("installed"))


@dataclass(frozen=True)
class TablePolicy:
    """How each table's rows last: not at all, in row partitions, or as one snapshot."""

    ephemeral: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    partitioned: tuple[str, ...] = ()

    def how(self, name: Column) -> Column:
        out = F.when(name.isNull(), None)
        for kind, names in (("ephemeral", self.ephemeral), ("never", self.never), ("partition", self.partitioned)):
            if names:
                out = out.when(name.isin(*names), kind)
        return out.otherwise("snapshot")


def table_rows(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows in order of the first column; a negative limit counts as 0."""
    ordered = rows.orderBy(rows.columns[0])
    return ordered if limit is None else ordered.limit(max(0, limit))


def first_given(*values: Column) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def as_file(fields: dict[str, Column], body: Column) -> Column:
    """Flat frontmatter of plain scalars and the body as one file's text; values that need quotes go through yamlish.encoded_yaml."""
    lines = [F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.coalesce(body, F.lit("")), F.lit("\n"))


def sorted_json(fields: dict[str, Column]) -> Column:
    """JSON with keys in order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def pretty_json(fields: dict[str, Column]) -> Column:
    """JSON over several lines, characters and slashes as they are, nulls kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"pretty": "true", "ignoreNullFields": "false"})


def matched_terms(slugs: DataFrame, keys: DataFrame) -> DataFrame:
    """(object_id, term_taxonomy_id) for slugs (object_id, taxonomy, slug) known in keys (term_key, term_taxonomy_id); unknown ones are left out."""
    return slugs.withColumn("term_key", F.concat_ws("::", "taxonomy", "slug")).join(keys, "term_key").select("object_id", "term_taxonomy_id")


def receipts(posts: DataFrame, meta: DataFrame) -> DataFrame:
    """posts with `meta`: their key=value pairs in order, joined by ; (null where there are none)."""
    pairs = meta.groupBy(F.col("post_id").alias("ID")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "meta_key", "meta_value"))), ";").alias("meta"))
    return posts.join(pairs, "ID", "left")
