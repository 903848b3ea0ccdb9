"""Posts and the files that hold them: which frontmatter field is which column, in both profiles, with defaults; whole files from posts, their metadata and terms;
and posts back from files. Everything but the YAML text itself is built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumry.functions import text as fx
from vellumry.functions import yamlish
from vellumry.operators import content

NEVER = "0000-00-00 00:00:00"
#: Column, type, default, and frontmatter field (None: not kept in files). Dates fall back on each other, see dates().
COLUMNS = (
    ("ID", "bigint", 0, "id"),
    ("source_identity", "string", "", "source_identity"),
    ("post_title", "string", "", "title"),
    ("post_status", "string", "draft", "status"),
    ("post_type", "string", "post", "type"),
    ("post_author", "bigint", 0, "author"),
    ("post_date", "string", NEVER, "date"),
    ("post_date_gmt", "string", NEVER, "date_gmt"),
    ("post_modified", "string", NEVER, "modified"),
    ("post_modified_gmt", "string", NEVER, "modified_gmt"),
    ("post_name", "string", "", "slug"),
    ("post_parent", "bigint", 0, "parent"),
    ("menu_order", "bigint", 0, "menu_order"),
    ("comment_status", "string", "open", "comment_status"),
    ("ping_status", "string", "open", "ping_status"),
    ("guid", "string", "", "guid"),
    ("comment_count", "bigint", 0, "comment_count"),
    ("post_excerpt", "string", "", "excerpt"),
    ("post_password", "string", "", "password"),
    ("post_mime_type", "string", "", "mime_type"),
    ("post_content", "string", "", None),
    ("post_content_filtered", "string", "", None),
    ("to_ping", "string", "", None),
    ("pinged", "string", "", None),
)
#: Left out of files where they are empty.
_SPARSE = ("source_identity", "post_excerpt", "post_password", "post_mime_type")
#: What may change without the content having changed.
_INCIDENTAL = ("ID", "source_identity", "post_modified", "post_modified_gmt", "guid", "comment_count")
PROFILES = ("native", "portable")


def completed(posts: DataFrame) -> DataFrame:
    """posts with all of COLUMNS, missing and null ones filled in by their defaults, in that order; other columns behind them."""
    have = {c.lower(): c for c in posts.columns}
    own = [F.coalesce(F.col(have[c.lower()]).cast(t), F.lit(d)).alias(c) if c.lower() in have else F.lit(d).cast(t).alias(c) for c, t, d, _ in COLUMNS]
    known = {c.lower() for c, *_ in COLUMNS}
    return posts.select(*own, *[F.col(c) for c in posts.columns if c.lower() not in known])


def _quoted(value: Column) -> Column:
    """A string as JSON."""
    j = F.to_json(F.array(value))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def _object(keys_values: Column) -> Column:
    """A JSON object of an array of structs (k, j) of names and JSON values, in this order; null if there are none."""
    return F.when(F.size(keys_values) > 0, F.concat(F.lit("{"), F.array_join(F.transform(keys_values, lambda p: F.concat(_quoted(p["k"]), F.lit(":"), p["j"])), ","), F.lit("}")))


def meta_json(meta: DataFrame, allow: tuple[str, ...] = ("_thumbnail_id", "_wp_page_template")) -> DataFrame:
    """(ID, meta): the public metadata (post_id, meta_id, meta_key, meta_value) of each post as JSON: one value as itself, several as a list; keys in order."""
    kept = content.grouped_meta(content.public_meta(meta.where("meta_key <> ''"), allow))
    one = F.when(F.size("values") == 1, _quoted(F.coalesce(F.element_at("values", 1), F.lit("")))).otherwise(F.to_json("values"))
    pairs = kept.groupBy(F.col("post_id").alias("ID")).agg(F.array_sort(F.collect_list(F.struct(F.col("meta_key").alias("k"), one.alias("j")))).alias("__p"))
    return pairs.select("ID", _object(F.col("__p")).alias("meta"))


def terms_json(terms: DataFrame) -> DataFrame:
    """(ID, terms, tags): the slugs (object_id, taxonomy, slug) of each post by taxonomy as JSON; and those of the taxonomy post_tag."""
    lists = content.grouped_terms(terms.where("taxonomy <> '' AND slug <> ''")).withColumn("j", F.to_json("slugs"))
    pairs = lists.groupBy(F.col("object_id").alias("ID")).agg(F.array_sort(F.collect_list(F.struct(F.col("taxonomy").alias("k"), "j"))).alias("__p"), F.max(F.when(F.col("taxonomy") == "post_tag", F.col("slugs"))).alias("tags"))
    return pairs.select("ID", _object(F.col("__p")).alias("terms"), "tags")


def with_details(posts: DataFrame, meta: DataFrame | None = None, terms: DataFrame | None = None, allow: tuple[str, ...] = ("_thumbnail_id", "_wp_page_template")) -> DataFrame:
    """completed(posts) with the columns meta and terms (JSON, or null) and tags."""
    out = completed(posts)
    for name, kind in (("meta", "string"), ("terms", "string"), ("tags", "array<string>")):
        if name in out.columns and (meta is not None if name == "meta" else terms is not None):
            out = out.drop(name)
    if meta is not None:
        out = out.join(meta_json(meta, allow), "ID", "left")
    if terms is not None:
        out = out.join(terms_json(terms), "ID", "left")
    for name, kind in (("meta", "string"), ("terms", "string"), ("tags", "array<string>")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def _fields() -> list[Column]:
    """Frontmatter fields with their values, those that are left out as null."""
    return [(F.nullif(F.col(c), F.lit("")) if c in _SPARSE else F.col(c)).alias(f) for c, _, _, f in COLUMNS if f]


def frontmatter_json(profile: str = "native") -> Column:
    """The frontmatter of with_details() rows as JSON, its fields in the profile's order."""
    if profile not in PROFILES:
        raise KeyError(f"no profile is named {profile}")
    flat = F.to_json(F.struct(*_fields()))
    extra = lambda name: F.coalesce(F.concat(F.lit(f',"{name}":'), F.col(name)), F.lit(""))
    native = F.concat(F.substring(flat, F.lit(1), F.length(flat) - 1), extra("meta"), extra("terms"), F.lit("}"))
    if profile == "native":
        return native
    date = F.when(F.col("post_date_gmt").isin("", NEVER), F.col("post_date")).otherwise(F.col("post_date_gmt"))
    stamp = F.coalesce(fx.portable_timestamp(fx.parsed_timestamp(date)), F.lit(""))
    resource = F.coalesce(F.nullif("guid", F.lit("")), "post_name")
    head = F.to_json(F.struct(F.lit("document").alias("type"), F.col("post_title").alias("title"), F.col("post_excerpt").alias("description"), resource.alias("resource"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), stamp.alias("timestamp")))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"wordpress":'), native, F.lit("}"))


def file_text(profile: str = "native") -> Column:
    """The whole file of with_details() rows: frontmatter between fences, a blank line, the body and a line feed."""
    return F.concat(F.lit("---\n"), yamlish.encoded_yaml(frontmatter_json(profile)), F.lit("---\n\n"), F.coalesce("post_content", F.lit("")), F.lit("\n"))


def posts_of(files: DataFrame, front: str = "frontmatter", body: str = "post_content") -> DataFrame:
    """COLUMNS, meta, terms (JSON), tags and profile of rows that hold frontmatter as JSON and a body; other columns stay behind them.

    A file whose frontmatter has a `wordpress` map is portable. Missing fields get their defaults; each date falls back on the next one of its chain:
    modified_gmt, modified, date (in portable files modified_gmt, modified, date_gmt, date, the document's timestamp), date_gmt on date.
    """
    j = F.col(front)
    portable = F.get_json_object(j, "$.wordpress").startswith("{")
    get = lambda f: F.when(portable, F.get_json_object(j, f"$.wordpress.{f}")).otherwise(F.get_json_object(j, f"$.{f}"))
    stamp = F.when(portable, F.coalesce(F.date_format(fx.parsed_timestamp(F.left(F.get_json_object(j, "$.timestamp"), F.lit(19))), "yyyy-MM-dd HH:mm:ss")))
    date = F.coalesce(get("date"), stamp, F.lit(NEVER))
    modified = F.coalesce(get("modified"), date)
    special = {
        "post_title": F.coalesce(F.get_json_object(j, "$.title"), F.lit("")),
        "post_date": date,
        "post_date_gmt": F.coalesce(get("date_gmt"), date),
        "post_modified": modified,
        "post_modified_gmt": F.coalesce(get("modified_gmt"), get("modified"), F.when(portable, get("date_gmt")), date),
        "post_excerpt": F.coalesce(get("excerpt"), F.when(portable, F.get_json_object(j, "$.description")), F.lit("")),
        "guid": F.coalesce(get("guid"), F.when(portable, F.get_json_object(j, "$.resource")), F.lit("")),
        "post_content": F.coalesce(F.col(body), F.lit("")),
    }
    own = [(special.get(c) if c in special else F.coalesce(get(f).try_cast(t), F.lit(d)) if f else F.lit(d)).cast(t).alias(c) for c, t, d, f in COLUMNS]
    lists = F.map_entries(F.from_json(F.when(get("terms").startswith("{"), get("terms")), "map<string,array<string>>"))
    terms = _object(F.array_sort(F.transform(lists, lambda p: F.struct(p["key"].alias("k"), F.to_json(F.array_sort(p["value"])).alias("j")))))
    extra = [F.when(get("meta").startswith("{"), get("meta")).alias("meta"), terms.alias("terms")]
    tags = F.when(portable, F.from_json(F.get_json_object(j, "$.tags"), "array<string>")).otherwise(F.from_json(F.get_json_object(j, "$.terms.post_tag"), "array<string>"))
    taken = {c.lower() for c, *_ in COLUMNS} | {"meta", "terms", "tags", "profile"}
    rest = [F.col(c) for c in files.columns if c.lower() not in taken]
    return files.select(*own, *extra, tags.alias("tags"), F.when(portable, "portable").otherwise("native").alias("profile"), *rest)


def receipt() -> Column:
    """A digest of with_details() rows: their content fields, metadata and terms, names in order; not when or how often they were touched."""
    names = sorted(c for c, *_ in COLUMNS if c not in _INCIDENTAL)
    flat = F.to_json(F.struct(*[F.col(c).alias(c) for c in names]))
    return F.sha2(F.concat_ws("\x1f", flat, F.coalesce("meta", F.lit("{}")), F.coalesce("terms", F.lit("{}"))), 256)


def meta_rows(posts: DataFrame) -> DataFrame:
    """(post_id, meta_key, meta_value) of the JSON column meta: a list is a row for each of its values."""
    m = posts.where("meta IS NOT NULL").select(F.col("ID").alias("post_id"), F.explode(F.from_json("meta", "map<string,string>")).alias("meta_key", "v"))
    values = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))
    return m.select("post_id", "meta_key", F.explode(values).alias("meta_value"))


def term_rows(posts: DataFrame) -> DataFrame:
    """(object_id, taxonomy, slug) of the JSON column terms."""
    t = posts.where("terms IS NOT NULL").select(F.col("ID").alias("object_id"), F.explode(F.from_json("terms", "map<string,array<string>>")).alias("taxonomy", "slugs"))
    return t.select("object_id", "taxonomy", F.explode("slugs").alias("slug"))
