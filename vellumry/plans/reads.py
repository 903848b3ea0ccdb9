"""Queries that read: filters, search, scalar functions, sorts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry.functions import text as fx
from vellumry.operators import content, mutations, reconcile, search
from vellumry.plans import roles
from vellumry.plans.registry import query
from vellumry.plans.roles_sql import META, POSTS


@query(f'SELECT "ID", post_name FROM {POSTS} WHERE "ID" IN (1, 5, 9, 77)')
def p1_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    return roles.posts(spark, sf).where(F.col("ID").isin(1, 5, 9, 77)).select("ID", "post_name")


@query(f'SELECT "ID", post_name FROM {POSTS}')
def p2_without_transport(spark: SparkSession, sf: str) -> DataFrame:
    p = roles.posts(spark, sf).select("ID", "post_name", F.col("post_type").alias("_source_file"), F.lit("raw").alias("filter"))
    return content.without_transport(p)


@query(f"""SELECT "ID", post_type FROM {POSTS} WHERE post_type NOT IN ('de', 'fr')""")
def p3_content_types(spark: SparkSession, sf: str) -> DataFrame:
    return content.of_content_types(roles.posts(spark, sf), ("de", "fr")).select("ID", "post_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' OR o_orderstatus IS NULL OR o_orderkey % 5 = 0")
def p4_without_drafts(spark: SparkSession, sf: str) -> DataFrame:
    # Of some orders the status can't be looked up: they stay.
    status = F.when(F.col("o_orderkey") % 5 != 0, F.when(F.col("o_orderstatus") == "P", "auto-draft").otherwise("publish"))
    return content.without_drafts(roles.table(spark, sf, "orders").withColumn("post_status", status)).select("o_orderkey")


_OPTION = "CASE event_id % 6 WHEN 0 THEN '_transient_' WHEN 1 THEN '_site_transient_' WHEN 2 THEN '_edit_lock_' WHEN 3 THEN 'cron' ELSE 'opt_' END || CASE WHEN event_id % 6 = 3 THEN '' ELSE event_id::VARCHAR END"


@query(f"SELECT option_name FROM (SELECT {_OPTION} AS option_name FROM events) WHERE NOT (starts_with(option_name, '_transient_') OR starts_with(option_name, '_site_transient_') OR starts_with(option_name, '_wp_session_') OR starts_with(option_name, '_edit_lock_') OR option_name = 'cron')")
def p5_durable_options(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 6
    name = F.when(k == 0, "_transient_").when(k == 1, "_site_transient_").when(k == 2, "_edit_lock_").when(k == 3, "cron").otherwise("opt_")
    o = roles.events(spark, sf).select(F.concat(name, F.when(k == 3, "").otherwise(F.col("event_id").cast("string"))).alias("option_name"))
    return o.where(~fx.is_ephemeral(F.col("option_name"), names=("cron",)))


@query("SELECT lower(n_name) AS table_name, CASE WHEN lower(n_name) IN ('nation_1', 'nation_2') THEN 'ephemeral' WHEN lower(n_name) = 'nation_3' THEN 'never' WHEN lower(n_name) = 'nation_4' THEN 'partition' ELSE 'snapshot' END AS how FROM nation")
def p7_table_policy(spark: SparkSession, sf: str) -> DataFrame:
    n = roles.table(spark, sf, "nation").select(F.lower("n_name").alias("table_name"))
    policy = content.TablePolicy(ephemeral=("nation_1", "nation_2"), never=("nation_3",), partitioned=("nation_4",))
    return n.select("table_name", policy.how(F.col("table_name")).alias("how"))


@query(f"SELECT post_id, meta_key, meta_value FROM {META} WHERE NOT starts_with(meta_key, '_')")
def p8_public_meta(spark: SparkSession, sf: str) -> DataFrame:
    return content.public_meta(roles.postmeta(spark, sf)).select("post_id", "meta_key", "meta_value")


@query(f"""SELECT "ID", post_name FROM {POSTS} WHERE post_content ILIKE '%tion%'""")
def p9_like_as_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = roles.posts(spark, sf)
    return search.where_like(p, "%TION%").select("ID", "post_name")


@query("SELECT page_id FROM pages WHERE url ILIKE '%utm\\_SOURCE%' ESCAPE '\\'")
def p10_escaped_needle(spark: SparkSession, sf: str) -> DataFrame:
    needle = search.needle_of_pattern(r"%utm\_SOURCE%")
    return roles.table(spark, sf, "pages").where(search.contains_nocase(F.col("url"), needle)).select("page_id")


@query("SELECT doc_id AS \"ID\" FROM documents WHERE contains(lower(text), 'there') ORDER BY 1")
def p11_content_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.matching_ids(roles.posts(spark, sf), "There")


@query("SELECT page_id AS \"ID\" FROM pages WHERE contains(lower(html), '<title>de') ORDER BY 1")
def p11_whole_file_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.matching_ids(roles.table(spark, sf, "pages").select(F.col("page_id").alias("ID"), "html"), "<TITLE>De", "html")


@query("SELECT needle, count(*) AS n FROM documents JOIN (VALUES ('the'), ('und'), ('tion'), ('zzzzqq')) v(needle) ON contains(lower(text), needle) GROUP BY needle")
def p12_many_needles(spark: SparkSession, sf: str) -> DataFrame:
    return search.counts_of(roles.posts(spark, sf), ["the", "und", "tion", "zzzzqq", ""])


_READS = ["SELECT * FROM wp_posts WHERE ID = {k}", "select ID, post_content from `wp_posts`", "SELECT ID FROM wp_posts", "SELECT * FROM wp_options", "UPDATE wp_posts SET post_content = '*'", "  SELECT p.*\nFROM wp_posts p", "SELECT post_content FROM wp_posts2", "SELECT count(*) FROM wp_posts"]


@query("SELECT event_id AS n, event_id % 8 IN (0, 1, 5, 7) AS reads_content FROM events")
def p13_content_queries(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    sql = F.replace(F.element_at(F.array(*map(F.lit, _READS)), (k % len(_READS) + 1).cast("int")), F.lit("{k}"), k.cast("string"))
    return roles.events(spark, sf).select(k.alias("n"), mutations.reads_content(sql).alias("reads_content"))


_PATHS = "(SELECT page_id, CASE page_id % 5 WHEN 0 THEN '../' || p WHEN 1 THEN '/' || p WHEN 2 THEN p || '//x' ELSE p END AS path FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages))"


@query(f"SELECT page_id, path FROM {_PATHS} WHERE NOT list_has_any(string_split(path, '/'), ['', '.', '..']) AND NOT contains(path, chr(92)) AND NOT contains(path, chr(10)) AND NOT contains(path, chr(9))")
def p14_safe_paths(spark: SparkSession, sf: str) -> DataFrame:
    p, k = F.regexp_replace("url", "^[a-z]+://", ""), F.col("page_id") % 5
    path = F.when(k == 0, F.concat(F.lit("../"), p)).when(k == 1, F.concat(F.lit("/"), p)).when(k == 2, F.concat(p, F.lit("//x"))).otherwise(p)
    x = roles.table(spark, sf, "pages").select("page_id", path.alias("path"))
    return x.where(fx.safe_path(F.col("path")))


@query("SELECT user_id, count_if(event_type = 'purchase' AND props <> '') > 0 AS installed FROM events GROUP BY user_id")
def p15_installed(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("event_type") == "purchase", "siteurl").otherwise(F.col("event_type"))
    options = roles.events(spark, sf).select("user_id", name.alias("option_name"), F.col("props").alias("option_value"))
    return content.installed(options, "user_id")


@query(f"SELECT \"ID\", post_type FROM {POSTS} WHERE post_name = 'doc-42'")
def p16_by_slug(spark: SparkSession, sf: str) -> DataFrame:
    return roles.posts(spark, sf).where("post_name = 'doc-42'").select("ID", "post_type")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-12' ORDER BY ts DESC, event_id LIMIT 20")
def p16_date_range(spark: SparkSession, sf: str) -> DataFrame:
    e = roles.events(spark, sf).where("ts >= TIMESTAMP_NTZ '2024-01-02' AND ts < TIMESTAMP_NTZ '2024-01-12'")
    return e.select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(20)


@query(f"""SELECT p."ID", p.file_size, m.meta_value AS toxic FROM (SELECT * FROM {POSTS} WHERE contains(lower(post_content), 'the') ORDER BY file_size DESC, "ID" LIMIT 20) p LEFT JOIN {META} m ON m.post_id = p."ID" AND m.meta_key = 'toxic'""")
def p16_newest_search(spark: SparkSession, sf: str) -> DataFrame:
    top = search.newest_matches(roles.posts(spark, sf), "the", "file_size")
    meta = roles.postmeta(spark, sf).where("meta_key = 'toxic'").select(F.col("post_id").alias("ID"), F.col("meta_value").alias("toxic"))
    return top.join(meta, "ID", "left")


@query(f'SELECT "ID", post_name, post_type FROM {POSTS} ORDER BY "ID"')
def t1_ordered_rows(spark: SparkSession, sf: str) -> DataFrame:
    return content.table_rows(roles.posts(spark, sf).select("ID", "post_name", "post_type"))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 25")
def t2_limited_rows(spark: SparkSession, sf: str) -> DataFrame:
    return content.table_rows(roles.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), limit=25)


@query("SELECT 'post:' || lpad(o_orderkey::VARCHAR, 20, '0') AS resource_id FROM orders WHERE o_orderkey > 300 ORDER BY 1 LIMIT 100")
def t3_keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    o = roles.table(spark, sf, "orders").select(fx.resource_key("post", F.col("o_orderkey")).alias("resource_id"))
    return reconcile.keyset_page(o, "resource_id", "post:" + "300".rjust(20, "0"), 100)


def _dashes(text: str) -> str:
    """SQL that puts a dash for each byte of a character that isn't ASCII."""
    for first, last, n in ((0x80, 0x7FF, 2), (0x800, 0xFFFF, 3), (0x10000, 0x10FFFF, 4)):
        text = f"regexp_replace({text}, '[\\x{{{first:X}}}-\\x{{{last:X}}}]', '{'-' * n}', 'g')"
    return text


@query(f"SELECT coalesce(nullif(trim(regexp_replace({_dashes('url')}, '[^a-zA-Z0-9_-]', '-', 'g'), '-'), ''), 'unnamed') AS slug, page_id FROM pages")
def f3_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return roles.table(spark, sf, "pages").select("page_id", fx.slug(F.col("url")).alias("slug"))


@query(f"SELECT coalesce(nullif(trim(regexp_replace({_dashes('left(text, 60)')}, '[^a-zA-Z0-9_-]', '-', 'g'), '-'), ''), 'unnamed') AS slug, doc_id FROM documents")
def f3_slugs_of_texts(spark: SparkSession, sf: str) -> DataFrame:
    return roles.table(spark, sf, "documents").select("doc_id", fx.slug(F.left("text", F.lit(60))).alias("slug"))


@query("SELECT coalesce(nullif(trim(lower(regexp_replace(url, '[^A-Za-z0-9_-]+', '-', 'g')), '-'), ''), 'untitled') AS segment, page_id FROM pages")
def f4_segments(spark: SparkSession, sf: str) -> DataFrame:
    return roles.table(spark, sf, "pages").select("page_id", fx.safe_segment(F.col("url")).alias("segment"))


@query("""SELECT page_id, CASE WHEN safe <> url OR strlen(url) > 180 THEN left(safe, 180) || '-' || left(md5(url), 8) || '.json' ELSE safe || '.json' END AS file_name FROM
  (SELECT *, coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g'), '._'), ''), 'option') AS safe FROM pages)""")
def f5_option_files(spark: SparkSession, sf: str) -> DataFrame:
    return roles.table(spark, sf, "pages").select("page_id", fx.option_filename(F.col("url")).alias("file_name"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS stamp FROM events")
def f6_portable_dates(spark: SparkSession, sf: str) -> DataFrame:
    return roles.events(spark, sf).select("event_id", fx.portable_timestamp(F.col("ts")).alias("stamp"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN epoch(date_trunc('second', ts))::BIGINT END AS seconds FROM events")
def f6_parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "0000-00-00 00:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return roles.events(spark, sf).select("event_id", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp"), fx.parsed_timestamp(text)).alias("seconds"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id END AS declared FROM pages")
def f7_header_ids(spark: SparkSession, sf: str) -> DataFrame:
    ident = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("id: "), F.col("page_id").cast("string"), F.lit("\n")))
    raw = F.concat(F.lit("---\ntitle: x\n"), ident, F.lit("---\n\n"), F.col("html"))
    return roles.table(spark, sf, "pages").select("page_id", fx.header_id(raw).alias("declared"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'u' || user_id ELSE 'e' || event_id END AS slug FROM events")
def f8_slugs_of_paths(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("post/u"), "user_id", F.lit("/index.md"))).otherwise(F.concat(F.lit("post/e"), "event_id", F.lit(".md")))
    return roles.events(spark, sf).select("event_id", fx.slug_of_path(path).alias("slug"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d') END, CASE WHEN event_id % 3 = 0 THEN 'fallback' END, '0000-00-00 00:00:00') AS post_date, coalesce(nullif(event_type, 'view'), 'post') AS post_type FROM events")
def f9_import_defaults(spark: SparkSession, sf: str) -> DataFrame:
    e = roles.events(spark, sf)
    day = content.first_given(F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd")), F.when(F.col("event_id") % 3 == 0, F.lit("fallback")), F.lit("0000-00-00 00:00:00"))
    return e.select("event_id", day.alias("post_date"), content.first_given(F.when(F.col("event_type") != "view", F.col("event_type")), F.lit("post")).alias("post_type"))


@query("SELECT doc_id AS \"ID\", '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'slug: doc-' || doc_id || chr(10) || 'type: ' || lang || chr(10) || '---' || chr(10) || chr(10) || text || chr(10) AS file FROM documents")
def k16_exported_files(spark: SparkSession, sf: str) -> DataFrame:
    p = roles.posts(spark, sf)
    return p.select("ID", content.as_file({"id": F.col("ID"), "slug": F.col("post_name"), "type": F.col("post_type")}, F.col("post_content")).alias("file"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def f11_digests(spark: SparkSession, sf: str) -> DataFrame:
    return roles.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5(F.col("text").cast("binary")).alias("md"))


@query("""SELECT c_custkey, '{' || chr(10) || '  "k" : ' || c_custkey || ',' || chr(10) || '  "n" : "' || c_name || '/é"' || chr(10) || '}' AS j FROM customer""")
def f12_pretty_json(spark: SparkSession, sf: str) -> DataFrame:
    return roles.table(spark, sf, "customer").select("c_custkey", content.pretty_json({"k": F.col("c_custkey"), "n": F.concat("c_name", F.lit("/é"))}).alias("j"))


@query("""SELECT event_id, sha256('{"a":{"k":' || (json_extract(props, '$.k'))::VARCHAR || ',"z":[2,1]},"b":"' || event_type || '"}') AS digest FROM events""")
def f13_sorted_at_every_depth(spark: SparkSession, sf: str) -> DataFrame:
    j = F.format_string('{ "b": "%s", "a": {"z": [2, 1], "k": %d} }', "event_type", F.get_json_object("props", "$.k").cast("bigint"))
    return roles.events(spark, sf).select("event_id", fx.exact_identity(j).alias("digest"))


@query("SELECT page_id, 'a/' || regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+', '/', 'g'), '/$', '') || '/c' AS path FROM pages")
def f15_normal_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = F.regexp_replace("url", "^[a-z]+://", "")
    return roles.table(spark, sf, "pages").select("page_id", fx.normalized_path(F.concat(F.lit(".//a\\b/../"), p, F.lit("/x/./../c/"))).alias("path"))


@query("SELECT count(*) AS n, count(*) AS n_distinct, count(*) AS n_version_4 FROM customer")
def f16_uuids(spark: SparkSession, sf: str) -> DataFrame:
    u = roles.table(spark, sf, "customer").select(F.uuid().alias("u"))
    return u.agg(F.count("u").alias("n"), F.count_distinct("u").alias("n_distinct"), F.count_if(F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("n_version_4"))


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, '{\"k\":' || (json_extract(props, '$.k'))::VARCHAR || ',\"t\":\"' || event_type || '\"}' AS canonical FROM events")
def f13_sorted_json(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return roles.events(spark, sf).select("event_id", k.alias("k"), content.sorted_json({"t": F.col("event_type"), "k": k}).alias("canonical"))


@query("SELECT 'term:' || lpad(n_nationkey::VARCHAR, 20, '0') AS resource FROM nation")
def f14_resource_keys(spark: SparkSession, sf: str) -> DataFrame:
    return roles.table(spark, sf, "nation").select(fx.resource_key("term", F.col("n_nationkey")).alias("resource"))


@query("SELECT doc_id, item FROM (SELECT doc_id, trim(unnest(string_split(lang || ' , ' || source || ',,', ','))) AS item FROM documents) WHERE item <> ''")
def f18_split_lists(spark: SparkSession, sf: str) -> DataFrame:
    return roles.table(spark, sf, "documents").select("doc_id", F.explode(fx.listed(F.concat("lang", F.lit(" , "), "source", F.lit(",,")))).alias("item"))


@query("SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9_-]', '', 'g') AS key FROM part")
def f19_keys(spark: SparkSession, sf: str) -> DataFrame:
    return roles.table(spark, sf, "part").select("p_partkey", fx.sanitized_key(F.col("p_type")).alias("key"))


@query("SELECT event_id, date_sub('second', ts, TIMESTAMP '2024-03-01') AS age, strftime(ts + INTERVAL 90 SECONDS, '%Y-%m-%d %H:%M:%S') AS later, CASE WHEN ts > TIMESTAMP '2024-01-15' THEN 'late' ELSE 'early' END AS half FROM events")
def f21_date_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    return roles.events(spark, sf).selectExpr("event_id", "timestampdiff(SECOND, ts, TIMESTAMP_NTZ '2024-03-01') AS age", "date_format(ts + INTERVAL 90 SECONDS, 'yyyy-MM-dd HH:mm:ss') AS later", "if(ts > TIMESTAMP_NTZ '2024-01-15', 'late', 'early') AS half")
