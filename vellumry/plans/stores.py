"""Queries about files, imports, exports and what reconciliation leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry import tree
from vellumry.functions import yamlish
from vellumry.operators import documents, merge, reconcile, timed
from vellumry.plans import roles
from vellumry.plans.registry import query
from vellumry.plans.relations import _NEW, _OLD, _versions
from vellumry.plans.roles_sql import META, POSTS, STATES, classified
from vellumry.sources import content_files, tables


def _lines(text: str) -> str:
    """SQL that builds these lines, a line feed behind each; {x} stands for the SQL expression x."""
    out = []
    for line in text.strip("\n").split("\n"):
        parts = [p if k % 2 else "'" + p.replace("'", "''") + "'" for k, p in enumerate(line.replace("}", "{").split("{"))]
        out.append(" || ".join(p for p in parts if p != "''") + " || chr(10)" if line else "chr(10)")
    return " || ".join(out)


_YAML = _lines(
    """
id: {doc_id}
lang: {lang}
title: "doc: {doc_id}"
draft: true
none: ""
word: "yes"
number: "007"
tags:
  - {source}
  - "- x"
deep:
  chars: {n_chars}
"""
)


@query(f"SELECT doc_id, {_YAML} AS yaml FROM documents")
def f2_encoded_yaml(spark: SparkSession, sf: str) -> DataFrame:
    fields = [F.col("doc_id").alias("id"), "lang", F.concat(F.lit("doc: "), F.col("doc_id")).alias("title"), F.lit(True).alias("draft"), F.lit("").alias("none"), F.lit("yes").alias("word"), F.lit("007").alias("number"), F.array(F.col("source"), F.lit("- x")).alias("tags"), F.struct(F.col("n_chars").alias("chars")).alias("deep")]
    return roles.table(spark, sf, "documents").select("doc_id", yamlish.encoded_yaml(F.to_json(F.struct(*fields))).alias("yaml"))


@query("SELECT doc_id, text, 'x: ' || source AS nested, doc_id AS number, lang || ',007' AS list FROM documents")
def f1_decoded_yaml(spark: SparkSession, sf: str) -> DataFrame:
    # Whole texts, with all their quotes, colons and line feeds, come back from YAML as they were.
    fields = F.struct("text", F.struct(F.concat(F.lit("x: "), "source").alias("b")).alias("a"), F.col("doc_id").alias("n"), F.array(F.col("lang"), F.lit("007")).alias("l"))
    back = yamlish.decoded_json(yamlish.encoded_yaml(F.to_json(fields)))
    x = roles.table(spark, sf, "documents").select("doc_id", F.from_json(back, "text string, a struct<b: string>, n bigint, l array<string>").alias("r"))
    return x.select("doc_id", "r.text", F.col("r.a.b").alias("nested"), F.col("r.n").alias("number"), F.array_join("r.l", ",").alias("list"))


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: by turns with an id and dates, without an id, without fences, portable."""
    d, k = roles.table(spark, sf, "documents"), F.col("doc_id") % 4
    full = F.format_string('---\nid: %d\ntitle: "T: %d"\nstatus: draft\ndate: 2024-01-02 03:04:05\nparent: 7\n---\n\n', "doc_id", "doc_id")
    bare = F.format_string("---\ntitle: 'it''s %d'\nmodified_gmt: 2024-05-06 07:08:09\nslug: s%d\n---\n", "doc_id", "doc_id")
    portable = F.format_string('---\ntype: document\ntitle: P %d\ndescription: about\ntimestamp: "2024-01-02T03:04:05+00:00"\nwordpress:\n  id: %d\n  type: page\n---\n\n', "doc_id", "doc_id")
    raw = F.concat(F.when(k == 0, full).when(k == 1, bare).when(k == 2, F.lit("")).otherwise(portable), F.col("text"), F.lit("\n"))
    path = F.concat(F.lit("post/"), F.when(k == 3, F.concat(F.lit("p"), F.col("doc_id"), F.lit("/index.md"))).otherwise(F.concat(F.lit("d"), F.col("doc_id"), F.lit(".md"))))
    return d.select(path.alias("path"), F.lit(None).cast("timestamp").alias("mtime"), F.length(raw).cast("long").alias("size"), raw.alias("raw"))


@query(
    """SELECT CASE WHEN k <> 1 THEN nullif(doc_id, 0) END AS id, CASE k WHEN 0 THEN 'T: ' || doc_id WHEN 1 THEN 'it''s ' || doc_id ELSE 'P ' || doc_id END AS title, CASE k WHEN 0 THEN 'draft' ELSE 'publish' END AS status, CASE k WHEN 3 THEN 'page' ELSE 'post' END AS type,
  CASE k WHEN 0 THEN 'd' || doc_id WHEN 1 THEN 's' || doc_id ELSE 'p' || doc_id END AS name, CASE k WHEN 1 THEN '0000-00-00 00:00:00' ELSE '2024-01-02 03:04:05' END AS modified, CASE k WHEN 1 THEN '2024-05-06 07:08:09' ELSE '2024-01-02 03:04:05' END AS modified_gmt,
  CASE k WHEN 0 THEN 7 ELSE 0 END::BIGINT AS parent, CASE k WHEN 3 THEN 'about' ELSE '' END AS excerpt, CASE k WHEN 3 THEN 'portable' ELSE 'native' END AS profile, text AS content FROM (SELECT *, doc_id % 4 AS k FROM documents) WHERE k <> 2"""
)
def s7_parsed_files(spark: SparkSession, sf: str) -> DataFrame:
    p = content_files.parsed(_raw(spark, sf))
    return p.select(F.col("ID").alias("id"), F.col("post_title").alias("title"), F.col("post_status").alias("status"), F.col("post_type").alias("type"), F.col("post_name").alias("name"), F.col("post_modified").alias("modified"), F.col("post_modified_gmt").alias("modified_gmt"), F.col("declared_parent").alias("parent"), F.col("post_excerpt").alias("excerpt"), "profile", F.col("post_content").alias("content"))


@query("SELECT CASE doc_id % 4 WHEN 3 THEN 'portable' ELSE 'native' END AS profile, count(*) AS n FROM documents WHERE doc_id % 4 <> 2 GROUP BY 1")
def k20_profiles_to_migrate(spark: SparkSession, sf: str) -> DataFrame:
    return content_files.parsed(_raw(spark, sf)).groupBy("profile").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace('---|title: x|id: 5|---||', '|', chr(10)) WHEN 1 THEN replace('---|id: 5|title: x|---||', '|', chr(10)) ELSE replace('---|id: 5|---||', '|', chr(10)) END || html AS file FROM pages")
def k5_injected_ids(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 3
    head = F.when(k == 0, F.format_string("---\ntitle: x\nID : %d\n---\n\n", "page_id")).when(k == 1, F.lit("---\ntitle: x\n---\n\n")).otherwise(F.lit(""))
    return roles.table(spark, sf, "pages").select("page_id", tree.with_id(F.concat(head, F.col("html")), F.lit(5)).alias("file"))


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    p = roles.posts(spark, sf).drop("post_author", "file_size")
    return p.withColumns({"post_title": F.concat(F.lit("Title "), F.col("ID")), "post_status": F.lit("publish"), "post_parent": F.coalesce("post_parent", F.lit(0))})


_PARENT = "(CASE WHEN doc_id > 0 THEN (doc_id - 1) // 4 ELSE 0 END)"
_FRONT = _lines(
    f"""
---
id: {{doc_id}}
title: Title {{doc_id}}
status: publish
type: {{lang}}
author: 0
date: "0000-00-00 00:00:00"
date_gmt: "0000-00-00 00:00:00"
modified: "0000-00-00 00:00:00"
modified_gmt: "0000-00-00 00:00:00"
slug: doc-{{doc_id}}
parent: {{{_PARENT}}}
menu_order: 0
comment_status: open
ping_status: open
guid: ""
comment_count: 0
"""
)
_TOXIC = 'CASE WHEN toxic IS NULL THEN \'\' ELSE ' + _lines('meta:\n  toxic: "{toxic}"') + " END"


@query(f"SELECT doc_id AS id, sha256({_FRONT} || {_TOXIC} || '---' || chr(10) || chr(10) || text || chr(10)) AS digest FROM documents LEFT JOIN labels USING (doc_id) WHERE lang <> 'fr'")
def k16_exported_files(spark: SparkSession, sf: str) -> DataFrame:
    files = tree.files_of(_posts(spark, sf), roles.postmeta(spark, sf), excluded=("fr",))
    return files.select(F.col("ID").alias("id"), F.sha2("file", 256).alias("digest"))


@query(
    """WITH RECURSIVE t AS (SELECT doc_id AS id, lang, CASE WHEN doc_id > 0 THEN (doc_id - 1) // 4 ELSE 0 END AS p FROM documents WHERE lang <> 'fr'),
  up(id, above, path) AS (SELECT id, p, 'doc-' || id FROM t UNION ALL SELECT u.id, t.p, 'doc-' || t.id || '/' || u.path FROM up u JOIN t ON t.id = u.above AND u.above > 0)
  SELECT u.id, t.lang || '/' || u.path || CASE WHEN EXISTS (SELECT 1 FROM t c WHERE c.p = u.id AND c.p > 0) THEN '/index.md' ELSE '.md' END AS path FROM up u JOIN t ON t.id = u.id WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.id = u.above AND u.above > 0)"""
)
def k1_paths(spark: SparkSession, sf: str) -> DataFrame:
    return tree.paths_of(_posts(spark, sf), ("fr",)).select(F.col("ID").alias("id"), "path")


@query(f"SELECT 'p' || coalesce(o.p_partkey, n.p_partkey) AS path, CASE WHEN o.p_partkey IS NULL THEN 'created' WHEN n.p_partkey IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM {_OLD} o FULL JOIN {_NEW} n ON o.p_partkey = n.p_partkey WHERE o.p_partkey IS NULL OR n.p_partkey IS NULL OR o.p_partkey % 4 = 0")
def k15_flush_receipts(spark: SparkSession, sf: str) -> DataFrame:
    # Of parts that both versions have, one in two keeps its text.
    old, new = _versions(spark, sf)
    same = F.when(F.col("p_partkey") % 4 == 0, F.col("v")).otherwise(F.lit("same"))
    file = lambda df: df.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("path"), F.concat_ws(" ", "p_name", same).alias("file"))
    return tree.receipts(tree.index(file(old)), file(new))


@query(f"SELECT count_if(o.p_partkey IS NULL)::BIGINT AS created, count_if(o.p_partkey IS NOT NULL AND n.p_partkey IS NOT NULL AND n.p_partkey % 4 = 0)::BIGINT AS updated, count_if(o.p_partkey IS NOT NULL AND n.p_partkey IS NOT NULL AND n.p_partkey % 4 <> 0)::BIGINT AS skipped, count_if(n.p_partkey IS NULL)::BIGINT AS kept FROM {_OLD} o FULL JOIN {_NEW} n ON o.p_partkey = n.p_partkey")
def a6_import_counters(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    value = F.when(F.col("p_partkey") % 4 == 0, F.col("v")).otherwise(F.lit("same"))
    return merge.change_counts(old.withColumn("x", value), new.withColumn("x", value), ["p_partkey"], "x")


@query(f"""SELECT "ID", post_type FROM {POSTS} WHERE post_type NOT IN ('en', 'de')""")
def k11_other_posts(spark: SparkSession, sf: str) -> DataFrame:
    p = roles.posts(spark, sf)
    return tables.persisted(p, "posts", p, {}, ("en", "de")).select("ID", "post_type")


@query(f"""SELECT meta_id, post_id FROM {META} WHERE post_id NOT IN (SELECT "ID" FROM {POSTS} WHERE post_type IN ('en', 'de'))""")
def k10_other_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return tables.persisted(roles.postmeta(spark, sf), "postmeta", roles.posts(spark, sf), {"postmeta": "post_id"}, ("en", "de")).select("meta_id", "post_id")


@query("SELECT doc_id AS id, lang AS post_type FROM documents UNION ALL SELECT 1000000 + c_custkey, 'en' FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def k19_seeded(spark: SparkSession, sf: str) -> DataFrame:
    # Seeds named as posts that are there already under the same type are skipped.
    posts = roles.posts(spark, sf).select(F.col("ID").alias("id"), "post_name", "post_type")
    seeds = roles.table(spark, sf, "customer").select((F.col("c_custkey") + 1000000).alias("id"), F.concat(F.lit("doc-"), F.col("c_custkey")).alias("post_name"), F.lit("en").alias("post_type"))
    return merge.insert_absent(posts, seeds, ["post_name", "post_type"]).select("id", "post_type")


_EFFECT = "CASE WHEN category IN ('created', 'updated_from_file') THEN 'to_store' WHEN category = 'written_from_wordpress' THEN 'to_files' WHEN category = 'deleted_from_file' THEN 'drop_from_store' WHEN category = 'deleted_from_wordpress' THEN 'drop_from_files' END"
_NEXT = "CASE WHEN category IN ('created', 'updated_from_file', 'moved') THEN c WHEN category = 'written_from_wordpress' THEN w WHEN category IN ('conflicts', 'unchanged') THEN b END"
_MANAGED = ("bidirectional", "managed", "none")


@query(f"SELECT resource_id, {_EFFECT} AS effect, {_NEXT} AS next FROM ({classified(*_MANAGED)}) JOIN {STATES} USING (resource_id)")
def r8_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.outcomes(reconcile.classify(roles.states(spark, sf), *_MANAGED)).select("resource_id", "effect", "next")


_ONE_WAY = ("canonical_to_wordpress", "managed", "prefer_canonical")


@query(f"SELECT resource_id, {_NEXT} AS digest FROM ({classified(*_ONE_WAY)}) JOIN {STATES} USING (resource_id) WHERE ({_NEXT}) IS NOT NULL")
def r13_baseline(spark: SparkSession, sf: str) -> DataFrame:
    x = reconcile.outcomes(reconcile.classify(roles.states(spark, sf), *_ONE_WAY))
    return x.where("next IS NOT NULL").select("resource_id", F.col("next").alias("digest"))


@query(f"SELECT resource_id, CASE category WHEN 'conflicts' THEN 'conflicts' ELSE 'unchanged' END AS category FROM ({classified(*_MANAGED)}) JOIN {STATES} USING (resource_id) WHERE category NOT LIKE 'deleted%' AND (c IS NOT NULL OR w IS NOT NULL)")
def r6_settled(spark: SparkSession, sf: str) -> DataFrame:
    # What was applied is settled: a second plan finds nothing but the conflicts of the first.
    after = reconcile.applied(reconcile.classify(reconcile.validated(roles.states(spark, sf), "resource_id"), *_MANAGED))
    return reconcile.classify(after, *_MANAGED).select("resource_id", "category")


@query(
    f"""SELECT doc_id AS id, sha256('{{"comment_status":"open","menu_order":0,"ping_status":"open","pinged":"","post_author":0,"post_content":' || to_json(text) || ',"post_content_filtered":"","post_date":"0000-00-00 00:00:00","post_date_gmt":"0000-00-00 00:00:00","post_excerpt":"","post_mime_type":"","post_name":"doc-' || doc_id
  || '","post_parent":' || {_PARENT} || ',"post_password":"","post_status":"publish","post_title":"Title ' || doc_id || '","post_type":"' || lang || '","to_ping":""}}' || chr(31) || CASE WHEN toxic IS NULL THEN '{{}}' ELSE '{{"toxic":"' || toxic || '"}}' END || chr(31) || '{{}}') AS digest FROM documents LEFT JOIN labels USING (doc_id)"""
)
def r2_receipt_digests(spark: SparkSession, sf: str) -> DataFrame:
    return documents.with_details(_posts(spark, sf), roles.postmeta(spark, sf)).select(F.col("ID").alias("id"), documents.receipt().alias("digest"))


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOURS WHERE a.event_type = 'signup'")
def j15_range_join(spark: SparkSession, sf: str) -> DataFrame:
    e = roles.events(spark, sf).select("event_id", "user_id", "ts", "event_type")
    pairs = timed.within(e.where("event_type = 'signup'").drop("event_type"), e.drop("event_type"), "user_id", "ts", 7200)
    return pairs.select(F.col("l_event_id").alias("a"), F.col("r_event_id").alias("b"))


@query("SELECT a.event_id, arg_max(b.event_id, (b.ts, b.event_id)) AS before FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'signup' AND b.ts < a.ts WHERE a.event_type = 'purchase' GROUP BY a.event_id")
def j15_asof_join(spark: SparkSession, sf: str) -> DataFrame:
    e = roles.events(spark, sf).select("event_id", "user_id", "ts", "event_type")
    found = timed.asof(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), "user_id", "ts", "event_id", "before", "event_id")
    return found.where("before IS NOT NULL").select("event_id", "before")
