"""Queries that relate rows: joins, aggregates, ranks, set operations, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry.functions import text as fx
from vellumry.operators import content, dedup, hierarchy, merge, reconcile, search
from vellumry.plans import roles
from vellumry.plans.registry import query
from vellumry.plans.roles_sql import FILES, META, POSTS, RELATIONS, TAXONOMY, TERMS

_TERMS_OF = f"(SELECT object_id, taxonomy, slug FROM {RELATIONS} r JOIN {TAXONOMY} t USING (term_taxonomy_id) JOIN {TERMS} s USING (term_id))"


def _terms_of(spark: SparkSession, sf: str) -> DataFrame:
    return content.post_terms(roles.relations(spark, sf), roles.taxonomy(spark, sf), roles.terms(spark, sf))


@query(f"SELECT * FROM {_TERMS_OF}")
def j1_post_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _terms_of(spark, sf)


@query(f"SELECT taxonomy || '::' || slug AS term_key, term_taxonomy_id FROM {TAXONOMY} JOIN {TERMS} USING (term_id)")
def j2_term_map(spark: SparkSession, sf: str) -> DataFrame:
    return content.term_map(roles.taxonomy(spark, sf), roles.terms(spark, sf))


@query(f"SELECT object_id, t.term_taxonomy_id FROM (SELECT * REPLACE (CASE WHEN object_id % 7 = 0 THEN 'unknown' ELSE slug END AS slug) FROM {_TERMS_OF}) x JOIN {TERMS} s USING (slug) JOIN {TAXONOMY} t ON t.term_id = s.term_id AND t.taxonomy = x.taxonomy")
def j3_matched_slugs(spark: SparkSession, sf: str) -> DataFrame:
    slugs = _terms_of(spark, sf).withColumn("slug", F.when(F.col("object_id") % 7 == 0, "unknown").otherwise(F.col("slug")))
    return content.matched_terms(slugs, content.term_map(roles.taxonomy(spark, sf), roles.terms(spark, sf)))


@query(f"""SELECT post_id, meta_key, meta_value FROM {META} WHERE post_id IN (SELECT "ID" FROM {POSTS} WHERE post_type = 'de')""")
def j4_meta_of_slice(spark: SparkSession, sf: str) -> DataFrame:
    gone = roles.posts(spark, sf).where("post_type = 'de'").select(F.col("ID").alias("post_id"))
    return roles.postmeta(spark, sf).join(gone, "post_id", "left_semi").select("post_id", "meta_key", "meta_value")


@query(f"""SELECT post_id, meta_key, meta_value FROM {META} WHERE post_id NOT IN (SELECT "ID" FROM {POSTS} WHERE post_type IN ('en', 'fr'))""")
def j5_meta_without_owned(spark: SparkSession, sf: str) -> DataFrame:
    owned = roles.posts(spark, sf).where(F.col("post_type").isin("en", "fr"))
    return merge.without_owned(roles.postmeta(spark, sf), "post_id", owned).select("post_id", "meta_key", "meta_value")


@query("SELECT doc_id AS \"ID\", CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE text END AS post_content FROM documents")
def j6_lazy_content(spark: SparkSession, sf: str) -> DataFrame:
    p = roles.posts(spark, sf)
    rows = p.select("ID", F.when(F.col("ID") % 2 == 0, "kept").otherwise("").alias("post_content"))
    return search.with_content(rows, p)


@query("""SELECT path, CASE WHEN s IS NULL THEN 'new' WHEN t IS NULL THEN 'deleted' WHEN s = t THEN 'unchanged' ELSE 'changed' END AS status FROM
  (SELECT 'o/' || o_orderkey AS path, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 97 END AS s, CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 1000 ELSE o_orderkey % 97 END END AS t FROM orders) WHERE s IS NOT NULL OR t IS NOT NULL""")
def j7_manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = roles.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    path, size = F.concat(F.lit("o/"), k).alias("path"), k % 97
    seen = o.where(k % 5 != 0).select(path, F.lit(1).alias("mtime"), size.alias("size"))
    listed = o.where(k % 7 != 0).select(path, F.lit(1).alias("mtime"), F.when(k % 3 == 0, F.lit(1000)).otherwise(size).alias("size"))
    return reconcile.manifest_diff(seen, listed)


@query("""SELECT 'o/' || o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS c, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS w, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS b
  FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0""")
def j8_three_sides(spark: SparkSession, sf: str) -> DataFrame:
    o = roles.table(spark, sf, "orders").withColumn("key", F.concat(F.lit("o/"), "o_orderkey"))
    side = lambda n, c: o.where(F.col("o_orderkey") % n == 0).select("key", F.col(c).alias("digest"))
    return reconcile.three_way(side(2, "o_orderstatus"), side(3, "o_orderpriority"), side(5, "o_orderstatus"), "key")


@query(f"""SELECT o_orderkey, coalesce(a."ID", b."ID") AS matched FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'doc-' || (o_orderkey % 700) END AS slug, o_orderkey % 900 AS other FROM orders) o
  LEFT JOIN (SELECT post_name, min("ID") AS "ID" FROM {POSTS} GROUP BY 1 HAVING count(*) = 1) a ON a.post_name = o.slug LEFT JOIN (SELECT "ID" FROM {POSTS} GROUP BY 1 HAVING count(*) = 1) b ON b."ID" = o.other""")
def j9_priority_match(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = roles.table(spark, sf, "orders").select(k, F.when(k % 3 == 0, F.concat(F.lit("doc-"), k % 700)).alias("slug"), (k % 900).alias("other"))
    return reconcile.priority_match(rows, roles.posts(spark, sf), [("slug", "post_name"), ("other", "ID")], "ID").select("o_orderkey", "matched")


@query("""SELECT doc_id AS "ID", CASE WHEN doc_id % 4 <> 0 THEN doc_id - doc_id % 4 END AS parent FROM documents""")
def j10_parents_from_paths(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("ID")
    path = F.when(i % 4 == 0, F.concat(F.lit("wiki/p"), i, F.lit("/index.md"))).otherwise(F.concat(F.lit("wiki/p"), i - i % 4, F.lit("/c"), i, F.lit(".md")))
    return hierarchy.parents_of_paths(roles.posts(spark, sf).select("ID", path.alias("path")))


_TREE = f'(SELECT "ID", post_parent AS p FROM {POSTS})'
_UP = f"""WITH RECURSIVE up(i, a, d) AS (SELECT "ID", p, 1 FROM {_TREE} WHERE p IS NOT NULL UNION ALL SELECT u.i, t.p, u.d + 1 FROM up u JOIN {_TREE} t ON t."ID" = u.a WHERE t.p IS NOT NULL)"""


@query(f'{_UP} SELECT i AS "ID", a AS ancestor, d AS distance FROM up')
def j11_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.ancestors(roles.posts(spark, sf))


@query(f"""WITH RECURSIVE t(i, depth) AS (SELECT "ID", 1 FROM {_TREE} WHERE p = 2 UNION ALL SELECT c."ID", t.depth + 1 FROM {_TREE} c JOIN t ON c.p = t.i) SELECT i AS "ID", depth FROM t""")
def j12_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(roles.posts(spark, sf), 2)


@query(f"""{_UP} SELECT i AS "ID", a AS ancestor, d AS distance FROM up WHERE i IN (17, 99, 150)""")
def j13_ancestors_of_scope(spark: SparkSession, sf: str) -> DataFrame:
    p = roles.posts(spark, sf)
    return hierarchy.ancestors(p, p.where(F.col("ID").isin(17, 99, 150)))


@query(f"""{_UP} SELECT p."ID", coalesce(count(a), 0)::BIGINT AS depth FROM {_TREE} p LEFT JOIN up ON up.i = p."ID" GROUP BY 1""")
def w7_depths(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.with_depth(roles.posts(spark, sf).select("ID", "post_parent")).select("ID", "depth")


@query(f"""WITH RECURSIVE t(i, path) AS (SELECT doc_id, 'doc-' || doc_id FROM documents WHERE doc_id = 0 UNION ALL SELECT c."ID", t.path || '/doc-' || c."ID" FROM {_TREE} c JOIN t ON c.p = t.i)
  SELECT i AS "ID", path || CASE WHEN i IN (SELECT p FROM {_TREE}) THEN '/index.md' ELSE '.md' END AS path FROM t""")
def r7_expected_paths(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.expected_paths(roles.posts(spark, sf).select("ID", "post_parent", "post_name"), "post_name")


@query("SELECT greatest(coalesce(max(doc_id), 0) + 1, 50)::BIGINT AS next_id FROM documents")
def a1_next_id(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.next_id(roles.posts(spark, sf), "ID", 50).select(F.col("next_id").cast("bigint"))


@query(f"SELECT post_id, meta_key, string_agg(meta_value, ',' ORDER BY meta_id) AS given FROM {META} GROUP BY 1, 2")
def a3_grouped_meta(spark: SparkSession, sf: str) -> DataFrame:
    return content.grouped_meta(roles.postmeta(spark, sf)).select("post_id", "meta_key", F.array_join("values", ",").alias("given"))


@query(f"SELECT object_id, taxonomy, string_agg(DISTINCT slug, ',' ORDER BY slug) AS slugs FROM {_TERMS_OF} GROUP BY 1, 2")
def a4_grouped_terms(spark: SparkSession, sf: str) -> DataFrame:
    return content.grouped_terms(_terms_of(spark, sf)).select("object_id", "taxonomy", F.array_join("slugs", ",").alias("slugs"))


@query(f"SELECT object_id, taxonomy, string_agg(slug, ',' ORDER BY slug) AS slugs FROM (SELECT * FROM {_TERMS_OF} UNION ALL SELECT * FROM {_TERMS_OF}) GROUP BY 1, 2")
def a4_repeated_terms(spark: SparkSession, sf: str) -> DataFrame:
    t = _terms_of(spark, sf)
    return content.grouped_terms(t.unionByName(t), distinct=False).select("object_id", "taxonomy", F.array_join("slugs", ",").alias("slugs"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def a6_report_sample(spark: SparkSession, sf: str) -> DataFrame:
    return roles.table(spark, sf, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(10)


@query("SELECT coalesce(max(doc_id), 0) AS cursor FROM documents")
def a7_cursor(spark: SparkSession, sf: str) -> DataFrame:
    return roles.posts(spark, sf).agg(F.coalesce(F.max("ID"), F.lit(0)).alias("cursor"))


@query("SELECT count_if(c_custkey % 3 <> 0 AND c_custkey % 4 <> 0)::BIGINT AS both_sides, count_if(c_custkey % 3 <> 0 AND c_custkey % 4 = 0)::BIGINT AS missing_files, count_if(c_custkey % 3 = 0 AND c_custkey % 4 <> 0)::BIGINT AS orphan_files FROM customer")
def a8_audit(spark: SparkSession, sf: str) -> DataFrame:
    c = roles.table(spark, sf, "customer")
    return content.audit(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 4 <> 0"), "c_custkey")


@query("SELECT count(*) AS n, bit_xor(('0x' || left(sha256(doc_id || chr(31) || text), 15))::BIGINT) AS digest FROM documents")
def a9_store_digest(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.store_digest(roles.table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))


@query(f"""SELECT "ID", path FROM {FILES} QUALIFY row_number() OVER (PARTITION BY "ID" ORDER BY mtime DESC, path) = 1""")
def w1_newest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.newest_wins(roles.files(spark, sf), "ID", "mtime", "path").select("ID", "path")


@query(f"""SELECT "ID", path FROM {FILES} QUALIFY row_number() OVER (PARTITION BY "ID" ORDER BY event_type = 'signup' DESC, mtime DESC, path) = 1""")
def w2_claimed_wins(spark: SparkSession, sf: str) -> DataFrame:
    f = roles.files(spark, sf).withColumn("claimed", F.col("event_type") == "signup")
    return dedup.newest_wins(f, "ID", "mtime", "path", "claimed").select("ID", "path")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def w3_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.first_wins(roles.events(spark, sf), ["user_id"], "event_id").select("user_id", "event_id")


@query("SELECT url, page_id, 100 + row_number() OVER (ORDER BY url, page_id) AS \"ID\" FROM pages")
def w4_assigned_ids(spark: SparkSession, sf: str) -> DataFrame:
    pages = roles.table(spark, sf, "pages").select("url", "page_id", F.struct("url", "page_id").alias("o"))
    return dedup.assigned_ids(pages, 100, "o").select("url", "page_id", "ID")


@query("SELECT user_id, props AS latest FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w5_latest_failure(spark: SparkSession, sf: str) -> DataFrame:
    e = roles.events(spark, sf).where("event_type = 'error'")
    return e.groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("latest"))


_OLD, _NEW = "(SELECT p_partkey, p_name, 'old' AS v FROM part WHERE p_partkey % 3 <> 0)", "(SELECT p_partkey, p_name, 'new' AS v FROM part WHERE p_partkey % 2 = 0)"


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = roles.table(spark, sf, "part")
    return tuple(p.where(w).select("p_partkey", "p_name", F.lit(v).alias("v")) for w, v in (("p_partkey % 3 <> 0", "old"), ("p_partkey % 2 = 0", "new")))


@query(f"SELECT * FROM {_NEW} UNION ALL SELECT * FROM {_OLD} o WHERE NOT EXISTS (SELECT 1 FROM {_NEW} n WHERE n.p_partkey = o.p_partkey)")
def u1_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return merge.upsert(*_versions(spark, sf), ["p_partkey"])


@query(f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW} o WHERE NOT EXISTS (SELECT 1 FROM {_OLD} n WHERE n.p_partkey = o.p_partkey)")
def u2_insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    return merge.insert_absent(*_versions(spark, sf), ["p_partkey"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def u3_idempotent_insert(spark: SparkSession, sf: str) -> DataFrame:
    e = roles.events(spark, sf).select("user_id", "event_type")
    return e.unionByName(e).dropDuplicates(["user_id", "event_type"])


@query(f"SELECT * FROM {_OLD} WHERE p_partkey % 10 <> 4 UNION ALL SELECT * FROM {_NEW} WHERE p_partkey % 10 = 4")
def u4_replaced_slice(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    return merge.replace_slice(old, new.where("p_partkey % 10 = 4"), F.col("p_partkey") % 10 == 4)


@query(f"SELECT p_partkey FROM {_OLD} EXCEPT SELECT p_partkey FROM {_NEW}")
def u5_key_difference(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    return old.join(new.select("p_partkey").distinct(), "p_partkey", "left_anti").select("p_partkey").distinct()


@query(f"SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'created' WHEN n.p_partkey IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM {_OLD} o FULL JOIN {_NEW} n USING (p_partkey)")
def u6_key_changes(spark: SparkSession, sf: str) -> DataFrame:
    return merge.key_changes(*_versions(spark, sf), ["p_partkey"], "v")


@query(f"""{_UP} SELECT p."ID", d.depth FROM {_TREE} p JOIN (SELECT i, max(d) AS depth FROM up WHERE i IN (SELECT i FROM up WHERE a = 1) GROUP BY 1) d ON d.i = p."ID" WHERE p."ID" >= 20 ORDER BY depth, 1 LIMIT 50""")
def k18_recovered(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.recoverable(roles.posts(spark, sf).select("ID", "post_parent"), root=1, least=20, limit=50)


@query(f"""SELECT "ID", sha256(concat_ws(chr(31), "ID"::VARCHAR, post_type, post_name, coalesce(post_parent::VARCHAR, chr(0)))) AS digest FROM {POSTS}""")
def r1_identities(spark: SparkSession, sf: str) -> DataFrame:
    return roles.posts(spark, sf).select("ID", fx.identity(F.col("ID"), F.col("post_type"), F.col("post_name"), F.col("post_parent")).alias("digest"))


@query(f"""SELECT p."ID", p.post_name, p.post_type, string_agg(m.meta_key || '=' || m.meta_value, ';' ORDER BY m.meta_key, m.meta_value) AS meta FROM {POSTS} p LEFT JOIN (SELECT * FROM {META} WHERE meta_key <> '_quality') m ON m.post_id = p."ID" GROUP BY ALL""")
def r2_receipts(spark: SparkSession, sf: str) -> DataFrame:
    return content.receipts(roles.posts(spark, sf).select("ID", "post_name", "post_type"), content.public_meta(roles.postmeta(spark, sf)))
