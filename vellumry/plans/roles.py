"""How the given Parquet tables stand for content entities: posts, metadata, taxonomies, files, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry.session import reachable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts; a tree of four children a node stands for the hierarchy."""
    d = table(spark, sf_dir, "documents")
    parent = F.when(F.col("doc_id") > 0, F.floor((F.col("doc_id") - 1) / 4))
    return d.select(F.col("doc_id").alias("ID"), F.col("text").alias("post_content"), F.col("lang").alias("post_type"), F.col("source").alias("post_author"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("post_name"), parent.alias("post_parent"), F.col("n_chars").alias("file_size"))


def postmeta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels unpivoted; quality gets an internal key."""
    l = table(spark, sf_dir, "labels")
    return l.select("doc_id", F.explode(F.array(F.struct(F.lit("_quality").alias("k"), F.col("quality").alias("v"), (F.col("doc_id") * 2).alias("i")), F.struct(F.lit("toxic").alias("k"), F.col("toxic").alias("v"), (F.col("doc_id") * 2 + 1).alias("i")))).alias("m")).select(F.col("m.i").alias("meta_id"), F.col("doc_id").alias("post_id"), F.col("m.k").alias("meta_key"), F.col("m.v").cast("string").alias("meta_value"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("term_id"), F.lower("n_name").alias("slug"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select((F.col("n_nationkey") + 1000).alias("term_taxonomy_id"), F.col("n_nationkey").alias("term_id"), F.lower("r_name").alias("taxonomy"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id"), (F.col("c_nationkey") + 1000).alias("term_taxonomy_id"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as outbox records; all times follow from ts, so that results don't depend on the clock."""
    e = events(spark, sf_dir)
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "leased").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "diagnostic").otherwise("acked")
    return e.select(
        F.col("event_id").alias("id"), state.alias("state"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("available_at"),
        F.when(state == "leased", F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("leased_until"), F.when(state == "leased", F.concat(F.lit("w"), F.col("user_id") % 5)).alias("worker_token"),
        F.when(state == "leased", F.concat(F.lit("lease-"), F.col("event_id"))).alias("lease_token"), (F.col("event_id") % 4).alias("attempts"), (F.col("event_id") % 2).alias("reclaims"),
        F.when(state == "failed", F.col("event_id") % 3 + 1).otherwise(F.lit(0)).cast("bigint").alias("failures"), F.when(state == "failed", F.col("props")).alias("last_error"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as versions of files: user_id is the id, ts the time of change."""
    return events(spark, sf_dir).select(F.col("user_id").alias("ID"), F.col("ts").alias("mtime"), F.concat(F.lit("post/"), F.col("event_id"), F.lit(".md")).alias("path"), F.col("event_type"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sides of a reconciliation from orders: digests of fields that differ on some keys, and keys missing on some sides."""
    from vellumry.functions.text import resource_key

    o = table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.concat_ws(":", "o_orderstatus", "o_orderpriority")
    c = F.when(k % 11 != 0, F.when(k % 7 == 0, F.concat(d, F.lit("c"))).otherwise(d))
    w = F.when(k % 13 != 0, F.when(k % 5 == 0, F.concat(d, F.lit("w"))).otherwise(d))
    b = F.when(k % 3 != 0, d)
    return o.select(resource_key("post", k).alias("resource_id"), k.alias("k"), F.sha2(c, 256).alias("c"), F.sha2(w, 256).alias("w"), F.sha2(b, 256).alias("b"), (k % 17 == 0).alias("moved"), F.lit("canonical_to_wordpress").alias("move_direction"), (k % 19 == 0).alias("unmanaged"), (k % 2 == 0).alias("proven")).where("c IS NOT NULL OR w IS NOT NULL OR b IS NOT NULL")


#: Statements of a log, {k} standing for the event's id; each with what a reader of the MySQL manual expects of it: operation, table, effect on the transaction,
#: whether it commits what is open, whether the transaction can't be followed past it, whether it takes part in persistence (wp_options being ephemeral), and
#: the ids it pins.
STATEMENTS = [
    ("INSERT INTO wp_posts (ID, post_title) VALUES ({k}, 'x')", "INSERT", "wp_posts", None, 0, 0, 1, '{"id": ["{k}"], "post_title": ["x"]}'),
    ("insert ignore into `wp_options` (option_name) values ('a{k}')", "INSERT", "wp_options", None, 0, 0, 0, '{"option_name": ["a{k}"]}'),
    ("REPLACE INTO wp_postmeta (meta_id) VALUES ({k})", "REPLACE", "wp_postmeta", None, 0, 0, 1, "{}"),
    ("UPDATE wp_posts SET post_title = 'b' WHERE ID = {k}", "UPDATE", "wp_posts", None, 0, 0, 1, '{"id": ["{k}"]}'),
    ("DELETE FROM wp_postmeta WHERE post_id IN (1, {k})", "DELETE", "wp_postmeta", None, 0, 0, 1, '{"post_id": ["1", "{k}"]}'),
    ("DELETE a, b FROM wp_options a, wp_options b WHERE a.x = b.x", "DELETE", None, None, 0, 0, 0, "{}"),
    ("TRUNCATE TABLE wp_term_relationships", "TRUNCATE", "wp_term_relationships", None, 0, 0, 0, "{}"),
    ("CREATE TABLE IF NOT EXISTS wp_extra{k} (id INT)", "CREATE", "wp_extra{k}", None, 0, 0, 1, "{}"),
    ("CREATE UNIQUE INDEX i ON wp_extra{k} (id)", "ALTER", "wp_extra{k}", None, 0, 0, 0, "{}"),
    ("ALTER TABLE wp_extra ADD COLUMN b{k} INT", "ALTER", "wp_extra", None, 0, 0, 1, "{}"),
    ("DROP TABLE IF EXISTS wp_extra{k}", "DROP", "wp_extra{k}", None, 0, 0, 1, "{}"),
    ("DROP INDEX i{k} ON wp_extra;", "ALTER", "wp_extra", None, 0, 0, 1, "{}"),
    ("SELECT * FROM wp_posts WHERE ID = {k}", None, None, None, 0, 0, 0, '{"id": ["{k}"]}'),
    ("START TRANSACTION READ ONLY", None, None, "begin", 0, 0, 0, "{}"),
    ("begin work;", None, None, "begin", 0, 0, 0, "{}"),
    ("COMMIT", None, None, "commit", 0, 0, 0, "{}"),
    ("COMMIT AND CHAIN", None, None, "commit_chain", 0, 0, 0, "{}"),
    ("COMMIT AND NO CHAIN RELEASE", None, None, "commit", 0, 0, 0, "{}"),
    ("ROLLBACK", None, None, "rollback", 0, 0, 0, "{}"),
    ("ROLLBACK\nAND  CHAIN", None, None, "rollback_chain", 0, 0, 0, "{}"),
    ("SAVEPOINT `sp{k}`", None, None, "savepoint", 0, 0, 0, "{}"),
    ("ROLLBACK TO SAVEPOINT sp{k}", None, None, "rollback_to", 0, 0, 0, "{}"),
    ("RELEASE SAVEPOINT sp{k}", None, None, "release_savepoint", 0, 0, 0, "{}"),
    ("SET autocommit = 0", None, None, "autocommit_0", 0, 0, 0, "{}"),
    ("SET @@SESSION.autocommit := 1", None, None, "autocommit_1", 0, 0, 0, "{}"),
    ("CREATE VIEW v{k} AS SELECT 1", None, None, None, 1, 1, 0, "{}"),
    ("LOCK TABLES wp_posts WRITE", None, None, None, 1, 1, 0, "{}"),
    ("CALL f({k})", None, None, None, 0, 1, 0, "{}"),
    ("XA START 'a{k}'", None, None, None, 0, 1, 0, "{}"),
    ("  grant all on x to y", None, None, None, 1, 1, 0, "{}"),
    ("UNLOCK TABLES", None, None, None, 0, 1, 0, "{}"),
    ("UPDATE wp_posts SET a = 1 WHERE ID = {k} OR a = 2", "UPDATE", "wp_posts", None, 0, 0, 1, "{}"),
    ("UPDATE `wp_posts`\n SET a = 'COMMIT; it''s' WHERE EVENT_ID = {k} AND b IN ('x', 'y''z')", "UPDATE", "wp_posts", None, 0, 0, 1, '{"b": ["x", "y\'z"], "event_id": ["{k}"]}'),
    ("INSERT INTO wp_posts (ID) VALUES ({k}), (2)", "INSERT", "wp_posts", None, 0, 0, 1, "{}"),
    ("INSERT INTO wp_posts (ID) VALUES ({k}) ON DUPLICATE KEY UPDATE a = 1", "INSERT", "wp_posts", None, 0, 0, 1, "{}"),
    ("INSERT INTO wp_posts (ID, a) VALUES (NULL, {k})", "INSERT", "wp_posts", None, 0, 0, 1, '{"a": ["{k}"]}'),
    ("ANALYZE TABLE wp_posts", None, None, None, 1, 1, 0, "{}"),
    ("START REPLICA", None, None, None, 1, 1, 0, "{}"),
    ("RENAME TABLE a TO b{k}", None, None, None, 1, 1, 0, "{}"),
    ("ALTER USER u{k} IDENTIFIED BY 'x'", None, None, None, 1, 1, 0, "{}"),
]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, sql): for each event one statement of the list, its id put in."""
    kinds = F.array(*[F.lit(s[0]) for s in STATEMENTS])
    text = F.element_at(kinds, (F.col("event_id") % len(STATEMENTS) + 1).cast("int"))
    return events(spark, sf_dir).select(F.col("event_id").alias("n"), F.replace(text, F.lit("{k}"), F.col("event_id").cast("string")).alias("sql"))


def expected_sql(columns: str) -> str:
    """SQL for columns of (n, operation, table_name, action, commits, unsupported, kept, scope) of statements(), as written down above."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {', '.join(map(lit, s[1:]))})" for k, s in enumerate(STATEMENTS))
    put = lambda c: f"replace({c}, '{{k}}', event_id::VARCHAR) AS {c}"
    inner = f"SELECT event_id AS n, operation, {put('table_name')}, action, commits = 1 AS commits, unsupported = 1 AS unsupported, kept = 1 AS kept, {put('scope')} FROM events JOIN (VALUES {rows}) v(k, operation, table_name, action, commits, unsupported, kept, scope) ON event_id % {len(STATEMENTS)} = k"
    return f"SELECT {columns} FROM ({inner})"
