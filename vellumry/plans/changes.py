"""Queries about change: SQL statements, reconciliation, the outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry.operators import mutations, outbox, reconcile
from vellumry.plans import roles
from vellumry.plans.registry import query
from vellumry.plans.roles_sql import META, OUTBOX, RELATIONS, STATES, classified

_NOW = "TIMESTAMP '2024-01-05 00:00:00'"


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(roles.expected_sql("n, operation, table_name"))
def m1_classified(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("sql")
    return roles.statements(spark, sf).select("n", mutations.operation(s).alias("operation"), mutations.table_of(s).alias("table_name"))


@query(roles.expected_sql("n, action, CASE WHEN action IN ('savepoint', 'rollback_to', 'release_savepoint') THEN 'sp' || n END AS savepoint"))
def m2_transaction_control(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("sql")
    return roles.statements(spark, sf).select("n", mutations.control(s).alias("action"), mutations.savepoint(s).alias("savepoint"))


@query(roles.expected_sql("n, commits, unsupported"))
def m3_unsupported(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("sql")
    return roles.statements(spark, sf).select("n", mutations.implicit_commit(s).alias("commits"), mutations.unsupported_boundary(s).alias("unsupported"))


@query(roles.expected_sql("n % 150 AS session, n AS seq, 'diagnostic' AS state, CASE WHEN commits THEN 'implicit_commit' ELSE 'opaque_boundary' END AS reason") + " WHERE unsupported")
def e9_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    log = roles.statements(spark, sf).select((F.col("n") % 150).alias("session"), F.col("n").alias("seq"), "sql")
    return mutations.diagnostics(log).drop("statement")


@query(roles.expected_sql("n") + " WHERE kept")
def m4_runtime_kept(spark: SparkSession, sf: str) -> DataFrame:
    return roles.statements(spark, sf).where(mutations.runtime_kept(F.col("sql"), ("wp_options",))).select("n")


@query(roles.expected_sql("n, scope"))
def m5_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return roles.statements(spark, sf).select("n", mutations.scope_json(F.col("sql")).alias("scope"))


@query("SELECT event_id AS n, 'wp_' || (event_id % 7) || ',wp_b' AS tables FROM events")
def j14_deleted_tables(spark: SparkSession, sf: str) -> DataFrame:
    e = roles.events(spark, sf)
    text = F.format_string("DELETE x, `y`\nFROM wp_%d AS x, wp_b y WHERE x.id = y.id AND x.v = %d", F.col("event_id") % 7, "event_id")
    return e.select(F.col("event_id").alias("n"), F.array_join(mutations.deleted_tables_of(text), ",").alias("tables"))


_CHANGES = "(SELECT CASE o_orderkey % 3 WHEN 0 THEN 'posts' WHEN 1 THEN 'postmeta' ELSE 'term_relationships' END AS suffix, CASE WHEN o_orderkey % 3 = 2 THEN 1000 + o_orderkey % 5 ELSE o_orderkey % 400 END AS row_id FROM orders)"


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    suffix = F.when(k % 3 == 0, "posts").when(k % 3 == 1, "postmeta").otherwise("term_relationships")
    return roles.table(spark, sf, "orders").select(suffix.alias("suffix"), F.when(k % 3 == 2, 1000 + k % 5).otherwise(k % 400).alias("row_id"))


@query(f"SELECT row_id AS post_id FROM {_CHANGES} WHERE suffix = 'posts' UNION SELECT post_id FROM {META} WHERE meta_id IN (SELECT row_id FROM {_CHANGES} WHERE suffix = 'postmeta') UNION SELECT object_id FROM {RELATIONS} WHERE term_taxonomy_id IN (SELECT row_id FROM {_CHANGES} WHERE suffix = 'term_relationships')")
def m6_affected_posts(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.affected_posts(_changes(spark, sf).distinct(), roles.postmeta(spark, sf), roles.relations(spark, sf))


@query(f"SELECT suffix, CASE suffix WHEN 'posts' THEN 'post' WHEN 'postmeta' THEN 'owner_post' ELSE 'object_post' END AS route, count(*) AS n FROM {_CHANGES} GROUP BY ALL")
def m7_routes(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).groupBy("suffix", mutations.routed(F.col("suffix")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT suffix, row_id FROM {_CHANGES}")
def m8_coalesced(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).dropDuplicates(["suffix", "row_id"])


@query(classified())
def r4_classified(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.classify(roles.states(spark, sf)).select("resource_id", "category")


@query(classified("canonical_to_wordpress", "managed", "prefer_canonical"))
def r4_one_way_managed(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.classify(roles.states(spark, sf), "canonical_to_wordpress", "managed", "prefer_canonical").select("resource_id", "category")


@query(classified("wordpress_to_canonical", "managed", "prefer_wordpress"))
def r4_other_way(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.classify(roles.states(spark, sf), "wordpress_to_canonical", "managed", "prefer_wordpress").select("resource_id", "category")


@query(f"SELECT category, count(x.resource_id) AS n FROM (VALUES {', '.join(f'({_quoted(c)})' for c in reconcile.CATEGORIES)}) v(category) LEFT JOIN ({classified()}) x USING (category) GROUP BY 1")
def a5_category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.category_counts(reconcile.classify(roles.states(spark, sf)))


@query(f"SELECT resource_id, category FROM ({classified()}) ORDER BY coalesce('post/' || right(resource_id, 4), ''), resource_id")
def t5_entry_order(spark: SparkSession, sf: str) -> DataFrame:
    e = reconcile.classify(roles.states(spark, sf)).select("resource_id", "category")
    return e.orderBy(F.coalesce(F.concat(F.lit("post/"), F.right("resource_id", F.lit(4))), F.lit("")), "resource_id")


@query(f"SELECT resource_id, is_delete, depth FROM (SELECT resource_id, c IS NULL OR w IS NULL AS is_delete, k % 5 AS depth FROM {STATES}) ORDER BY is_delete, CASE WHEN is_delete THEN -depth ELSE depth END, resource_id")
def t6_apply_order(spark: SparkSession, sf: str) -> DataFrame:
    e = roles.states(spark, sf).select("resource_id", (F.col("c").isNull() | F.col("w").isNull()).alias("is_delete"), (F.col("k") % 5).alias("depth"))
    return reconcile.apply_order(e)


@query("SELECT doc_id, CASE WHEN doc_id > 0 THEN (doc_id - 1) // 4 END AS parent FROM documents ORDER BY parent NULLS FIRST, doc_id")
def t7_import_order(spark: SparkSession, sf: str) -> DataFrame:
    return roles.posts(spark, sf).select(F.col("ID").alias("doc_id"), F.col("post_parent").alias("parent")).orderBy(F.asc_nulls_first("parent"), "doc_id")


_ELIGIBLE = f"((state IN ('pending', 'failed') AND available_at <= {_NOW}) OR (state = 'leased' AND leased_until <= {_NOW}))"


@query(f"SELECT id, state FROM {OUTBOX} WHERE {_ELIGIBLE} ORDER BY id LIMIT 50")
def t8_claimable(spark: SparkSession, sf: str) -> DataFrame:
    return outbox.claimable(roles.outbox(spark, sf), _now(), 50).select("id", "state")


@query(f"""WITH o AS (SELECT * FROM {OUTBOX}), m AS (SELECT id FROM o WHERE {_ELIGIBLE} ORDER BY id LIMIT 50)
  SELECT o.id, CASE WHEN m.id IS NOT NULL THEN 'leased' ELSE state END AS state, attempts + (m.id IS NOT NULL)::INT AS attempts, reclaims + (m.id IS NOT NULL AND state = 'leased')::INT AS reclaims,
  CASE WHEN m.id IS NOT NULL THEN 'me' ELSE worker_token END AS worker_token FROM o LEFT JOIN m ON m.id = o.id""")
def e1_claim(spark: SparkSession, sf: str) -> DataFrame:
    return outbox.claim(roles.outbox(spark, sf), _now(), "me", "lease", 50, 300).select("id", "state", "attempts", "reclaims", "worker_token")


@query("""SELECT user_id AS session, event_id AS event FROM (SELECT *, max_by(event_type, event_id) FILTER (event_type IN ('signup', 'error', 'purchase')) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  min_by(event_type, event_id) FILTER (event_type IN ('signup', 'error', 'purchase')) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events)
  WHERE event_type IN ('view', 'click') AND (before IS DISTINCT FROM 'signup' OR after IN ('signup', 'purchase'))""")
def e2_committed(spark: SparkSession, sf: str) -> DataFrame:
    e, t = roles.events(spark, sf), F.col("event_type")
    action = F.when(t == "signup", "begin").when(t == "error", "rollback").when(t == "purchase", "commit").otherwise("event")
    return outbox.committed(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), action.alias("action"), F.lit(None).cast("string").alias("savepoint"), F.col("event_id").alias("event")))


#: A session's steps for each event, by its id modulo 7: B begins, E adds an event of that number, S, T and L set, roll back to and release a savepoint, C commits,
#: CC commits and goes on, R rolls back, A0 and A1 switch autocommit; and the numbers that stay, worked out by hand.
_SCRIPTS = [
    ("B E1 Sa E2 Sb E3 Ta E4 C", (1, 4)),
    ("B E1 Sa E2 Sb E3 Tb E4 C", (1, 2, 4)),
    ("B E1 Sa E2 La E3 Ta E4 C", (1, 2, 3, 4)),
    ("B E1 Sa E2 Sb E3 Ta Tb E4 R", ()),
    ("E1 B E2 Sa E3 Ta E4 CC E5 R", (1, 2, 4)),
    ("A0 E1 Sa E2 Sa E3 Ta E4 A1", (1, 2, 4)),
    ("B E1 B E2 R", (1,)),
]
_STEPS = {"B": "begin", "C": "commit", "CC": "commit_chain", "R": "rollback", "A0": "autocommit_0", "A1": "autocommit_1", "E": "event", "S": "savepoint", "T": "rollback_to", "L": "release_savepoint"}


@query("SELECT user_id AS session, event_id * 10 + i AS event FROM events JOIN (VALUES " + ", ".join(f"({k}, {i})" for k, (_, kept) in enumerate(_SCRIPTS) for i in kept) + f") v(k, i) ON event_id % {len(_SCRIPTS)} = k")
def w6_savepoints(spark: SparkSession, sf: str) -> DataFrame:
    step = lambda t: (_STEPS.get(t) or _STEPS[t[0]], t[1:] if t[0] in "STL" else None, int(t[1:]) if t[0] == "E" else None)
    script = lambda text: F.array(*[F.struct(F.lit(a).alias("action"), F.lit(p).cast("string").alias("savepoint"), F.lit(n).cast("long").alias("n")) for a, p, n in map(step, text.split())])
    scripts = F.array(*[script(text) for text, _ in _SCRIPTS])
    e = roles.events(spark, sf).select("user_id", "event_id", F.posexplode(F.element_at(scripts, (F.col("event_id") % len(_SCRIPTS) + 1).cast("int"))).alias("at", "s"))
    log = e.select(F.col("user_id").alias("session"), (F.col("event_id") * 20 + F.col("at")).alias("seq"), "s.action", "s.savepoint", (F.col("event_id") * 10 + F.col("s.n")).alias("event"))
    return outbox.committed(log)


@query("SELECT DISTINCT 'e' || (event_id // 2) AS event_id, 'a,b' AS tables FROM events")
def e3_normalized(spark: SparkSession, sf: str) -> DataFrame:
    e = roles.events(spark, sf).select(F.concat(F.lit("e"), F.floor(F.col("event_id") / 2)).alias("event_id"), F.array(F.lit("b"), F.lit("a"), F.lit("b")).alias("tables"))
    return outbox.normalized(e).select("event_id", F.array_join("tables", ",").alias("tables"))


@query(f"SELECT id FROM {OUTBOX} WHERE state = 'leased' AND leased_until <= {_NOW}")
def e4_expired_leases(spark: SparkSession, sf: str) -> DataFrame:
    return roles.outbox(spark, sf).where((F.col("state") == "leased") & outbox.eligible(_now())).select("id")


@query("SELECT user_id AS resource, max(event_id) AS fence, count(*) - 1 AS stale FROM events GROUP BY 1")
def e5_fences(spark: SparkSession, sf: str) -> DataFrame:
    return outbox.fenced(roles.events(spark, sf).select(F.col("user_id").alias("resource"), F.col("event_id").alias("fence")))


@query(f"""SELECT count_if(state = 'pending')::BIGINT AS pending, count_if(state = 'leased')::BIGINT AS leased, count_if(state = 'failed')::BIGINT AS failed, count_if(state = 'diagnostic')::BIGINT AS unsupported_boundaries,
  coalesce(sum(attempts), 0)::BIGINT AS attempts, coalesce(sum(reclaims), 0)::BIGINT AS reclaims, coalesce(sum(failures), 0)::BIGINT AS failures, coalesce(max(date_sub('second', created_at, {_NOW})), 0) AS oldest_age FROM {OUTBOX} WHERE state <> 'acked'""")
def a2_outbox_counters(spark: SparkSession, sf: str) -> DataFrame:
    return outbox.counters(roles.outbox(spark, sf), _now())
