"""The roles of roles.py as SQL subqueries, for the oracles."""

POSTS = """(SELECT doc_id AS "ID", text AS post_content, lang AS post_type, source AS post_author, 'doc-' || doc_id AS post_name, CASE WHEN doc_id > 0 THEN (doc_id - 1) // 4 END AS post_parent, n_chars AS file_size FROM documents)"""
META = """(SELECT doc_id * 2 AS meta_id, doc_id AS post_id, '_quality' AS meta_key, quality::VARCHAR AS meta_value FROM labels UNION ALL SELECT doc_id * 2 + 1, doc_id, 'toxic', toxic::VARCHAR FROM labels)"""
TERMS = "(SELECT n_nationkey AS term_id, lower(n_name) AS slug FROM nation)"
TAXONOMY = "(SELECT n_nationkey + 1000 AS term_taxonomy_id, n_nationkey AS term_id, lower(r_name) AS taxonomy FROM nation JOIN region ON n_regionkey = r_regionkey)"
RELATIONS = "(SELECT c_custkey AS object_id, c_nationkey + 1000 AS term_taxonomy_id FROM customer)"
FILES = """(SELECT user_id AS "ID", ts AS mtime, 'post/' || event_id || '.md' AS path, event_type FROM events)"""
OUTBOX = """(SELECT event_id AS id, state, ts AS created_at, ts + INTERVAL 1 HOUR AS available_at, CASE WHEN state = 'leased' THEN ts + INTERVAL 2 HOURS END AS leased_until,
  CASE WHEN state = 'leased' THEN 'w' || (user_id % 5) END AS worker_token, CASE WHEN state = 'leased' THEN 'lease-' || event_id END AS lease_token, event_id % 4 AS attempts, event_id % 2 AS reclaims,
  CASE WHEN state = 'failed' THEN event_id % 3 + 1 ELSE 0 END AS failures, CASE WHEN state = 'failed' THEN props END AS last_error
  FROM (SELECT *, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'leased' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'diagnostic' ELSE 'acked' END AS state FROM events))"""
STATES = """(SELECT 'post:' || lpad(o_orderkey::VARCHAR, 20, '0') AS resource_id, o_orderkey AS k,
  CASE WHEN o_orderkey % 11 <> 0 THEN sha256(CASE WHEN o_orderkey % 7 = 0 THEN d || 'c' ELSE d END) END AS c,
  CASE WHEN o_orderkey % 13 <> 0 THEN sha256(CASE WHEN o_orderkey % 5 = 0 THEN d || 'w' ELSE d END) END AS w,
  CASE WHEN o_orderkey % 3 <> 0 THEN sha256(d) END AS b, o_orderkey % 17 = 0 AS moved, o_orderkey % 19 = 0 AS unmanaged, o_orderkey % 2 = 0 AS proven
  FROM (SELECT *, o_orderstatus || ':' || o_orderpriority AS d FROM orders)
  WHERE o_orderkey % 11 <> 0 OR o_orderkey % 13 <> 0 OR o_orderkey % 3 <> 0)"""

#: First classification of a resource; {unmanaged} is what an alike but unmanaged resource becomes.
_BASE = """CASE WHEN c IS NOT DISTINCT FROM w THEN CASE WHEN moved AND c IS NOT NULL THEN 'moved' WHEN unmanaged AND {store} THEN 'written_from_wordpress' ELSE 'unchanged' END
  WHEN b IS NULL THEN CASE WHEN w IS NULL THEN 'created' WHEN c IS NULL THEN 'written_from_wordpress' ELSE 'conflicts' END
  WHEN c IS DISTINCT FROM b AND w IS NOT DISTINCT FROM b THEN CASE WHEN c IS NULL THEN 'deleted_from_file' ELSE 'updated_from_file' END
  WHEN w IS DISTINCT FROM b AND c IS NOT DISTINCT FROM b THEN CASE WHEN w IS NULL THEN 'deleted_from_wordpress' ELSE 'written_from_wordpress' END
  ELSE 'conflicts' END"""


def classified(direction: str = "bidirectional", deletion: str = "preserve", preference: str = "none") -> str:
    """SQL for (resource_id, category) under these policies."""
    store = "TRUE" if direction == "wordpress_to_canonical" else "FALSE"
    barred = {"bidirectional": "FALSE", "canonical_to_wordpress": "cat IN ('written_from_wordpress', 'deleted_from_wordpress')", "wordpress_to_canonical": "cat IN ('created', 'updated_from_file', 'deleted_from_file', 'moved')"}[direction]
    unproven = "cat IN ('deleted_from_file', 'deleted_from_wordpress')" + (" AND NOT proven" if deletion == "managed" else "")
    last = "cat"
    if preference == "prefer_canonical" and direction != "wordpress_to_canonical":
        last = "CASE WHEN cat = 'conflicts' AND c IS NOT NULL THEN 'updated_from_file' ELSE cat END"
    if preference == "prefer_wordpress" and direction != "canonical_to_wordpress":
        last = "CASE WHEN cat = 'conflicts' AND w IS NOT NULL THEN 'written_from_wordpress' ELSE cat END"
    return f"""SELECT resource_id, {last} AS category FROM (SELECT *  REPLACE (CASE WHEN {unproven} THEN 'conflicts' ELSE cat END AS cat) FROM
      (SELECT * REPLACE (CASE WHEN {barred} THEN 'conflicts' ELSE cat END AS cat) FROM (SELECT *, {_BASE.format(store=store)} AS cat FROM {STATES})))"""
