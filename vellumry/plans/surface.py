"""The SQL surface that content stores offer over any table: joins of all kinds, grouping sets, windows, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vellumry.plans import roles
from vellumry.plans.registry import query
from vellumry.session import sql_over

#: name -> (tables, Spark SQL, DuckDB SQL if it differs)
STATEMENTS: dict[str, tuple[str, str, str | None]] = {
    "j15_left_join": ("customer orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'", None),
    "j15_right_join": ("customer orders", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey", None),
    "j15_full_join": ("supplier customer", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey", None),
    "j15_semi_join": ("customer orders", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "j15_anti_join": ("customer orders", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "j15_cross_join": ("region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "j15_theta_join": ("supplier nation", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > 0", None),
    "a10_having": ("lineitem", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 3", None),
    "a10_distinct": ("lineitem", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem", None),
    "a10_rollup": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "a10_cube": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "a10_grouping_sets": ("documents", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())", None),
    "a10_pricing": (
        "lineitem",
        "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
        None,
    ),
    "a10_conditional": ("lineitem", "SELECT count(*) FILTER (WHERE l_discount > 0.05) AS discounted, max(l_shipdate) AS latest, min(l_quantity) AS least FROM lineitem", None),
    "w8_ranks": ("customer", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS d, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS q FROM customer", None),
    "w8_neighbours": ("events", "SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id, 2) OVER w AS ahead, first_value(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "w8_frames": ("events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS running FROM events", None),
    "w8_top_per_group": ("orders", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2", None),
    "w8_sessions": ("events", "SELECT user_id, event_id, CAST(sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS AS gap FROM events)", None),
    "u7_union": ("supplier customer", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer", None),
    "u7_union_all": ("supplier customer", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer", None),
    "u7_intersect": ("orders customer", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0", None),
    "u7_except": ("orders customer", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    "u7_except_all": ("lineitem", "SELECT l_returnflag AS f, l_linestatus AS s FROM lineitem EXCEPT ALL SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber > 1", None),
    "f22_math": ("lineitem", "SELECT l_orderkey, l_linenumber, abs(l_linenumber - 4) AS a, CAST(floor(l_quantity / 7) AS BIGINT) AS f, CAST(ceil(l_quantity / 7) AS BIGINT) AS c, l_linenumber % 3 AS m, greatest(l_linenumber, 3) AS g FROM lineitem", None),
    "f22_strings": ("part", "SELECT p_partkey, upper(p_name) AS u, substr(p_name, 2, 4) AS s, replace(p_type, ' ', '_') AS r, CAST(length(p_name) AS BIGINT) AS n, concat(p_brand, '/', p_type) AS c, reverse(p_brand) AS v, lpad(p_brand, 12, '.') AS p FROM part", None),
    "f22_json": ("events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events"),
    "f22_arrays": ("embeddings", "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, element_at(embedding, 1) AS e FROM embeddings", "SELECT vec_id, len(embedding) AS n, embedding[1] AS e FROM embeddings"),
    "f22_statistics": ("lineitem", "SELECT l_returnflag, round(stddev(l_quantity), 4) AS s, round(avg(l_quantity), 4) AS a, round(corr(l_quantity, l_extendedprice), 4) AS r, percentile(l_linenumber, 0.5) AS med FROM lineitem GROUP BY 1", "SELECT l_returnflag, round(stddev(l_quantity), 4) AS s, round(avg(l_quantity), 4) AS a, round(corr(l_quantity, l_extendedprice), 4) AS r, quantile_cont(l_linenumber, 0.5) AS med FROM lineitem GROUP BY 1"),
    "l1_scalar_subquery": ("customer", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)", None),
    "l1_correlated": ("customer orders", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer", None),
    "l1_cte": ("orders", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM big GROUP BY n", None),
    "l1_shipping": ("customer orders lineitem", "SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10", None),
    "l1_nations": ("customer orders lineitem supplier nation region", "SELECT n_name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name", None),
    "l1_conversations": ("conversations", "SELECT conv_id, count(*) AS turns, CAST(max(length(text)) AS BIGINT) AS longest, max_by(role, turn) AS last_role FROM conversations GROUP BY conv_id", None),
}


def _registered(name: str, tables: str, statement: str, other: str | None) -> None:
    def run(spark: SparkSession, sf: str):
        return sql_over(statement, {t: roles.table(spark, sf, t) for t in tables.split()})

    run.__name__ = name
    query(other or statement)(run)


for _name, _parts in STATEMENTS.items():
    _registered(_name, *_parts)
