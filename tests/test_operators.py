from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumry.functions import text as fx
from vellumry.functions import yamlish
from vellumry.operators import dedup, hierarchy, mutations, outbox, reconcile, search


def test_needles():
    n = search.needle_of_pattern
    assert n("%fox%") == "fox" and n("%%") == "" and n(r"%50\% OFF%") == "50% OFF" and n("%it''s%") == "it's"
    assert n("%a_b%") is None and n("fox%") is None and n("%a%b%") is None


def test_search_cases(spark):
    p = spark.createDataFrame([(10, "quick brown fox"), (20, "WordPress content PHP"), (30, "FOX post content"), (40, ""), (50, "now 50% off")], "ID long, post_content string")
    ids = lambda needle: [r.ID for r in search.matching_ids(p, needle).collect()]
    assert ids("fox") == [10, 30] and ids("content") == [20, 30] and ids("") == [] and ids("50% OFF") == [50]


def test_yaml_round_trip_and_rules():
    d = {"id": 3, "title": "a: b", "flag": True, "off": "no", "tags": ["x", "1", ""], "deep": {"k": {"n": "line\nnext \\n"}}, "n": "007"}
    assert yamlish.decode(yamlish.encode(d)) == d
    assert yamlish.decode("tags: [a, b]") == {"tags": "[a, b]"} and yamlish.decode("") is None
    assert yamlish.decode_scalar('"a\\\\n"') == "a\\n" and yamlish.decode_scalar('"a\\\\n"', strict_compat=True) == "a\n"


@pytest.mark.parametrize(
    ("sql", "scope"),
    [
        ("UPDATE t SET a = 1 WHERE id = 5", {"id": ["5"]}),
        ("DELETE FROM t WHERE id IN (1, 2) AND k = 'x'", {"id": ["1", "2"], "k": ["x"]}),
        ("DELETE FROM t WHERE id = 1 OR id = 2", {}),
        ("INSERT INTO t (id, n) VALUES (7, 'a,b')", {"id": ["7"], "n": ["a,b"]}),
        ("INSERT INTO t (id) VALUES (7), (8)", {}),
        ("INSERT INTO t (id) VALUES (7) ON DUPLICATE KEY UPDATE id = 8", {}),
        ("REPLACE INTO t (id) VALUES (1)", {}),
        ("UPDATE t SET a = 1", {}),
    ],
)
def test_scopes(sql, scope):
    assert mutations.scope(sql) == scope


def test_deleted_tables():
    assert mutations.deleted_tables("DELETE a, b FROM wp_options a, wp_options AS b WHERE a.x = b.x") == ["wp_options"]
    assert mutations.deleted_tables("DELETE z FROM wp_options a WHERE 1") is None


def test_classified_statements(spark):
    sql = ["insert ignore into t values (1)", "REPLACE INTO t VALUES (1)", "update t set a=1", "delete from t", "create table if not exists t (a int)", "create unique index i on t (a)", "alter table t add b int", "truncate t", "drop table t", "select 1"]
    df = spark.createDataFrame(list(enumerate(sql)), "n int, sql string")
    got = [r.op for r in df.select("n", mutations.operation(F.col("sql")).alias("op")).orderBy("n").collect()]
    assert got == ["INSERT", "REPLACE", "UPDATE", "DELETE", "CREATE", "ALTER", "ALTER", "TRUNCATE", "DROP", None]


def test_savepoint_fold():
    log = [("begin", None, None), ("event", None, 1), ("savepoint", "s", None), ("event", None, 2), ("rollback_to", "s", None), ("event", None, 3), ("commit", None, None), ("event", None, 4), ("begin", None, None), ("event", None, 5)]
    assert outbox.fold(log) == [1, 3, 4]


def test_outbox_transitions(spark):
    now = F.expr("TIMESTAMP_NTZ '2024-01-01 12:00:00'")
    rows = [(1, "pending", None, None, 0), (2, "acked", None, None, 0), (3, "failed", None, None, 1)]
    e = spark.createDataFrame(rows, "id long, state string, worker_token string, lease_token string, failures long").withColumns({"available_at": now, "leased_until": F.lit(None).cast("timestamp_ntz"), "created_at": now, "attempts": F.lit(0).cast("long"), "reclaims": F.lit(0).cast("long"), "last_error": F.lit(None).cast("string")})
    held = outbox.claim(e, now, "w", "l", 1, 60)
    assert {r.id: r.state for r in held.collect()} == {1: "leased", 2: "acked", 3: "failed"}
    assert {r.state for r in outbox.acknowledge(held, now, 1, "w", "l").where("id = 1").collect()} == {"acked"}
    assert {r.state for r in outbox.acknowledge(held, now, 1, "other", "l").where("id = 1").collect()} == {"leased"}
    r = outbox.fail(held, now, 1, "w", "l", "boom", 30).where("id = 1").first()
    assert (r.state, r.failures, r.last_error, r.lease_token) == ("failed", 1, "boom", None)


TRUTH = [
    ("a", None, None, "created"), (None, "a", None, "written_from_wordpress"), ("a", "b", None, "conflicts"), ("a", "a", "x", "unchanged"), ("b", "a", "a", "updated_from_file"),
    ("a", "b", "a", "written_from_wordpress"), ("b", "c", "a", "conflicts"), (None, "a", "a", "conflicts"), ("a", None, "a", "conflicts"), (None, "b", "a", "conflicts"),
]


def test_three_way_truth_table(spark):
    df = spark.createDataFrame([(i, c, w, b) for i, (c, w, b, _) in enumerate(TRUTH)], "i int, c string, w string, b string")
    assert [r.category for r in reconcile.classify(df).orderBy("i").collect()] == [t[3] for t in TRUTH]
    managed = reconcile.classify(df.withColumn("proven", F.lit(True)), deletion="managed").orderBy("i").collect()
    assert [r.category for r in managed][7:9] == ["deleted_from_file", "deleted_from_wordpress"]
    counts = {r.category: r.n for r in reconcile.category_counts(reconcile.classify(df)).collect()}
    assert set(counts) == set(reconcile.CATEGORIES) and sum(counts.values()) == len(TRUTH) and counts["moved"] == 0


def test_cycles_end(spark):
    n = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1), (5, None), (6, 99)], "ID long, post_parent long")
    up: dict = {}
    for r in hierarchy.ancestors(n).collect():
        up.setdefault(r.ID, set()).add(r.ancestor)
    assert up == {1: {2, 3}, 2: {1, 3}, 3: {1, 2}, 4: {1, 2, 3}}


def test_newest_wins_keeps_files_without_ids(spark):
    f = spark.createDataFrame([(0, 1, "z"), (None, 5, "a"), (None, 5, "d"), (1, 2, "b"), (1, 2, "a"), (0, 3, "y")], "ID long, mtime int, path string")
    assert sorted((r.ID is None, r.path) for r in dedup.newest_wins(f, "ID", "mtime", "path").collect()) == [(False, "a"), (False, "y"), (True, "a"), (True, "d")]


def test_names(spark):
    d = spark.createDataFrame([("Hello World!",), ("---",), ("",)], "s string")
    assert [tuple(r) for r in d.select(fx.slug(F.col("s")), fx.safe_segment(F.col("s"))).collect()] == [("Hello-World", "hello-world"), ("unnamed", "untitled"), ("unnamed", "untitled")]


def test_writes_that_files_must_follow_name_ids():
    assert mutations.prepared_ids("UPDATE wp_posts SET a = 1 WHERE ID IN (3, 4)") == [3, 4] and mutations.prepared_ids("SELECT 1 FROM wp_posts") == [] == mutations.prepared_ids("UPDATE wp_options SET a = 1")
    for sql in ("UPDATE wp_posts SET a = 1", "DELETE FROM `wp_posts` WHERE ID = 1 OR ID = 2", "REPLACE INTO wp_posts (ID) VALUES (1)"):
        with pytest.raises(ValueError):
            mutations.prepared_ids(sql)


def test_outbox_schema(spark):
    good = spark.createDataFrame([], outbox.SCHEMA)
    assert outbox.validated(good).count() == 0
    with pytest.raises(ValueError, match="lease_token string"):
        outbox.validated(good.drop("lease_token"))
    odd = spark.range(1).select(F.col("id"), *[F.lit("odd" if c == "state" else None).cast(t).alias(c) for c, t in good.dtypes[1:]])
    with pytest.raises(Exception, match="no such state: odd"):
        outbox.validated(odd).collect()
    with pytest.raises(ValueError):
        outbox.claim(good, F.expr("TIMESTAMP_NTZ '2024-01-01'"), "w", "l", 0, 60)


def test_strict_matches_raise(spark):
    rows, targets = spark.createDataFrame([("a", "x")], "s string, p string"), spark.createDataFrame([(1, "a", "z"), (2, "a", "x")], "ID long, s string, p string")
    assert reconcile.priority_match(rows, targets, [("s", "s"), ("p", "p")], "ID", strict=True).first().matched == 2
    with pytest.raises(Exception, match="several targets for a"):
        reconcile.priority_match(rows, targets, [("s", "s")], "ID", strict=True).collect()
    with pytest.raises(Exception, match="no target for b"):
        reconcile.priority_match(spark.createDataFrame([("b", "q")], "s string, p string"), targets, [("s", "s")], "ID", strict=True).collect()
    with pytest.raises(ValueError):
        reconcile.validated(spark.createDataFrame([(1, None, None, None)], "k int, c string, w string, b string"), "k")


def test_matching_rows_without_a_key_or_with_a_common_one(spark):
    """Rows that have no key don't meet in one task, and those that share one aren't sorted there, whatever their other columns."""
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    i = F.col("id")
    rows = own.range(400).select("id", F.when(i % 100 == 0, F.concat(F.lit("a"), i)).alias("s"), F.lit(7).alias("p"), F.create_map(F.lit("x"), i).alias("a map"))
    targets = own.createDataFrame([(1, "a0", 7), (2, "a100", 8), (3, "a200", 9), (4, "a200", 9), (5, None, None)], "ID long, s string, p int")
    one = reconcile.priority_match(rows, targets, [("s", "s")], "ID").select("id", "s", "matched", F.spark_partition_id().alias("task")).collect()
    assert {r.id: r.matched for r in one if r.matched is not None} == {0: 1, 100: 2}
    shares = Counter(r.task for r in one if r.s is None)
    assert sum(shares.values()) == 396 and len(shares) == 2 and min(shares.values()) > 100
    both = reconcile.priority_match(rows, targets, [("s", "s"), ("p", "p")], "ID")
    assert both.columns == ["id", "s", "p", "a map", "matched"] and [(r.matched, r["count"]) for r in both.groupBy("matched").count().orderBy("matched").collect()] == [(1, 399), (2, 1)]
    assert "SortMergeJoin" not in both._jdf.queryExecution().executedPlan().toString()


def test_deep_trees_and_scoped_walks(spark):
    n = spark.createDataFrame([(i, i - 1 if i else None) for i in range(7)] + [(100, 101), (101, 100)], "ID long, post_parent long")
    assert hierarchy.ancestors(n).where("ID = 6").count() == 6
    some = spark.createDataFrame([(3,), (100,)], "ID long")
    assert sorted(map(tuple, hierarchy.ancestors(n, some).collect())) == [(3, 0, 3), (3, 1, 2), (3, 2, 1), (100, 101, 1)]
    assert {r.ID: r.depth for r in hierarchy.descendants(n, 1).collect()} == {i: i - 1 for i in range(2, 7)}
    assert [tuple(r) for r in hierarchy.recoverable(n, 3, 5, 5).collect()] == [(5, 5), (6, 6)]


def test_paths_and_identities(spark):
    d = spark.createDataFrame([("a/./b//c",), ("/x/../y/",), ("../z",), ("a\\b",), ("",)], "p string")
    assert [r[0] for r in d.select(fx.normalized_path(F.col("p"))).collect()] == ["a/b/c", "/y", None, "a/b", ""]
    j = spark.createDataFrame([('{"b": [2, 1], "a": {"d": 1, "c": null}}',), ('{"a":{"c":null,"d":1},"b":[2,1]}',), ("{",), (None,)], "j string")
    found = [r[0] for r in j.select(fx.exact_identity(F.col("j"))).collect()]
    assert found[0] == found[1] is not None and found[2:] == [None, None]
    assert [r[0] for r in spark.createDataFrame([("aéb",), ("北",)], "s string").select(fx.slug(F.col("s"))).collect()] == ["a--b", "unnamed"]
