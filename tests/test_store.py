import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumry.__main__ import main
from vellumry.registry import FILES, Registry
from vellumry.sources import content_files
from vellumry.store import Conflict, Journal, Store, write_files
from vellumry.streaming import outbox as streamed


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        (tmp_path / "c" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / path).write_text(text)

    put("wiki/guide/index.md", "---\nid: 41\ntitle: Guide\nstatus: draft\n---\n\nBody one\nmore\n")
    put("wiki/guide/child.md", "---\ntitle: \"Child: x\"\n---\n\nno id\n")
    put("post/plain.md", "just text")
    put("_tables/skip.md", "---\nid: 9\n---\n\nskipped\n")
    put("nav/item.md", "---\nid: 50\n---\n\nx\n")
    return str(tmp_path / "c")


def test_scan_and_parse(spark, tree):
    assert {r.path for r in content_files.manifest(spark, tree).collect()} == {"wiki/guide/index.md", "wiki/guide/child.md", "post/plain.md", "nav/item.md"}
    rows = {r.post_name: r for r in content_files.posts(spark, tree, excluded=("nav",)).collect()}
    assert set(rows) == {"guide", "child"}
    assert (rows["guide"].ID, rows["guide"].post_content, rows["guide"].post_status, rows["guide"].post_parent) == (41, "Body one\nmore", "draft", 0)
    assert (rows["child"].ID, rows["child"].post_title, rows["child"].post_parent) == (42, "Child: x", 41)


def test_commands(spark, tree, tmp_path, capsys):
    where = ["--files", tree, "--store", f"file://{tmp_path}/s"]
    assert main(["import", *where], spark) == {"generation": 1, "cold": True, "posts": 3, "ids_written": 1}
    found = main(["doctor", *where], spark)
    assert (found["files"], found["posts"], found["orphan_files"]) == (4, 3, 1)  # one file has no frontmatter
    assert main(["reconcile", *where], spark)["counts"]["unchanged"] == 3
    out = ["--files", f"{tmp_path}/out", "--store", f"file://{tmp_path}/s"]
    assert main(["export", *out], spark) == {"created": 3, "changed": 0, "deleted": 0}
    assert (tmp_path / "out/wiki/guide/child.md").read_text().endswith("\n\nno id\n")
    assert main(["migrate", "--files", f"{tmp_path}/out"], spark) == {"scanned": 3, "migrated": 3, "skipped": 0, "malformed": 0}
    assert main(["reconcile", "--files", f"{tmp_path}/out", "--store", f"file://{tmp_path}/s2", "--apply"], spark)["operation"] == "completed"


def test_recovery_from_a_database_left_behind(spark, tmp_path, capsys):
    from vellumry.operators import documents

    own = [c for c, *_ in documents.COLUMNS if c != "source_identity"]
    with sqlite3.connect(tmp_path / "old.db") as db:
        db.execute(f"CREATE TABLE wp_posts ({', '.join(own)})")
        for i, up in ((10, 0), (19, 10), (20, 19), (21, 20), (22, 0)):
            db.execute("INSERT INTO wp_posts (ID, post_parent, post_name, post_type, post_title) VALUES (?, ?, ?, 'wiki', 't')", (i, up, f"n{i}"))
    where = ["--files", str(tmp_path / "f"), "--store", f"file://{tmp_path}/s", "--root-id", "10", "--least-id", "20", "--database", str(tmp_path / "old.db")]
    assert main(["recover", *where], spark) == {"candidates": [20, 21], "imported": 0, "skipped": 0}
    assert main(["recover", *where, "--apply"], spark) == {"candidates": [20, 21], "imported": 3, "skipped": 0}
    assert main(["recover", *where, "--apply"], spark)["skipped"] == 3


def test_generations(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert store.publish("t", one) == 1
    assert store.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), ["k"]) == 2
    assert {(r.k, r.v) for r in store.read("t").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    with pytest.raises(Conflict):
        store.publish("t", one, expected=1)
    assert {(r.k, r.change) for r in store.changes("t", 1, 2, ["k"], "v").collect()} == {(2, "changed"), (3, "created")}
    assert store.identity("t", "k", "v") != tuple([2, 0]) and store.prune("t", 1) == 1 and store.read("t").count() == 3
    with pytest.raises(FileNotFoundError):
        store.read("none")


def test_writer_rejects_repeated_paths(spark, tmp_path):
    with pytest.raises(ValueError):
        write_files(spark.createDataFrame([("a.md", "x"), ("a.md", "y")], "path string, file string"), str(tmp_path))


def test_journal_fences(spark, tmp_path):
    j = Journal(spark, f"file://{tmp_path}")
    j.plan("op", {"r": 1})
    with pytest.raises(Conflict):
        j.plan("op", {"r": 2})
    first = j.claim("op", "a", now=0, seconds=10)
    with pytest.raises(Conflict):
        j.claim("op", "b", now=5)
    second = j.claim("op", "b", now=11)
    with pytest.raises(Conflict):
        j.advance(first, "applied", now=12)
    assert second["fence"] == 2 and [r["id"] for r in j.recoverable(["op"], now=100)] == ["op"]
    assert j.advance(j.advance(second, "applied", now=12), "completed", now=13)["state"] == "completed"


def test_options_json_and_sqlite(spark, tmp_path):
    (tmp_path / "_options").mkdir()
    (tmp_path / "_options/a.json").write_text('{"option_id": 1, "option_name": "a", "option_value": "x", "autoload": "yes"}')
    (tmp_path / "_options/b.json").write_text("{broken")
    assert [r.option_name for r in content_files.options(spark, str(tmp_path / "_options")).collect()] == ["a"]
    (tmp_path / "t.json").write_text('[{"id": 1}, {"id": 2}]')
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert content_files.json_rows(spark, str(tmp_path / "t.json"), schema).count() == 2
    with sqlite3.connect(tmp_path / "d.sqlite") as db:
        db.execute("create table p (id int)")
        db.executemany("insert into p values (?)", [(i,) for i in range(5)])
    assert content_files.sqlite_rows(spark, str(tmp_path / "d.sqlite"), "select id from p", schema, 2).agg(F.sum("id")).first()[0] == 10


def test_registry_and_capabilities():
    r = Registry("native")
    r.register("native", 1)
    r.register("portable", 2, when=lambda f: "wordpress" in f)
    assert (r.resolve("native", {"wordpress"}), r.resolve(subject={"wordpress"}), r.resolve(subject={})) == (1, 2, 1)
    with pytest.raises(KeyError):
        r.resolve("other")
    FILES.require(["read", "search"])
    with pytest.raises(PermissionError):
        FILES.require(["transactions"])


def test_streamed_transactions(spark, tmp_path):
    src, dead = str(tmp_path / "log"), str(tmp_path / "dead")
    row = lambda s, q, a, e=None, p=None: (s, q, a, p, e, None)
    spark.createDataFrame([row(1, 1, "begin"), row(1, 2, "event", 10), row(2, 1, "event", 20), row(2, 2, "event", 21)], streamed.LOG).coalesce(1).write.parquet(src)
    got = set()

    def handle(batch, refused=(20,)):
        rows = [(r.session, r.event) for r in batch.collect()]
        if any(e in refused for _, e in rows):
            raise RuntimeError("refused")
        got.update(rows)

    def run():
        streamed.deliver(streamed.committed_stream(streamed.log_stream(spark, src)), handle, str(tmp_path / "cp"), dead, once=True).awaitTermination(120)

    run()
    # The record that is refused takes none of its batch with it, and can be tried again.
    assert got == {(2, 21)} and [(r.event, r.error) for r in spark.read.parquet(dead).collect()] == [(20, "RuntimeError: refused")]
    spark.createDataFrame([row(1, 3, "savepoint", p="s"), row(1, 4, "event", 11), row(1, 5, "rollback_to", p="s"), row(1, 6, "commit")], streamed.LOG).coalesce(1).write.mode("append").parquet(src)
    run()
    assert got == {(2, 21), (1, 10)}
    assert streamed.redeliver(spark, dead, handle) == 1 and streamed.redeliver(spark, dead, lambda b: handle(b, ())) == 0
    assert got == {(2, 21), (1, 10), (2, 20)}


def test_windowed_counts_leave_late_rows_out(spark, tmp_path):
    src, out = str(tmp_path / "log"), []
    at = lambda minute: f"2024-01-01 00:{minute:02d}:00"
    put = lambda *rows: spark.createDataFrame([(1, k, a, None, None, m) for k, (a, m) in enumerate(rows)], "session long, seq long, action string, savepoint string, event long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)

    def run():
        counts = streamed.windowed_counts(streamed.log_stream(spark, src, 1), "10 minutes", "5 minutes").select(F.date_format("window.start", "HH:mm").alias("w"), "action", "n")
        q = counts.writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    put(("event", at(1)), ("event", at(2)), ("begin", at(7)))
    run()
    put(("event", at(40)))
    run()
    put(("event", at(3)), ("event", at(41)))  # the first is more than ten minutes late
    run()
    assert sorted(out) == [("00:00", "event", 2), ("00:05", "begin", 1), ("00:40", "event", 1), ("00:40", "event", 2)]
