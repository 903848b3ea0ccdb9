"""Whole stores: opened, changed, flushed, reconciled, migrated; tables beside them."""

import os
import time

import pytest
from pyspark.sql import functions as F

from vellumry import tree
from vellumry.engine import Engine
from vellumry.operators import documents
from vellumry.reconciliation import Reconciler
from vellumry.registry import LAYOUTS, Backend, Layout
from vellumry.sources import content_files, tables
from vellumry.store import Conflict, Store


def put(root, path, text):
    full = f"{root}/{path}"
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def listing(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.startswith("."))


def read(root, path):
    with open(f"{root}/{path}") as f:
        return f.read()


@pytest.fixture
def site(tmp_path):
    root = str(tmp_path / "files")
    put(root, "wiki/guide.md", "---\nid: 41\ntitle: Guide\nslug: guide\ntype: wiki\nmeta:\n  color: red\n  sizes:\n    - \"1\"\n    - \"2\"\nterms:\n  post_tag:\n    - b\n    - a\n---\n\nBody\n")
    put(root, "post/new.md", "---\ntitle: New\n---\n\nno id yet\n")
    return root, f"file://{tmp_path}/store"


def post(ident, name, parent=0, **more):
    return {"ID": ident, "post_name": name, "post_parent": parent, "post_type": "wiki", "post_title": name.title(), "post_status": "publish", "post_content": f"text of {name}"} | more


def test_open_save_flush_and_warm_sync(spark, site):
    root, store = site
    told = []
    e = Engine(spark, root, store, on_flushed=lambda r: told.extend(r.collect()))
    assert e.open() == {"generation": 1, "cold": True, "posts": 2, "ids_written": 1}
    assert read(root, "post/new.md") == "---\nid: 42\ntitle: New\n---\n\nno id yet\n"
    assert {r.ID: r.post_parent for r in e.posts().collect()} == {41: 0, 42: 0}
    again = e.open()
    assert again["cold"] is False and again["unchanged"] == 2 and again["generation"] == e.store.generation("posts")
    # A child under 41 makes its file the index of a folder; 43 is new; metadata of 41 stay.
    e.save(spark.createDataFrame([post(43, "child", 41)]))
    assert [(r.path, r.change) for r in e.flush().collect()] == [("wiki/guide/child.md", "created"), ("wiki/guide/index.md", "created"), ("wiki/guide.md", "deleted")]
    assert listing(root) == ["post/new.md", "wiki/guide/child.md", "wiki/guide/index.md"] and len(told) == 3
    text = read(root, "wiki/guide/index.md")
    assert 'meta:\n  color: red\n  sizes:\n    - "1"\n    - "2"\nterms:\n  post_tag:\n    - a\n    - b\n---\n\nBody\n' in text  # slugs come in order
    assert e.flush().count() == 0 and e.open()["unchanged"] == 3
    # Outside changes: one edited, one added without an id, one gone.
    time.sleep(0.01)
    put(root, "wiki/guide/child.md", read(root, "wiki/guide/child.md").replace("text of child", "edited"))
    put(root, "wiki/guide/late.md", "---\ntitle: Late\n---\n\nlate\n")
    os.remove(f"{root}/post/new.md")
    synced = e.open()
    assert (synced["changed"], synced["new"], synced["deleted"], synced["ids_written"]) == (1, 1, 1, 1)
    rows = {r.ID: r for r in e.posts().collect()}
    assert set(rows) == {41, 43, 44} and rows[43].post_content == "edited" and rows[44].post_parent == 41
    assert e.health() == {"both_sides": 3, "missing_files": 0, "orphan_files": 0, "generation": e.store.generation("posts"), "generations_to_flush": 0}
    before = e.identity()
    e.delete(spark.createDataFrame([(43,), (44,)], "ID long"))
    assert [(r.path, r.change) for r in e.flush().collect()] == [("wiki/guide.md", "created"), ("wiki/guide/child.md", "deleted"), ("wiki/guide/index.md", "deleted"), ("wiki/guide/late.md", "deleted")]
    assert listing(root) == ["wiki/guide.md"] and not os.path.exists(f"{root}/wiki/guide") and e.identity() != before and e.next_id() == 42


def test_saves_that_are_refused(spark, site):
    root, store = site
    e = Engine(spark, root, store, excluded=("secret",))
    e.open()
    with pytest.raises(ValueError):
        e.save(spark.createDataFrame([post(0, "x")]))
    with pytest.raises(ValueError):
        e.save(spark.createDataFrame([post(5, "x"), post(5, "y")]))
    with pytest.raises(PermissionError):
        Engine(spark, root, store, backend=Backend("r", frozenset({"read"}))).save(spark.createDataFrame([post(5, "x")]))

    def deny(what, rows):
        raise PermissionError(what)

    with pytest.raises(PermissionError, match="delete"):
        Engine(spark, root, store, authorize=deny).delete(spark.createDataFrame([(41,)], "ID long"))
    # Excluded types and drafts that nobody saved get no files; a post without a name goes by its id.
    e.save(spark.createDataFrame([post(50, "s", post_type="secret"), post(51, "d", post_status="auto-draft"), post(52, ""), post(53, "aéb")]))
    assert [r.path for r in e.flush().collect()] == ["wiki/52.md", "wiki/a--b.md"]
    assert e.status_of(51) == "auto-draft" and e.status_of(99) is None
    e.truncate("wiki")
    assert {r.ID for r in e.posts().collect()} == {42, 50}


def test_layouts_and_hooks(spark, tmp_path):
    root, store = str(tmp_path / "files"), f"file://{tmp_path}/store"
    put(root, "flat/7-seven.md", "---\nid: 7\ntitle: Seven\n---\n\n*seven*\n")
    put(root, "README.md", "---\ntitle: not content\n---\n\nx\n")
    flat = Layout(
        paths=lambda posts, excluded: posts.select("ID", F.concat(F.lit("flat/"), F.col("ID"), F.lit("-"), F.col("post_name"), F.lit(".md")).alias("path")),
        slug=lambda path: F.regexp_extract(path, r"\d+-([^/]+)\.md$", 1),
        sources=lambda rows: rows.where(F.col("path").startswith("flat/")),
    )
    if "flat" not in LAYOUTS._known:
        LAYOUTS.register("flat", flat)
    to_html = lambda rows: rows.withColumn("post_content", F.regexp_replace("post_content", r"\*(\w+)\*", "<b>$1</b>"))
    to_markdown = lambda rows: rows.withColumn("post_content", F.regexp_replace("post_content", "<b>(\\w+)</b>", "*$1*"))
    e = Engine(spark, root, store, layout="flat", after_read=to_html, before_write=to_markdown)
    assert e.open()["posts"] == 1 and [(r.ID, r.post_name, r.post_content) for r in e.posts().collect()] == [(7, "seven", "<b>seven</b>")]
    e.save(spark.createDataFrame([post(8, "eight", post_content="<b>eight</b>")]))
    assert [(r.path, r.change) for r in e.flush().collect()] == [("flat/8-eight.md", "created")] and read(root, "flat/8-eight.md").endswith("\n\n*eight*\n")
    with pytest.raises(KeyError):
        Engine(spark, root, store, layout="none")


def test_a_tree_that_changes_while_it_is_read_is_not_published(spark, site, monkeypatch):
    root, store = site
    e = Engine(spark, root, store)
    seen = e._manifest()
    put(root, "post/more.md", "---\nid: 9\n---\n\nx\n")
    with pytest.raises(Conflict):
        e._unchanged(seen)


def test_files_of_both_profiles_round_trip(spark, tmp_path):
    odd = post(7, "seven", post_title='true: "x" \\n', post_excerpt="123", post_date="2024-01-02 03:04:05", post_date_gmt="2024-01-02 03:04:05", guid="http://x/7", menu_order=3, post_content="line\n\n---\nmore")
    posts = spark.createDataFrame([odd, post(8, "eight", 7)])
    meta = spark.createDataFrame([(1, 7, "k", "v"), (2, 7, "k", "w"), (3, 7, "one", "yes"), (4, 7, "_edit_lock", "x"), (5, 7, "_thumbnail_id", "9")], "meta_id long, post_id long, meta_key string, meta_value string")
    terms = spark.createDataFrame([(7, "post_tag", "b"), (7, "post_tag", "a"), (7, "cat", "c")], "object_id long, taxonomy string, slug string")
    want = {r.ID: r for r in documents.with_details(posts, meta, terms).withColumn("d", documents.receipt()).collect()}
    for profile in documents.PROFILES:
        root = f"{tmp_path}/{profile}"
        found = tree.write_changed(spark, root, spark.createDataFrame([], "path string, digest string"), tree.files_of(posts, meta, terms, profile))
        assert [(r.path, r.change) for r in found.collect()] == [("wiki/seven/eight.md", "created"), ("wiki/seven/index.md", "created")]
        back = documents.with_details(content_files.posts(spark, root))
        got = {r.ID: r for r in back.withColumn("d", documents.receipt()).collect()}
        assert {k: r.d for k, r in got.items()} == {k: r.d for k, r in want.items()}, profile
        assert got[7].profile == profile and got[7].meta == '{"_thumbnail_id":"9","k":["v","w"],"one":"yes"}' and got[7].terms == '{"cat":["c"],"post_tag":["a","b"]}'
        assert sorted(map(tuple, documents.meta_rows(back).collect())) == [(7, "_thumbnail_id", "9"), (7, "k", "v"), (7, "k", "w"), (7, "one", "yes")]
        assert sorted(map(tuple, documents.term_rows(back).collect())) == [(7, "cat", "c"), (7, "post_tag", "a"), (7, "post_tag", "b")]
    assert read(f"{tmp_path}/portable", "wiki/seven/index.md").startswith("---\ntype: document\n") and "timestamp: \"2024-01-02T03:04:05+00:00\"" in read(f"{tmp_path}/portable", "wiki/seven/index.md")


def test_migration(spark, tmp_path):
    root = str(tmp_path)
    put(root, "post/a.md", "---\nid: 1\ntitle: A\ndate: 2024-01-02 03:04:05\n---\n\nbody\n")
    put(root, "post/plain.md", "no fences")
    assert tree.migrate(spark, root) == {"scanned": 1, "migrated": 1, "skipped": 0, "malformed": 1}
    assert tree.migrate(spark, root) == {"scanned": 1, "migrated": 0, "skipped": 1, "malformed": 1}
    row = content_files.posts(spark, root).first()
    assert (row.ID, row.post_title, row.post_content, row.post_date, row.profile) == (1, "A", "body", "2024-01-02 03:04:05", "portable")


def test_leftovers_of_dead_writers_are_reclaimed(spark, tmp_path):
    put(str(tmp_path), "a/x.md.1.tmp", "half")
    put(str(tmp_path), "a/y.md", "whole")
    assert tree.reclaim(spark, str(tmp_path)) == 0 and tree.reclaim(spark, str(tmp_path), -10) == 1 and listing(str(tmp_path)) == ["a/y.md"]


def test_ids_go_into_files_and_nothing_else_changes(spark):
    raw = {"---\ntitle: x\n---\n\nb\n": "---\nid: 5\ntitle: x\n---\n\nb\n", "---\ntitle: x\nID : 9\nz: 1\n---\nid: 3": "---\ntitle: x\nid: 5\nz: 1\n---\nid: 3", "plain\n": "---\nid: 5\n---\n\nplain\n", "": "---\nid: 5\n---\n\n"}
    rows = spark.createDataFrame([(k,) for k in raw], "raw string").select("raw", tree.with_id(F.col("raw"), F.lit(5)).alias("new")).collect()
    assert {r.raw: r.new for r in rows} == raw


def test_reconciliation_both_ways(spark, tmp_path):
    root, store = str(tmp_path / "files"), f"file://{tmp_path}/store"
    r = Reconciler(spark, root, store)
    r.store.publish("posts", documents.with_details(spark.createDataFrame([post(1, "one"), post(2, "two"), post(3, "three")])))
    put(root, "wiki/four.md", "---\nid: 4\ntitle: Four\nslug: four\ntype: wiki\n---\n\nfrom a file\n")
    p = r.plan()
    assert p["counts"] == {"created": 1, "updated_from_file": 0, "deleted_from_file": 0, "written_from_wordpress": 3, "deleted_from_wordpress": 0, "moved": 0, "unchanged": 0, "conflicts": 0}
    with pytest.raises(Conflict):
        r.apply("0" * 64, p["source_identity"])
    done = r.apply(p["plan_id"], p["source_identity"])
    assert done["operation"] == "completed" and listing(root) == ["wiki/four.md", "wiki/one.md", "wiki/three.md", "wiki/two.md"]
    assert {x.ID for x in r.store.read("posts").collect()} == {1, 2, 3, 4} == {x.ID for x in r.store.read("baseline").collect()}
    assert r.plan()["counts"]["unchanged"] == 4
    with pytest.raises(Conflict):  # it was made from other sources
        r.apply(p["plan_id"], p["source_identity"])
    # A file edited, a post edited, one edited on both sides, one deleted.
    put(root, "wiki/one.md", read(root, "wiki/one.md").replace("text of one", "file edit"))
    put(root, "wiki/two.md", read(root, "wiki/two.md").replace("text of two", "file edit"))
    os.remove(f"{root}/wiki/four.md")
    now = r.store.read("posts").withColumn("post_content", F.when(F.col("ID").isin(2, 3), "store edit").otherwise(F.col("post_content")))
    r.store.publish("posts", now)
    counts = lambda **k: {c: n for c, n in r.plan(**k)["counts"].items() if n}
    assert counts() == {"updated_from_file": 1, "written_from_wordpress": 1, "conflicts": 2}
    policy = {"deletion": "managed", "preference": "prefer_wordpress"}
    assert counts(**policy) == {"updated_from_file": 1, "written_from_wordpress": 2, "deleted_from_file": 1}
    assert counts(direction="canonical_to_wordpress") == {"updated_from_file": 1, "conflicts": 3}
    page = r.plan(page=2, **policy)
    assert [x.ID for x in page["entries"].collect()] == [1, 2]
    rest = r.resume(page["continuation"], page["plan_id"], 2, **policy)
    assert [x.ID for x in rest["entries"].collect()] == [3, 4] and rest["continuation"] is None
    with pytest.raises(Conflict):
        r.resume({"after": 1, "identity": page["continuation"]["identity"]}, page["plan_id"], 2, **policy)
    p = r.plan(**policy)
    r.apply(p["plan_id"], p["source_identity"], **policy)
    assert {x.ID: x.post_content for x in r.store.read("posts").collect()} == {1: "file edit", 2: "store edit", 3: "store edit"}
    assert "store edit" in read(root, "wiki/two.md") and listing(root) == ["wiki/one.md", "wiki/three.md", "wiki/two.md"]
    assert counts() == {"unchanged": 3}


def test_a_crash_in_between_is_recovered(spark, tmp_path, monkeypatch):
    root, store = str(tmp_path / "files"), f"file://{tmp_path}/store"
    r = Reconciler(spark, root, store)
    r.store.publish("posts", documents.with_details(spark.createDataFrame([post(1, "one")])))
    put(root, "wiki/two.md", "---\nid: 2\ntitle: Two\nslug: two\ntype: wiki\n---\n\nx\n")
    p = r.plan()
    monkeypatch.setattr(r, "_into_files", lambda read: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        r.apply(p["plan_id"], p["source_identity"], now=100.0)
    monkeypatch.undo()
    assert r.store.generation("posts") == 2 and listing(root) == ["wiki/two.md"] and r.journal.get(p["plan_id"])["state"] == "claimed"
    assert r.recover(now=200.0) == [] and r.recover("other", now=100_000.0) == [p["plan_id"]]
    assert r.store.generation("posts") == 2 and listing(root) == ["wiki/one.md", "wiki/two.md"] and r.plan()["counts"]["unchanged"] == 2
    assert r.recover(now=200_000.0) == []


def test_snapshots_options_and_schemas(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert tables.read_snapshot(store, "t") is None
    rows = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "k long, v string, x double")
    wrote = tables.write_snapshot(store, "t", rows, hook=lambda d: d.where("k > 0"))
    assert wrote["n_rows"] == 2 and sorted(map(tuple, tables.read_snapshot(store, "t").collect())) == [(1, "a", None), (2, None, 2.5)]
    folder = f"{tmp_path}/options"
    opts = lambda *rows: spark.createDataFrame(rows, "option_id long, option_name string, option_value string, autoload string")
    first = tables.write_options(spark, folder, opts((1, "siteurl", "u", "yes"), (2, "a b", "x", "no"), (3, "_transient_x", "t", "no"), (4, "cron", "c", "no")), ("cron",))
    assert {r.change for r in first.collect()} == {"created"} and first.count() == 2
    assert [r.option_name for r in content_files.options(spark, folder, ("siteurl", "none")).collect()] == ["siteurl"]
    dirty = spark.createDataFrame([("siteurl",)], "option_name string")
    partly = tables.write_options(spark, folder, opts((1, "siteurl", "v", "yes")), dirty=dirty)
    assert [(r.path, r.change) for r in partly.collect()] == [("siteurl.json", "changed")] and len(listing(folder)) == 2
    last = tables.write_options(spark, folder, opts((1, "siteurl", "v", "yes")))
    assert [r.change for r in last.collect()] == ["deleted"] and listing(folder) == ["siteurl.json"]
    s = tables.Schemas(spark, f"{tmp_path}/schemas")
    ddl = ["CREATE TABLE `jobs` (id BIGINT NOT NULL, payload LONGTEXT, n DECIMAL(10, 2), PRIMARY KEY (id), KEY k (payload(10)))", "CREATE UNIQUE INDEX i ON jobs (id)", "SELECT 1", "CREATE TABLE gone (x INT)"]
    assert s.save(ddl) == ["gone", "jobs"] and s.save(["DROP TABLE IF EXISTS gone"]) == ["gone"]
    assert {t: x.simpleString() for t, x in s.replay().items()} == {"jobs": "struct<id:bigint,payload:string,n:string>"}
    assert s.scan()[0]["indexes"] == ["CREATE UNIQUE INDEX IF NOT EXISTS i ON jobs (id)"] and s.scan()[0]["statement"].startswith("CREATE TABLE IF NOT EXISTS `jobs`")


def test_row_partitions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    t = tables.RowPartitions(store, "events", "event_id", 4)
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(1, 9)], "event_id long, payload string")
    assert t.replace(rows) == 1
    before = t.marker()["folders"]
    changed = t.change(spark.createDataFrame([(3, "new")], "event_id long, payload string"), spark.createDataFrame([(3,)], "event_id long"))
    assert changed == 2 and sum(t.marker()["folders"].get(b) != f for b, f in before.items()) == 1
    assert {r.event_id: r.payload for r in t.rows().collect()} == {i: f"p{i}" for i in range(1, 9)} | {3: "new"}
    t.change(rows.limit(0), spark.createDataFrame([(3,), (4,)], "event_id long"))
    assert {r.event_id for r in t.rows().collect()} == {1, 2, 5, 6, 7, 8}
    with pytest.raises(ValueError):
        t.replace(spark.createDataFrame([(None, "x")], "event_id long, payload string"))
    with pytest.raises(Conflict):
        tables.RowPartitions(store, "events", "payload", 4).marker()
