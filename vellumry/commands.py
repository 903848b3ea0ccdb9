"""What the command line offers, as functions that return plain dictionaries."""

from __future__ import annotations

from typing import TypedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumry import tree
from vellumry.engine import Engine
from vellumry.operators import documents, hierarchy
from vellumry.reconciliation import Reconciler
from vellumry.sources import content_files


class Recovered(TypedDict):
    candidates: list[int]
    imported: int
    skipped: int


def import_files(spark: SparkSession, files: str, store: str, excluded: tuple[str, ...] = ()) -> dict:
    """Load the tree, or what changed in it since the last time."""
    return Engine(spark, files, store, excluded=excluded).open()


def export_files(spark: SparkSession, files: str, store: str, profile: str = "native", excluded: tuple[str, ...] = ()) -> dict:
    """Write the store's posts as a tree, whatever it held before: how many files were created, changed and deleted."""
    posts = Engine(spark, files, store).posts()
    before = tree.present(spark, files) if content_files.exists(spark, files) else spark.createDataFrame([], "path string, digest string")
    found = tree.write_changed(spark, files, before, tree.files_of(posts, profile=profile, excluded=excluded))
    counts = {r.change: r.n for r in found.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {k: counts.get(k, 0) for k in ("created", "changed", "deleted")}


def reconcile(spark: SparkSession, files: str, store: str, apply: bool = False, plan_id: str | None = None, source_identity: str | None = None, **policy) -> dict:
    """The plan's identity and counts; with apply the plan is carried out, the reviewed one if its identity is given, else the one just made."""
    r = Reconciler(spark, files, store)
    plan = r.plan(**policy)
    if not apply:
        return {k: plan[k] for k in ("plan_id", "source_identity", "counts")}
    return r.apply(plan_id or plan["plan_id"], source_identity or plan["source_identity"], **policy)


def migrate(spark: SparkSession, files: str, excluded: tuple[str, ...] = ()) -> dict:
    """Rewrite native files as portable ones."""
    return tree.migrate(spark, files, excluded)


def doctor(spark: SparkSession, files: str, store: str) -> dict:
    """Whether store and tree agree."""
    e = Engine(spark, files, store)
    found = {"generation": e.store.generation("posts"), "files": content_files.manifest(spark, files).count(), "posts": 0}
    return found | (e.health() | {"posts": e.posts().count()} if found["generation"] else {})


def _left_behind(spark: SparkSession, database: str, table: str) -> DataFrame:
    kinds = {"bigint": T.LongType(), "string": T.StringType()}
    own = [(c, t) for c, t, _, f in documents.COLUMNS if c != "source_identity"]
    schema = T.StructType([T.StructField(c, kinds[t]) for c, t in own])
    if not table.isidentifier():
        raise ValueError(f"{table} is no table's name")
    return content_files.sqlite_rows(spark, database, f"SELECT {', '.join(c for c, _ in own)} FROM {table}", schema)


def recover(spark: SparkSession, files: str, store: str, root: int, least: int = 0, limit: int = 100, database: str | None = None, table: str = "wp_posts", dry: bool = True) -> Recovered:
    """Posts below `root` with an id of at least `least`, parents first, of the store or of a SQLite database left behind. Unless dry, those of the database that the
    store lacks are imported, with the ancestors below root that they need."""
    e = Engine(spark, files, store)
    nodes = _left_behind(spark, database, table) if database else e.posts()
    links = nodes.select("ID", F.nullif("post_parent", F.lit(0)).alias("post_parent"))
    found = [r.ID for r in hierarchy.recoverable(links, root, least, limit).collect()]
    if dry or not database or not found:
        return {"candidates": found, "imported": 0, "skipped": 0}
    chosen = spark.createDataFrame([(i,) for i in found], "ID long")
    below = hierarchy.descendants(links, root).select("ID")
    needed = chosen.unionByName(hierarchy.ancestors(links, chosen).select(F.col("ancestor").alias("ID"))).distinct().join(below, "ID", "left_semi")
    rows = nodes.join(needed, "ID", "left_semi")
    new = rows.join(e.posts().select("ID"), "ID", "left_anti") if e.store.generation("posts") else rows
    imported = new.count()
    if imported:
        e.save(new)
    return {"candidates": found, "imported": imported, "skipped": rows.count() - imported}
