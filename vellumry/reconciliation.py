"""Two-way reconciliation of a tree of files with a store of posts, against the baseline that both agreed on last.

plan() says what would happen and gives it an identity; apply() takes that identity, refuses a plan whose sources have changed since, and carries it out. What is to
be done is written to the journal first, so that recover() can finish what a crash left half done: every step may run twice.
"""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry import tree
from vellumry.operators import documents, merge, reconcile
from vellumry.session import reachable, written
from vellumry.sources import content_files
from vellumry.store import Conflict, Journal, Store

SCHEMA_VERSION = 1
_ROW = [c for c, *_ in documents.COLUMNS] + ["meta", "terms", "tags"]


def _hashed(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def options(direction: str = "bidirectional", deletion: str = "preserve", preference: str = "none") -> dict:
    if direction not in reconcile.DIRECTIONS or deletion not in reconcile.DELETIONS or preference not in reconcile.PREFERENCES:
        raise ValueError(f"unknown policy: {direction}, {deletion}, {preference}")
    return {"direction": direction, "deletion": deletion, "preference": preference}


class Reconciler:
    def __init__(self, spark: SparkSession, files: str, root: str, profile: str = "native", excluded: tuple[str, ...] = ()):
        self.spark, self.files, self.profile, self.excluded = reachable(spark), files, profile, excluded
        self.store, self.journal = Store(spark, root), Journal(spark, f"{root.rstrip('/')}/operations")

    def _sides(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(ID, digest and all columns) of files and store, and the baseline (ID, digest)."""
        side = lambda rows: written(rows.withColumn("digest", documents.receipt()), "side")
        canonical = side(documents.with_details(content_files.posts(self.spark, self.files, self.excluded)))
        have = self.store.read("posts") if self.store.generation("posts") else canonical.limit(0)
        kept = have.where(~F.col("post_type").isin(*self.excluded)) if self.excluded else have
        stored = side(documents.with_details(kept))
        base = self.store.read("baseline") if self.store.generation("baseline") else canonical.limit(0).select("ID", "digest", "path")
        return canonical, stored, base

    def _entries(self, sides, opts: dict) -> DataFrame:
        canonical, stored, base = sides
        states = reconcile.three_way(canonical, stored, base, "ID")
        at = canonical.select("ID", F.col("path").alias("__at")).join(tree.paths_of(canonical, self.excluded).withColumnRenamed("path", "__to"), "ID", "left")
        states = states.join(at, "ID", "left").withColumns({"moved": F.coalesce(F.col("__at") != F.col("__to"), F.lit(False)), "move_direction": F.lit(opts["direction"]), "proven": F.col("b").isNotNull()})
        entries = reconcile.classify(states, opts["direction"], opts["deletion"], opts["preference"])
        return entries.select("ID", "c", "w", "b", "category", "reason", F.col("__at").alias("path"))

    def _source(self, sides) -> str:
        parts = [tuple(reconcile.store_digest(s, F.col("ID"), F.col("digest")).first()) for s in sides]
        return _hashed([SCHEMA_VERSION, self.files, [[int(n), int(d or 0)] for n, d in parts]])

    def plan(self, after: int | None = None, page: int | None = None, **policy) -> dict:
        """What would happen: plan_id, source_identity, counts of all categories, and entries (ID, category, reason, path), all or `page` (1 to 1000) of those above
        the id `after`, with the continuation that leads on."""
        opts = options(**policy)
        sides = self._sides()
        source = self._source(sides)
        entries = written(self._entries(sides, opts), "entries")
        out = {"source_identity": source, "plan_id": _hashed([SCHEMA_VERSION, source, opts]), "options": opts, "counts": {r.category: r.n for r in reconcile.category_counts(entries).collect()}}
        shown = entries if page is None else reconcile.keyset_page(entries, "ID", after, page)
        last = shown.agg(F.max("ID").alias("m")).first().m if page is not None else None
        more = last is not None and not entries.where(F.col("ID") > last).isEmpty()
        return out | {"entries": shown.select("ID", "category", "reason", "path"), "continuation": {"after": last, "identity": _hashed([out["plan_id"], last])} if more else None}

    def resume(self, continuation: dict, plan_id: str, page: int, **policy) -> dict:
        """The page that a continuation of this plan leads to; Conflict if it belongs to another plan or the sources have changed."""
        if continuation["identity"] != _hashed([plan_id, continuation["after"]]):
            raise Conflict("the continuation belongs to another plan")
        found = self.plan(continuation["after"], page, **policy)
        if found["plan_id"] != plan_id:
            raise Conflict("the plan is stale")
        return found

    def apply(self, plan_id: str, source_identity: str, owner: str = "local", now: float | None = None, **policy) -> dict:
        """Carry out a reviewed plan: files into the store, posts into files, deletions last, and the new baseline. Conflict if the plan isn't one of these sources."""
        opts = options(**policy)
        if plan_id != _hashed([SCHEMA_VERSION, source_identity, opts]):
            raise Conflict("the plan belongs to other sources or policies")
        self.recover(owner, now)
        sides = self._sides()
        if self._source(sides) != source_identity:
            raise Conflict("the sources have changed since the plan was made")
        canonical, stored, base = sides
        entries = written(self._entries(sides, opts), "entries")
        folder = f"{self.store.root}/intents/{plan_id}"
        nexts = reconcile.outcomes(entries)
        # What is to be: rows for the store, rows for files, and the baseline, written before anything is changed.
        chosen = lambda rows, way: rows.join(nexts.where(F.col("effect") == way).select("ID"), "ID", "left_semi")
        to_store = chosen(canonical, "to_store").select(*_ROW)
        to_files = chosen(stored, "to_files").select(*_ROW)
        gone = nexts.where("effect IN ('drop_from_store', 'drop_from_files')").select("ID", "effect", "path")
        for name, rows in (("to_store", to_store), ("to_files", to_files), ("gone", gone), ("baseline", nexts.where("next IS NOT NULL").select("ID", F.col("next").alias("digest"), "path")), ("moves", nexts.where("category = 'moved'").select("ID", "path"))):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        self.journal.plan(plan_id, {"intent": folder, "options": opts, "posts": self.store.generation("posts"), "baseline": self.store.generation("baseline")})
        self._carry_out(plan_id, owner, now)
        return {"plan_id": plan_id, "operation": self.journal.get(plan_id)["state"], "counts": {r.category: r.n for r in reconcile.category_counts(entries).collect()}}

    def _carry_out(self, ident: str, owner: str, now: float | None) -> None:
        clock = lambda: time.time() if now is None else now
        held = self.journal.claim(ident, owner, clock(), 3600)
        binding, read = held["binding"], lambda name: self.spark.read.parquet(f"{held['binding']['intent']}/{name}")
        try:
            self._into_store(binding, read, ident)
            self._into_files(read)
            if self.store.notes("baseline").get("operation") != ident:
                self.store.publish("baseline", read("baseline").select("ID", "digest", "path"), binding["baseline"], operation=ident)
        except Conflict as e:
            self.journal.advance(self.journal.get(ident), "reconciliation_required", clock(), {"conflict": str(e)})
            raise
        held = self.journal.advance(held, "applied", clock())
        self.journal.advance(held, "completed", clock())

    def _into_store(self, binding: dict, read, ident: str) -> None:
        """The next generation of posts, unless this operation has published it already; Conflict if another one has come."""
        if self.store.notes("posts").get("operation") == ident:
            return
        new, gone = read("to_store"), read("gone").where("effect = 'drop_from_store'").select("ID")
        extra = [c for c in (self.store.read("posts").columns if binding["posts"] else []) if c not in _ROW]
        old = self.store.read("posts", binding["posts"]) if binding["posts"] else new.limit(0)
        old = documents.with_details(old).select(*_ROW, *extra)
        if extra:
            new = new.join(old.select("ID", *extra), "ID", "left").select(*_ROW, *extra)
        self.store.publish("posts", merge.upsert(old, new, ["ID"]).join(gone, "ID", "left_anti"), binding["posts"], operation=ident)

    def _into_files(self, read) -> None:
        """Files of posts that the store has newer or that lie elsewhere than they belong; then deletions, the deepest first."""
        posts = documents.with_details(self.store.read("posts"))
        where = written(tree.paths_of(posts, self.excluded), "paths")
        moves, fresh = read("moves"), read("to_files").select("ID")
        rows = posts.drop("path").join(where, "ID").join(fresh.unionByName(moves.select("ID")).distinct(), "ID", "left_semi")
        files = rows.select("ID", "path", documents.file_text(self.profile).alias("file"))
        tree.write_files(files.select("path", "file"), self.files)
        # Where a file lay before: of moved posts, and of written ones whose place is another now.
        before = content_files.parsed(content_files.raw_files(self.spark, self.files, self.excluded)).where("ID IS NOT NULL").select("ID", "path")
        stale = before.join(files.select("ID", F.col("path").alias("__new")), "ID").where("path <> __new").select("path")
        tree.delete_files(stale.unionByName(read("gone").where("effect = 'drop_from_files' AND path IS NOT NULL").select("path")).distinct(), self.files)

    def recover(self, owner: str = "local", now: float | None = None) -> list[str]:
        """Finish the operations that nobody finished and nobody holds; their ids."""
        done = []
        for record in self.journal.recoverable(self.journal.idents(), time.time() if now is None else now):
            self._carry_out(record["id"], owner, now)
            done.append(record["id"])
        return done
