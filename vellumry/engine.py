"""A content store over a tree of files: opened cold or warm, changed, and flushed back.

All posts of one state are one generation of the table `posts`, with metadata and terms in it and the path, mtime and size of the file that each came from, so that a
generation is the file index, too, and readers see posts and index change together. `flushed` remembers what the tree holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry import tree
from vellumry.functions import text as fx
from vellumry.operators import content, dedup, documents, merge, reconcile
from vellumry.registry import FILES, LAYOUTS, Backend
from vellumry.session import reachable, written
from vellumry.sources import content_files
from vellumry.store import Conflict, Store

POSTS = [c for c, *_ in documents.COLUMNS] + ["meta", "terms", "tags", "path", "mtime", "size"]
_FILE = {"path": "string", "mtime": "timestamp", "size": "bigint"}


class Engine:
    """files: the tree's root. root: where generations are kept. excluded: types without files. layout: one of LAYOUTS. hooks: after_read and before_write rewrite rows
    that were read from files or are about to become files (converting their content, for one), on_flushed is told the receipts of a flush and on_failed what it raised,
    authorize(operation, rows) may raise."""

    def __init__(
        self,
        spark: SparkSession,
        files: str,
        root: str,
        profile: str = "native",
        excluded: tuple[str, ...] = (),
        backend: Backend = FILES,
        layout: str | None = None,
        after_read: tree.Hook | None = None,
        before_write: tree.Hook | None = None,
        on_flushed: Callable[[DataFrame], None] | None = None,
        on_failed: Callable[[Exception], None] | None = None,
        authorize: Callable[[str, DataFrame], None] | None = None,
    ):
        backend.require(("read",))
        self.layout, self.after_read = LAYOUTS.resolve(layout), after_read
        self.on_failed = on_failed
        self.spark, self.files, self.profile, self.excluded, self.backend = reachable(spark), files, profile, excluded, backend
        self.store, self.before_write, self.on_flushed, self.authorize = Store(spark, root), before_write, on_flushed, authorize

    def open(self) -> dict:
        """Load what the tree holds: everything if there is no generation yet, else what changed since."""
        return self.warm() if self.store.generation("posts") else self.cold()

    def _listed(self) -> DataFrame:
        """(path, mtime, size) of the files that count as content."""
        found = content_files.manifest(self.spark, self.files, self.excluded)
        return self.layout.sources(found) if self.layout.sources else found

    def _manifest(self) -> DataFrame:
        return written(self._listed(), "manifest")

    def _parsed(self, raw: DataFrame) -> DataFrame:
        raw = self.layout.sources(raw) if self.layout.sources else raw
        rows = content_files.parsed(raw, mapped=self.layout.slug)
        return self.after_read(rows) if self.after_read else rows

    def _paths(self, rows: DataFrame) -> DataFrame:
        """(ID, path) by the layout; a path that leads out of the tree raises."""
        found = self.layout.paths(rows, self.excluded).select("ID", "path") if self.layout.paths else tree.paths_of(rows, self.excluded)
        return found.withColumn("path", F.when(fx.safe_path(F.col("path")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no path in the tree: "), F.coalesce("path", F.lit("null"))))))

    def _unchanged(self, before: DataFrame) -> None:
        """Raise Conflict if the tree isn't what it was: a state that was read across a change is never published."""
        if not reconcile.manifest_diff(before, self._listed()).where("status <> 'unchanged'").isEmpty():
            raise Conflict("the tree changed while it was read")

    def _publish(self, posts: DataFrame, expected: int, **notes) -> int:
        return self.store.publish("posts", documents.with_details(posts).select(*POSTS), expected, **notes)

    def cold(self, write_ids: bool = True) -> dict:
        """All files as generation 1. Ids that were given to files without one are written into them. Whoever comes second uses the winner's generation."""
        seen = self._manifest()
        raw = written(self._parsed(content_files.raw_files(self.spark, self.files, self.excluded)), "parsed")
        posts = written(content_files.placed(raw), "posts")
        self._unchanged(seen)
        try:
            number = self._publish(posts, 0)
        except Conflict:
            return {"generation": self.store.generation("posts"), "cold": False}
        given = self._give_ids(raw, posts) if write_ids else 0
        self._mark_flushed()
        return {"generation": number, "cold": True, "posts": posts.count(), "ids_written": given}

    def _give_ids(self, raw: DataFrame, posts: DataFrame) -> int:
        """Ids into the files that had none; then the index takes these files' new times and sizes."""
        new = written(raw.where("ID IS NULL").select("path").join(posts.select("path", "ID"), "path"), "given")
        n = tree.inject_ids(self.spark, self.files, new).count() if not new.isEmpty() else 0
        if n:
            now = self.store.read("posts")
            fresh = tree.read_files(self.spark, self.files, new.select("path")).select("path", F.col("mtime").alias("__m"), F.col("size").alias("__s"))
            moved = now.join(fresh, "path", "left").withColumns({"mtime": F.coalesce("__m", "mtime"), "size": F.coalesce("__s", "size")})
            self._publish(moved, self.store.generation("posts"))
        return n

    def warm(self) -> dict:
        """Apply what changed in the tree since the last generation: only new and changed files are read; posts of vanished files go. Nothing is published if nothing
        changed; an index that can't be read is built anew."""
        base = self.store.generation("posts")
        try:
            old = self.store.read("posts", base)
            seen = self._manifest()
            diff = written(reconcile.manifest_diff(old.where("path IS NOT NULL").select(*_FILE), seen), "diff")
        except Exception as e:
            if isinstance(e, Conflict):
                raise
            return self._rebuilt(base)
        counts = {r.status: r.n for r in diff.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not set(counts) - {"unchanged"}:
            return {"generation": base, "cold": False} | counts
        changed = diff.where("status IN ('new', 'changed')").select("path")
        raw = written(self._parsed(tree.read_files(self.spark, self.files, changed)), "changed")
        stay = old.join(diff.where("status <> 'unchanged'").select("path"), "path", "left_anti")
        # Of a post that moved, the newest file counts, and its old row goes with the old path.
        fresh = dedup.newest_wins(raw, "ID", "mtime", "path")
        known = written(fresh.where("ID IS NOT NULL"), "known")
        stay = stay.join(known.select("ID"), "ID", "left_anti")
        least = old.agg(F.coalesce(F.max("ID"), F.lit(0))).first()[0]
        least = max(least, known.agg(F.coalesce(F.max("ID"), F.lit(0))).first()[0])
        given = dedup.assigned_ids(fresh.where("ID IS NULL").drop("ID"), least, "path").select(*known.columns)
        rows = known.unionByName(given)
        up = content_files.hierarchy.parents_of_paths(stay.where("path IS NOT NULL").select("ID", "path").unionByName(rows.select("ID", "path")))
        rows = rows.join(up, "ID", "left").withColumn("post_parent", F.when(F.col("declared_parent") > 0, F.col("declared_parent")).otherwise(F.coalesce("parent", F.lit(0))))
        rows = written(documents.with_details(rows).select(*POSTS), "rows")
        self._unchanged(seen)
        number = self._publish(stay.select(*POSTS).unionByName(rows), base)
        ids = self._give_ids(raw, rows)
        self._mark_flushed()
        return {"generation": number, "cold": False, "ids_written": ids} | counts

    def _rebuilt(self, base: int) -> dict:
        posts = written(content_files.placed(self._parsed(content_files.raw_files(self.spark, self.files, self.excluded))), "posts")
        number = self._publish(posts, base)
        self._mark_flushed()
        return {"generation": number, "cold": True, "posts": posts.count()}

    def posts(self) -> DataFrame:
        return self.store.read("posts")

    def status_of(self, ident: int) -> str | None:
        """The status of one post; None if there is none."""
        row = self.posts().where(F.col("ID") == ident).select("post_status").first()
        return row and row.post_status

    def next_id(self) -> int:
        return dedup.next_id(self.posts()).first().next_id

    def save(self, posts: DataFrame, meta: DataFrame | None = None, terms: DataFrame | None = None) -> int:
        """Posts in place of those of the same ID; their files follow at the next flush. Rows must name their ids. Of rows that share one the last written can't be
        told, so that raises, too. meta, terms: as in documents; where they aren't given, the metadata and terms that a post has stay."""
        self.backend.require(("write",))
        rows = written(documents.with_details(posts, meta, terms), "saved")
        bad = rows.groupBy("ID").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR ID < 1").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0].n} rows are to be saved as {bad[0].ID}")
        if self.authorize:
            self.authorize("save", rows)
        base = self.store.generation("posts")
        old = self.posts() if base else documents.with_details(posts.limit(0)).withColumns({c: F.lit(None).cast(t) for c, t in _FILE.items()}).select(*POSTS)
        kept = old.select("ID", *[F.col(c).alias(f"__{c}") for c in (*_FILE, "meta", "terms", "tags")])
        rows = rows.drop(*_FILE).join(kept, "ID", "left").withColumns({c: F.col(f"__{c}") for c in _FILE})
        for c, given in (("meta", meta), ("terms", terms), ("tags", terms)):
            if given is None:
                rows = rows.withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}")))
        return self._publish(merge.upsert(old, rows.select(*POSTS), ["ID"]), base)

    def delete(self, ids: DataFrame) -> int:
        """Posts of these ids (ID) go; their files at the next flush."""
        self.backend.require(("write",))
        if self.authorize:
            self.authorize("delete", ids)
        return self._publish(self.posts().join(ids.select("ID").distinct(), "ID", "left_anti"), self.store.generation("posts"))

    def truncate(self, post_type: str | None = None) -> int:
        """All posts of a type, or all, go."""
        return self._publish(self.posts().where(F.lit(False) if post_type is None else F.col("post_type") != F.lit(post_type)), self.store.generation("posts"))

    def _state(self) -> DataFrame:
        """(ID, path, digest) of the posts that have files: where each belongs and what it says."""
        rows = documents.with_details(self.posts())
        return rows.select("ID", documents.receipt().alias("digest")).join(self._paths(rows), "ID").select("ID", "path", "digest")

    def _mark_flushed(self) -> None:
        """Remember what the tree holds: as its files lie now."""
        rows = documents.with_details(self.posts())
        self.store.publish("flushed", rows.where("path IS NOT NULL").select("ID", "path", documents.receipt().alias("digest")), of=self.store.generation("posts"))

    def flush(self) -> DataFrame:
        """_flush(), and what it raises is told to on_failed first."""
        try:
            return self._flush()
        except Exception as e:
            if self.on_failed:
                self.on_failed(e)
            raise

    def _flush(self) -> DataFrame:
        """Write the files of posts that changed since the tree was last read or written, move those whose place changed (a post that got children becomes its folder's
        index), delete the others' old ones. Returns (path, change): created, changed or deleted."""
        self.backend.require(("write",))
        state = written(self._state(), "state")
        last = self.store.read("flushed") if self.store.generation("flushed") else state.limit(0)
        found = written(merge.key_changes(last.select("path", F.concat_ws(":", "ID", "digest").alias("d")), state.select("path", F.concat_ws(":", "ID", "digest").alias("d")), ["path"], "d"), "changes")
        dirty = found.where("change <> 'deleted'").select("path")
        rows = documents.with_details(self.posts()).drop("path").join(state.select("ID", "path").join(dirty, "path", "left_semi"), "ID")
        rows = self.before_write(rows) if self.before_write else rows
        tree.write_files(rows.select("path", documents.file_text(self.profile).alias("file")), self.files)
        tree.delete_files(found.where("change = 'deleted'").select("path"), self.files)
        # The index follows: paths as they are now, times and sizes of the files just written.
        now = tree.read_files(self.spark, self.files, dirty).select("path", F.col("mtime").alias("__m"), F.col("size").alias("__s"))
        moved = self.posts().drop("path").join(state.select("ID", "path"), "ID", "left").join(now, "path", "left")
        moved = moved.withColumns({"mtime": F.coalesce("__m", "mtime"), "size": F.coalesce("__s", "size")})
        self._publish(moved, self.store.generation("posts"))
        self._mark_flushed()
        receipts = found.orderBy("change", "path")
        if self.on_flushed:
            self.on_flushed(receipts)
        return receipts

    def identity(self) -> tuple[int, int]:
        """How many posts there are, and a digest of their content."""
        rows = documents.with_details(self.posts())
        return tuple(reconcile.store_digest(rows.select("ID", documents.receipt().alias("d")), F.col("ID"), F.col("d")).first())

    def health(self) -> dict:
        """Whether posts and files agree: how many are on both sides and on one, and how many changes wait for a flush."""
        here = self._listed().select("path")
        counts = content.audit(self.posts().where("path IS NOT NULL").select("path"), here, "path").first().asDict()
        waiting = self.store.generation("posts") - self.store.notes("flushed").get("of", 0)
        return counts | {"generation": self.store.generation("posts"), "generations_to_flush": waiting}
