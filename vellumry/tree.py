"""A tree of content files as a sink: what each post's file is called and holds, writing what changed, deleting what vanished, ids put into files that lack one.

Every step is a table: wanted files against present ones give receipts (path, change), and only changed files are touched, by the executors.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry.functions import text as fx
from vellumry.operators import documents, hierarchy, merge
from vellumry.session import written
from vellumry.sources import content_files
from vellumry.store import write_files

#: Rewrites with_details() rows before they become files, or file rows before they are written.
Hook = Callable[[DataFrame], DataFrame]


def paths_of(posts: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(ID, path) of the posts that have files: not of excluded types, no auto-drafts. A folder for the type, then the names of the ancestors that have files, too.

    A post without a name goes by its id; a post with children is the index of its folder.
    """
    kept = posts.where(F.coalesce(F.col("post_status") != "auto-draft", F.lit(True)))
    if excluded:
        kept = kept.where(~F.col("post_type").isin(*excluded))
    name = fx.slug(F.coalesce(F.nullif("post_name", F.lit("")), F.col("ID").cast("string")))
    nodes = kept.select("ID", F.nullif("post_parent", F.lit(0)).alias("post_parent"), name.alias("__name"), fx.slug(F.col("post_type")).alias("__type"))
    return hierarchy.expected_paths(nodes, "__name").join(nodes.select("ID", "__type"), "ID").select("ID", F.concat_ws("/", "__type", "path").alias("path"))


def files_of(posts: DataFrame, meta: DataFrame | None = None, terms: DataFrame | None = None, profile: str = "native", excluded: tuple[str, ...] = (), hook: Hook | None = None, paths: DataFrame | None = None) -> DataFrame:
    """(ID, path, file) of all posts that have files. hook: rewrites the rows before they are encoded. paths: (ID, path) of another layout; ids it leaves out have none."""
    rows = documents.with_details(posts, meta, terms)
    rows = hook(rows) if hook else rows
    where = paths_of(rows, excluded) if paths is None else paths.select("ID", "path")
    return rows.drop("path").join(where, "ID").select("ID", "path", documents.file_text(profile).alias("file"))


def index(files: DataFrame) -> DataFrame:
    """(path, digest) of (path, file) rows."""
    return files.select("path", F.sha2("file", 256).alias("digest"))


def present(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, digest) of the files that are there."""
    return content_files.raw_files(spark, root, excluded).select("path", F.sha2("raw", 256).alias("digest"))


def receipts(before: DataFrame, files: DataFrame) -> DataFrame:
    """(path, change): created, changed or deleted, from (path, digest) of what was and (path, file) of what is wanted; what is alike is left out."""
    return merge.key_changes(before, index(files), ["path"], "digest")


def write_changed(spark: SparkSession, root: str, before: DataFrame, files: DataFrame) -> DataFrame:
    """Make the tree hold `files` (path, file), given what it held `before` (path, digest), and return the receipts.

    New and changed files are written first, then vanished ones are deleted and folders that this leaves empty. Two rows of one path raise before anything is
    written. Running it again after a failure finishes the work.
    """
    files = written(files.select("path", "file"), "files")
    found = written(receipts(before, files), "receipts")
    write_files(files.join(found.where("change <> 'deleted'").select("path"), "path", "left_semi"), root)
    delete_files(found.where("change = 'deleted'").select("path"), root)
    return found.orderBy("change", "path")


def delete_files(paths: DataFrame, root: str) -> DataFrame:
    """(path, deleted) for each row of paths: the file is gone, and so are the folders above it that it leaves empty, up to root."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as afs

        fs, base = afs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for b in batches:
            done = []
            for path in b.column(0).to_pylist():
                full = f"{base}/{path}"
                there = fs.get_file_info(full).type == afs.FileType.File
                if there:
                    fs.delete_file(full)
                done.append(there)
                folder = full.rsplit("/", 1)[0]
                while len(folder) > len(base) and _emptied(fs, folder):
                    folder = folder.rsplit("/", 1)[0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.bool_())], names=["path", "deleted"])

    return written(paths.select("path").where(fx.safe_path(F.col("path"))).mapInArrow(drop, "path string, deleted boolean"), "deletions")


def _emptied(fs, folder: str) -> bool:
    """Whether the folder was empty and is now gone."""
    from pyarrow import fs as afs

    try:
        if fs.type_name == "local":
            os.rmdir(folder)  # fails unless empty
        elif fs.get_file_info(afs.FileSelector(folder)):
            return False
        else:
            fs.delete_dir(folder)
    except OSError:
        return False
    return True


def reclaim(spark: SparkSession, root: str, older: float = 3600.0) -> int:
    """Delete what writers that died left aside, *.tmp files older than so many seconds; how many there were."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tmp").load(root)
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("modificationTime")
    stale = found.where(age > older).select(content_files._relative(F.col("path"), root).alias("path"))
    return delete_files(stale, root).where("deleted").count()


def truncate(spark: SparkSession, root: str, post_type: str | None = None) -> DataFrame:
    """Delete the files of one type, or of all; (path, deleted)."""
    there = content_files.manifest(spark, root).select("path")
    return delete_files(there if post_type is None else there.where(F.split_part("path", F.lit("/"), F.lit(1)) == F.lit(post_type)), root)


def with_id(raw: Column, ident: Column) -> Column:
    """The file with this id in its frontmatter: in place of an id line that is there, else as the first line; a file without fences gets some. Nothing else changes."""
    line = F.concat(F.lit("id: "), ident.cast("string"))
    fenced = raw.rlike(r"(?s)\A---\n.*?\n---")
    has = raw.rlike(r"(?i)\A---\n(?:(?!---)[^\n]*\n)*?id\s*:")
    swapped = F.regexp_replace(raw, F.lit(r"(?i)\A(---\n(?:(?!---)[^\n]*\n)*?)id\s*:[^\n]*"), F.concat(F.lit("$1"), line))
    return F.when(has, swapped).when(fenced, F.concat(F.lit("---\n"), line, F.lit("\n"), F.substr(raw, F.lit(5)))).otherwise(F.concat(F.lit("---\n"), line, F.lit("\n---\n\n"), raw))


def read_files(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, mtime, size, raw) of the named files alone; those that are gone are left out. Folders aren't listed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as afs

        fs, base = afs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for b in batches:
            for path in b.column(0).to_pylist():
                info = fs.get_file_info(f"{base}/{path}")
                if info.type == afs.FileType.File:
                    with fs.open_input_stream(info.path) as f:
                        raw = f.read()
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([info.mtime_ns // 1_000_000 * 1000], pa.timestamp("us", "UTC")), pa.array([info.size], pa.int64()), pa.array([raw.decode("utf-8", "replace")])], names=["path", "mtime", "size", "raw"])

    return paths.select("path").where(fx.safe_path(F.col("path"))).mapInArrow(read, "path string, mtime timestamp, size long, raw string")


def inject_ids(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """Put ids (path, ID) into files; each is written aside and moved into place. Returns (path, size) of those written; ids below 1 and missing files are left out."""
    raw = read_files(spark, root, ids.where("ID > 0").select("path"))
    return write_files(raw.join(ids.select("path", "ID"), "path").select("path", with_id(F.col("raw"), F.col("ID")).alias("file")), root)


def migrate(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> dict[str, int]:
    """Rewrite native files as portable ones, each at its own path; how many were scanned, migrated and skipped (portable already), and how many weren't files of posts."""
    seen = written(content_files.raw_files(spark, root, excluded), "scanned")
    posts = content_files.parsed(seen)
    counts = posts.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("profile") == "native").alias("migrated"), F.count_if(F.col("profile") == "portable").alias("skipped")).first().asDict()
    old = posts.where("profile = 'native'")
    rows = documents.completed(old.withColumn("post_name", F.coalesce(F.nullif("post_name", F.lit("")), fx.slug_of_path(F.col("path")))))
    write_files(rows.select("path", documents.file_text("portable").alias("file")), root)
    return counts | {"malformed": seen.count() - counts["scanned"]}
