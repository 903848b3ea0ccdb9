"""Trees of Markdown files, JSON tables and options as DataFrames, and a reader for SQLite databases left behind.

Folders whose names begin with _ are no content: Spark skips them when it lists a tree, and they are named directly when they are wanted.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumry.functions import text as fx
from vellumry.functions import yamlish
from vellumry.operators import dedup, documents, hierarchy
from vellumry.session import reachable, shared_folder, written

_FENCED = r"(?s)\A---\n(.+?)\n---\n\n?(.*)\z"


def manifest(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, mtime, size) of every .md file below root, without reading it; `excluded` are top folders, that is, content types, to leave out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    found = files.select(_relative(F.col("path"), root).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return found.where(~F.split_part("path", F.lit("/"), F.lit(1)).isin(*excluded)) if excluded else found


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _relative(path: Column, root: str) -> Column:
    plain = root.split("://", 1)[-1].rstrip("/")
    return F.regexp_replace(path, r"^(?:[a-z0-9]+:)?/*\Q" + plain.lstrip("/") + r"\E/", "")


def raw_files(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, mtime, size, raw): whole texts; columns that a query doesn't use cost nothing but the read itself."""
    files = reachable(spark).read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    m = "_metadata"
    found = files.select(_relative(F.col(f"{m}.file_path"), root).alias("path"), F.col(f"{m}.file_modification_time").alias("mtime"), F.col(f"{m}.file_size").alias("size"), F.col("value").alias("raw"))
    return found.where(~F.split_part("path", F.lit("/"), F.lit(1)).isin(*excluded)) if excluded else found


def parsed(files: DataFrame, reach: int | None = None, mapped: Callable[[Column], Column] | None = None) -> DataFrame:
    """Posts of raw files, with all columns of documents.COLUMNS, metadata, terms and profile, and path, mtime, size, frontmatter (JSON) and declared_parent.

    ID is null where none is declared. The type is the declared one, else the top folder; the name the declared slug, else the file's. A file without fences, or with
    nothing between them, is malformed and left out. One line feed at the body's end belongs to the file, not to the body. reach: how far into a file its
    id is looked for (None: the whole frontmatter). mapped: a layout's rule from path to slug.
    """
    front = F.regexp_extract("raw", _FENCED, 1)
    x = files.where(F.col("raw").rlike(_FENCED)).withColumn("frontmatter", yamlish.decoded_json(front)).where("frontmatter IS NOT NULL")
    x = x.withColumn("post_content", F.regexp_replace(F.regexp_extract("raw", _FENCED, 2), r"\n\z", ""))
    found = documents.posts_of(x)
    slug = mapped(F.col("path")) if mapped else F.coalesce(F.nullif("post_name", F.lit("")), fx.slug_of_path(F.col("path")))
    declared = lambda k: F.coalesce(F.get_json_object("frontmatter", f"$.wordpress.{k}"), F.when(F.col("profile") == "native", F.get_json_object("frontmatter", f"$.{k}")))
    return found.withColumns(
        {
            "ID": F.nullif(F.coalesce(declared("id").try_cast("bigint"), fx.header_id(F.col("raw"), reach)) if reach is None else fx.header_id(F.col("raw"), reach), F.lit(0)),
            "post_type": F.coalesce(declared("type"), F.split_part("path", F.lit("/"), F.lit(1))),
            "post_status": F.coalesce(declared("status"), F.lit("publish")),
            "post_name": slug,
            "declared_parent": F.col("post_parent"),
            "source_identity": F.coalesce(F.nullif("source_identity", F.lit("")), F.col("path")),
        }
    ).drop("raw", "post_parent")


def posts(spark: SparkSession, root: str, excluded: tuple[str, ...] = (), assign: bool = True, least_id: int = 0) -> DataFrame:
    """All posts: newest of each ID, ids for files that declare none, parents from folders where none is declared."""
    return placed(parsed(raw_files(spark, root, excluded)), assign, least_id)


def placed(found: DataFrame, assign: bool = True, least_id: int = 0) -> DataFrame:
    """parsed() rows with one row for each ID, the newest, ids above all others and least_id for rows without, and post_parent: declared, or the index of the folder."""
    found = written(dedup.newest_wins(found, "ID", "mtime", "path"), "parsed")
    if assign:
        start = max(least_id, found.agg(F.coalesce(F.max("ID"), F.lit(0))).first()[0])
        new = dedup.assigned_ids(found.where("ID IS NULL").drop("ID"), start, "path").select(*found.columns)
        found = found.where("ID IS NOT NULL").unionByName(new)
    up = hierarchy.parents_of_paths(found.select("ID", "path"))
    return found.join(up, "ID", "left").withColumn("post_parent", F.when(F.col("declared_parent") > 0, F.col("declared_parent")).otherwise(F.coalesce("parent", F.lit(0)))).drop("parent", "declared_parent")


def headers(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """posts without bodies."""
    return parsed(raw_files(spark, root, excluded)).drop("post_content")


def json_rows(spark: SparkSession, path: str, schema: T.StructType, rows_per_line: bool = False) -> DataFrame | None:
    """Rows of a JSON array (one file is one task) or of JSON lines. An empty file has none; a missing one gives None."""
    if not exists(spark, path):
        return None
    return spark.read.schema(schema).option("multiLine", not rows_per_line).option("mode", "FAILFAST").json(path)


OPTION = T.StructType([T.StructField("option_id", T.LongType()), T.StructField("option_name", T.StringType()), T.StructField("option_value", T.StringType()), T.StructField("autoload", T.StringType())])


def options(spark: SparkSession, folder: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """One JSON file per option, in order of their ids; files that hold none are skipped. names: these options alone."""
    found = spark.read.schema(OPTION).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder).where("option_name IS NOT NULL")
    return (found if names is None else found.where(F.col("option_name").isin(*names))).orderBy("option_id")


def sqlite_rows(spark: SparkSession, file: str, statement: str, schema: T.StructType, batch: int = 10_000) -> DataFrame:
    """Rows of a SQLite database that one machine holds, for recovery. The driver reads them, as the file format demands, `batch` at a time; each batch goes to the
    shared folder before the next is read, so no more than one is held."""
    folder = shared_folder(spark, "sqlite")
    with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
        rows = db.execute(statement)
        while part := rows.fetchmany(batch):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], schema)
