"""Tables as files beside the content: JSON snapshots, one file per option, schemas, and tables kept in row partitions."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumry.functions import text as fx
from vellumry.operators import merge
from vellumry.session import written
from vellumry.sources.content_files import exists
from vellumry.store import Conflict, Store, write_files

_TYPES = {"bigint": T.LongType, "int": T.IntegerType, "integer": T.IntegerType, "mediumint": T.IntegerType, "smallint": T.ShortType, "tinyint": T.ByteType, "double": T.DoubleType, "real": T.DoubleType, "float": T.FloatType, "boolean": T.BooleanType, "blob": T.BinaryType, "longblob": T.BinaryType, "varbinary": T.BinaryType}
_NO_COLUMN = ("primary", "unique", "key", "index", "fulltext", "spatial", "constraint", "foreign", "check")


def write_snapshot(store: Store, name: str, rows: DataFrame, hook=None) -> dict:
    """The whole table as JSON lines, a new generation of it, with the number and a digest of its rows in the marker; hook rewrites the rows first."""
    rows = hook(rows) if hook else rows
    columns = rows.columns
    lines = written(rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line")), "lines")
    h = F.conv(F.left(F.sha2("line", 256), F.lit(15)), 16, 10).cast("bigint")
    seen = lines.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("digest")).first().asDict()
    return {"generation": store.publish(name, lines, schema=rows.schema.json(), **seen)} | seen


def read_snapshot(store: Store, name: str) -> DataFrame | None:
    """The table's rows; None if it was never written. A snapshot whose rows don't match its digest raises."""
    notes = store.notes(name)
    if not notes:
        return None
    lines = store.read(name)
    h = F.conv(F.left(F.sha2("line", 256), F.lit(15)), 16, 10).cast("bigint")
    seen = lines.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("digest")).first().asDict()
    if any(notes[k] != seen[k] for k in seen):
        raise Conflict(f"the snapshot of {name} isn't what was written")
    schema = T.StructType.fromJson(json.loads(notes["schema"]))
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def option_files(options: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """(path, file) of each option that lasts; `names` are ephemeral ones beside the known prefixes."""
    kept = options.where(~fx.is_ephemeral(F.col("option_name"), names=names))
    return kept.select(fx.option_filename(F.col("option_name")).alias("path"), F.concat(F.to_json(F.struct("option_id", "option_name", "option_value", "autoload"), {"ignoreNullFields": "false"}), F.lit("\n")).alias("file"))


def write_options(spark: SparkSession, folder: str, options: DataFrame, names: tuple[str, ...] = (), dirty: DataFrame | None = None) -> DataFrame:
    """Make the folder hold one file per lasting option; files of vanished options go. dirty: option_names that alone may have changed. Returns (path, change)."""
    from vellumry import tree

    present = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json") if exists(spark, folder) else spark.createDataFrame([], "value string").withColumn("_none", F.lit(None))
    before = (present.select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("path"), F.sha2("value", 256).alias("digest")) if "_none" not in present.columns else present.select(F.lit("").alias("path"), F.lit("").alias("digest"))).where("path <> ''")
    files = option_files(options, names)
    if dirty is not None:
        touched = dirty.select(fx.option_filename(F.col("option_name")).alias("path")).distinct()
        before, files = before.join(touched, "path", "left_semi"), files.join(touched, "path", "left_semi")
    return tree.write_changed(spark, folder, written(before, "options"), files)


def columns_of(statement: str) -> tuple[str, T.StructType] | None:
    """The table and columns of a CREATE TABLE statement; None for any other. Types that aren't known are strings."""
    m = re.match(r"\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?(\w+)[`\"]?\s*\((.*)\)[^)]*$", statement, re.I | re.S)
    if not m:
        return None
    fields, depth, part = [], 0, ""
    for c in m[2] + ",":
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            w = part.split()
            if len(w) > 1 and w[0].strip("`\"").lower() not in _NO_COLUMN:
                kind = _TYPES.get(re.match(r"\w+", w[1])[0].lower(), T.StringType) if re.match(r"\w+", w[1]) else T.StringType
                fields.append(T.StructField(w[0].strip("`\""), kind(), "NOT NULL" not in part.upper()))
            part = ""
        else:
            part += c
    return m[1], T.StructType(fields)


class Schemas:
    """Statements that make tables, one file for each table, as JSON (table, statement, indexes)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def save(self, statements: list[str]) -> list[str]:
        """Keep CREATE TABLE and CREATE INDEX statements; DROP TABLE takes a table's file away. Returns the tables touched; other statements are ignored."""
        known, touched = {r["table"]: r for r in self.scan()}, []
        for s in statements:
            if made := columns_of(s):
                known[made[0]] = {"table": made[0], "statement": _absent(s), "indexes": known.get(made[0], {}).get("indexes", [])}
                touched.append(made[0])
            elif m := re.match(r"\s*CREATE\s+(?:UNIQUE\s+)?INDEX\b.*?\bON\s+[`\"]?(\w+)", s, re.I | re.S):
                if m[1] in known and _absent(s) not in known[m[1]]["indexes"]:
                    known[m[1]]["indexes"].append(_absent(s))
                    touched.append(m[1])
            elif m := re.match(r"\s*DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?[`\"]?(\w+)", s, re.I):
                if known.pop(m[1], None):
                    touched.append(m[1])
        from vellumry import tree

        rows = [(f"{t}.json", json.dumps(r, sort_keys=True)) for t, r in known.items() if t in touched]
        if rows:
            write_files(self.spark.createDataFrame(rows, "path string, file string"), self.folder)
        gone = [(f"{t}.json",) for t in touched if t not in known]
        if gone:
            tree.delete_files(self.spark.createDataFrame(gone, "path string"), self.folder)
        return sorted(set(touched))

    def scan(self) -> list[dict]:
        """All kept schemas, by table."""
        if not exists(self.spark, self.folder):
            return []
        rows = self.spark.read.text(self.folder, wholetext=True, pathGlobFilter="*.json").collect()
        return sorted((json.loads(r.value) for r in rows), key=lambda r: r["table"])

    def replay(self) -> dict[str, T.StructType]:
        """The columns of each table. Indexes have no counterpart here."""
        return {t: s for t, s in (columns_of(r["statement"]) for r in self.scan())}


def _absent(statement: str) -> str:
    return re.sub(r"(?i)^\s*CREATE\s+(TABLE|(?:UNIQUE\s+)?INDEX)\s+(?!IF\s+NOT\s+EXISTS)", r"CREATE \1 IF NOT EXISTS ", statement.strip())


class RowPartitions:
    """A table kept in buckets of its identity column, so that a change of few rows rewrites few buckets. The marker names the version, the column and the folders."""

    VERSION = 1

    def __init__(self, store: Store, name: str, identity: str, buckets: int = 64):
        self.store, self.name, self.identity, self.buckets = store, name, identity, buckets
        self.folder = store._folder(f"{name}.rows")

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.identity).cast("string")), F.lit(self.buckets)).cast("int")

    def marker(self) -> dict | None:
        record = self.folder.latest()[1]
        if record and (record["version"] != self.VERSION or record["identity"] != self.identity or record["buckets"] != self.buckets):
            raise Conflict(f"{self.name} is kept as version {record['version']} by {record['identity']} in {record['buckets']} buckets")
        return record

    def _write(self, rows: DataFrame) -> dict[str, str]:
        data = f"r-{uuid.uuid4().hex}"
        placed = rows.withColumn("__bucket", self._bucket())
        placed.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder.path}/{data}")
        found = self.folder.fs.listStatus(self.folder._at(f"{self.folder.path}/{data}"))
        return {s.getPath().getName().split("=")[1]: f"{data}/{s.getPath().getName()}" for s in found if s.getPath().getName().startswith("__bucket=")}

    def replace(self, rows: DataFrame) -> int:
        """A whole new generation; rows without an identity raise."""
        if not rows.where(F.col(self.identity).isNull()).isEmpty():
            raise ValueError(f"a row of {self.name} has no {self.identity}")
        number = self.folder.latest()[0]
        return self._put(number, rows.schema.json(), self._write(rows))

    def change(self, rows: DataFrame, ids: DataFrame) -> int:
        """`rows` in place of those whose identity is in `ids`: only their buckets are rewritten, the other folders are shared with the generation before."""
        number, record = self.folder.latest()[0], self.marker()
        touched = [str(r.b) for r in ids.select(self._bucket().alias("b")).distinct().collect()]
        old = self.rows(touched)
        kept = old.join(ids.select(self.identity).distinct(), self.identity, "left_anti")
        folders = {b: f for b, f in record["folders"].items() if b not in touched}
        return self._put(number, record["schema"], folders | self._write(kept.unionByName(rows.join(ids.select(self.identity).distinct(), self.identity, "left_semi"))))

    def _put(self, number: int, schema: str, folders: dict[str, str]) -> int:
        self.folder.put(number + 1, {"version": self.VERSION, "identity": self.identity, "buckets": self.buckets, "schema": schema, "folders": folders})
        return number + 1

    def rows(self, buckets: list[str] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        record = self.marker()
        if record is None:
            raise FileNotFoundError(f"{self.name} has no generation")
        schema = T.StructType.fromJson(json.loads(record["schema"]))
        paths = [f"{self.folder.path}/{f}" for b, f in record["folders"].items() if buckets is None or b in buckets]
        spark = self.store.spark
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def persisted(rows: DataFrame, suffix: str, posts: DataFrame, owners: dict[str, str], content_types: tuple[str, ...]) -> DataFrame:
    """The rows of a table that its snapshot keeps: of posts those of other than content types, of tables in `owners` (table: column) those whose post has no file."""
    if suffix == "posts":
        return rows.where(~F.col("post_type").isin(*content_types))
    if suffix in owners:
        return merge.without_owned(rows, owners[suffix], posts.where(F.col("post_type").isin(*content_types)))
    return rows
