"""Tables as numbered generations, content files as a sink, and a journal of durable operations.

A generation is a folder of Parquet that is never changed. What makes it current is a marker file with the next number, created only if nobody else has
created it: that is compare-and-swap, so two writers can't both win, and a reader sees one generation or the other whole.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry.operators import merge, reconcile
from vellumry.session import written


class Conflict(RuntimeError):
    """Somebody else changed it first."""


class Folder:
    """Numbered records below a path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self.fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at(self.path))]
        return sorted(int(n[2:-5]) for n in names if n.startswith("m-") and n.endswith(".json"))

    def put(self, number: int, record: dict) -> None:
        """Create record `number`, whole or not at all; Conflict if it exists. Other errors pass through.

        It is written under a name of its own and then renamed without overwriting, so no reader meets an empty one. The path must lie on a file system whose
        rename is atomic (a local or distributed one, not an object store).
        """
        final, aside = self._at(f"{self.path}/m-{number:020d}.json"), self._at(f"{self.path}/_{uuid.uuid4().hex}.tmp")
        out = self.fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        finally:
            out.close()
        try:
            if not self._linked(aside, final):
                raise Conflict(f"record {number} of {self.path} exists")
        finally:
            self.fs.delete(aside, False)

    def _linked(self, aside, final) -> bool:
        """Rename without overwriting. A local rename overwrites, so there the file is hard-linked, which fails if the name is taken."""
        if self.fs.getScheme() == "file":
            try:
                os.link(aside.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not self.fs.exists(final) and bool(self.fs.rename(aside, final))

    def get(self, number: int) -> dict:
        """Record `number`, read through the file system, without a Spark job."""
        stream = self.fs.open(self._at(f"{self.path}/m-{number:020d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        n = self.numbers()
        return (n[-1], self.get(n[-1])) if n else (0, None)


class Store:
    """Named tables below a root. read() resolves the marker once; publish() makes a new generation."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.root}/{name}")

    def generation(self, name: str) -> int:
        return self._folder(name).latest()[0]

    def read(self, name: str, generation: int | None = None) -> DataFrame:
        folder = self._folder(name)
        record = folder.latest()[1] if generation is None else folder.get(generation)
        if record is None:
            raise FileNotFoundError(f"{name} has no generation")
        return self.spark.read.parquet(f"{folder.path}/{record['data']}")

    def publish(self, name: str, rows: DataFrame, expected: int | None = None, partition_by: tuple[str, ...] = (), **notes) -> int:
        """Write rows and make them current. expected: the generation that they were made from; Conflict if another has come since. notes: kept in the marker."""
        folder = self._folder(name)
        base = folder.latest()[0] if expected is None else expected
        data = f"g-{uuid.uuid4().hex}"
        rows.write.partitionBy(*partition_by).parquet(f"{folder.path}/{data}")
        try:
            folder.put(base + 1, {"data": data, "at": time.time()} | notes)
        except Conflict:
            folder.fs.delete(folder._at(f"{folder.path}/{data}"), True)
            raise
        return base + 1

    def notes(self, name: str) -> dict:
        """What the current generation's marker says; empty if there is none."""
        return self._folder(name).latest()[1] or {}

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> int:
        at = self.generation(name)
        return self.publish(name, merge.upsert(self.read(name, at), rows, keys) if at else rows, at)

    def prune(self, name: str, keep: int = 2) -> int:
        """Delete the data of all but the last `keep` generations; markers stay."""
        folder = self._folder(name)
        old = folder.numbers()[:-keep]
        return sum(bool(folder.fs.delete(folder._at(f"{folder.path}/{folder.get(n)['data']}"), True)) for n in old)

    def changes(self, name: str, old: int, new: int, keys: list[str], value: str) -> DataFrame:
        return merge.key_changes(self.read(name, old), self.read(name, new), keys, value)

    def identity(self, name: str, *columns: str) -> tuple[int, int]:
        return tuple(reconcile.store_digest(self.read(name), *map(F.col, columns)).first())


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write (path, file) rows as text files below root, in parallel; each is written aside and then moved, so readers never see half of one.

    Returns (path, size), written as a table first, so the files are there when this returns. Paths that repeat raise before anything is written.
    """
    twice = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two rows want {twice[0].path}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as afs

        fs, base = afs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for b in batches:
            size = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                full = f"{base}/{path}"
                fs.create_dir(full.rsplit("/", 1)[0], recursive=True)
                aside = f"{full}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(aside) as out:
                    out.write(data := text.encode())
                fs.move(aside, full)
                size.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64())], names=["path", "size"])

    return written(rows.select("path", "file").mapInArrow(write, "path string, size long"), "receipts")


STATES = ("planned", "claimed", "applied", "completed", "reconciliation_required")
_NEXT = {"planned": ("claimed",), "claimed": ("claimed", "applied", "reconciliation_required"), "applied": ("completed", "reconciliation_required", "claimed"), "completed": (), "reconciliation_required": ()}


class Journal:
    """Durable operations: every change of one is its next numbered record, so a change made from an outdated one conflicts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, ident: str) -> Folder:
        return Folder(self.spark, f"{self.root}/{ident}")

    def plan(self, ident: str, binding: dict) -> dict:
        """A new operation, or the one that is there if it binds the same; Conflict if it binds something else."""
        revision, record = self._folder(ident).latest()
        if record is None:
            record = {"id": ident, "binding": binding, "state": "planned", "revision": 1, "fence": 0, "owner": None, "lease": 0.0, "evidence": None}
            self._folder(ident).put(1, record)
        elif record["binding"] != binding:
            raise Conflict(f"{ident} is planned for something else")
        return record

    def get(self, ident: str) -> dict | None:
        return self._folder(ident).latest()[1]

    def idents(self) -> list[str]:
        """All operations."""
        folder = self._folder("")
        at = folder._at(self.root)
        return sorted(s.getPath().getName() for s in folder.fs.listStatus(at) if s.isDirectory()) if folder.fs.exists(at) else []

    def _move(self, record: dict, **to) -> dict:
        new = record | to | {"revision": record["revision"] + 1}
        if new["state"] not in _NEXT[record["state"]]:
            raise ValueError(f"{record['state']} can't become {new['state']}")
        self._folder(record["id"]).put(new["revision"], new)
        return new

    def claim(self, ident: str, owner: str, now: float, seconds: float = 60) -> dict:
        """A lease with a higher fence than all before it; Conflict while another's lease lasts."""
        record = self.get(ident)
        if record["state"] in ("claimed", "applied") and record["owner"] != owner and record["lease"] > now:
            raise Conflict(f"{record['owner']} holds {ident}")
        return self._move(record, state="claimed", owner=owner, fence=record["fence"] + 1, lease=now + min(3600, max(1, seconds)))

    def advance(self, held: dict, state: str, now: float, evidence: dict | None = None) -> dict:
        """The next state, for whoever still holds the lease: an outdated fence or an expired lease conflicts."""
        current = self.get(held["id"])
        if current["fence"] != held["fence"] or current["lease"] <= now:
            raise Conflict(f"the lease on {held['id']} is lost")
        return self._move(current, state=state, evidence=evidence)

    def recoverable(self, idents: list[str], now: float) -> list[dict]:
        """Operations that nobody finished and nobody holds."""
        found = [r for i in idents if (r := self.get(i))]
        return [r for r in found if r["state"] in ("planned", "claimed", "applied") and r["lease"] <= now]
