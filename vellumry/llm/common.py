"""Session plumbing that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package, whatever the driver's own path."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the session names in spark.checkpoint.dir.

    Only where that setting is absent and the master is local (tests, a laptop) a folder of this machine is made, and deleted when the program ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not getattr(shared_dir, "own", ""):
            shared_dir.own = "file://" + tempfile.mkdtemp(prefix="vellumry-")
            atexit.register(shutil.rmtree, shared_dir.own[7:], ignore_errors=True)
        base = shared_dir.own
    # A path with no scheme lies where the session's own default says; other programs than the session must find it too.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if full.startswith("file:/") and not full.startswith("file://"):
        full = "file://" + full[5:]
    return f"{full.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df hasn't got (names compare without case, as Spark's do)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def checked(texts: DataFrame, most: int, what: str) -> None:
    """Raise a ValueError if the column text has more than `most` characters in all, before the driver gathers and broadcasts it."""
    n = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    if n > most:
        raise ValueError(f"{what} has {n} characters, of which {most} at most can be sent to every executor at once")


def lowest(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows of df whose `key` (64-bit hashes, evenly spread) belongs to the least ones that hold `rows` rows: at least that many, or all there are.

    A histogram of the hashes' upper 16 bits, of at most 65,536 numbers whatever the size of df, gives the bound; so nothing is sorted but what it lets through.
    """
    part = F.shiftright(F.col(key), 48)
    counts = sorted((r.p, r.n) for r in df.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = 0
    for p, n in counts:
        total += n
        if total >= rows:
            return df.where(part <= p)
    return df
