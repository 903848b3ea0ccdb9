"""Sessions with settings that fit content stores, and SQL over DataFrames without global names."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.cteRecursionRowLimit": "100000000",
}


_ROOT = str(Path(__file__).resolve().parents[1])


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers that share this file system import the package, whatever folder the driver runs in."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return spark


def open_session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS, then `settings` (dots as __). On a cluster the master comes from its own configuration."""
    b = SparkSession.builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    if master or "SPARK_MASTER" in os.environ:
        b = b.master(master or os.environ["SPARK_MASTER"])
    return reachable(b.getOrCreate())


def sql_over(statement: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The statement's rows, its table names bound to these DataFrames and to nothing else in the session."""
    first = next(iter(tables.values()))
    names = {t: f"v_{abs(id(df))}_{t}" for t, df in tables.items()}
    for t, df in tables.items():
        df.createOrReplaceTempView(names[t])
    body = ", ".join(f"{t} AS (SELECT * FROM {v})" for t, v in names.items())
    head, rest = ("WITH RECURSIVE ", statement[15:]) if statement[:15].upper() == "WITH RECURSIVE " else ("WITH ", statement)
    tail = rest[5:] if rest[:5].upper() == "WITH " else None
    text = f"{head}{body}, {tail}" if tail is not None else f"{head}{body}, {rest}" if head != "WITH " else f"WITH {body} {rest}"
    try:
        return first.sparkSession.sql(text)
    finally:
        for v in names.values():
            first.sparkSession.catalog.dropTempView(v)


_own: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, which all executors share.

    Only where that isn't set and the master is local (tests, a laptop) a folder of this machine is made, and deleted when the program ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="vellumry-"))
            atexit.register(shutil.rmtree, _own[0][7:], ignore_errors=True)
        base = _own[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: its lineage ends there, and lost executors cost nothing that came before."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
