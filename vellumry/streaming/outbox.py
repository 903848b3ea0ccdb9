"""The outbox as a stream: committed events only, each handled once, failures set aside."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from vellumry.operators.outbox import Fold
from vellumry.session import written

LOG = "session long, seq long, action string, savepoint string, event long, ts timestamp"


def log_stream(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Rows of LOG from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def committed_stream(log: DataFrame, idle: int | None = None) -> DataFrame:
    """(session, event) of committed events. State per session is what its open transaction holds; sessions at rest keep none. idle: after so many seconds to which
    nothing came a transaction is rolled back, so that no session left open is held for ever; for streams that run on, as one that ends when its input does would wait
    for its timers."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out: list[int] = []
        if state.hasTimedOut:
            state.remove()
        else:
            own = Fold(json.loads(state.get[0]) if state.exists else None)
            rows = pd.concat(list(batches)).sort_values("seq")
            for action, point, event in zip(rows["action"], rows["savepoint"], rows["event"]):
                out += own.push(action, point, None if pd.isna(event) else int(event))
            if own.open:
                state.update((json.dumps(own.held()),))
                if idle:
                    state.setTimeoutDuration(idle * 1000)
            elif state.exists:
                state.remove()
        yield pd.DataFrame({"session": [key[0]] * len(out), "event": out}).astype({"session": "int64", "event": "int64"})

    return log.groupBy("session").applyInPandasWithState(run, "session long, event long", "own string", "append", "ProcessingTimeTimeout" if idle else "NoTimeout")


def handed(batch: DataFrame, handle: Callable[[DataFrame], None], bit: int = 0) -> list[tuple[DataFrame, str]]:
    """Hand rows over; where that fails, in halves by a hash of the row, down to what can't be parted. Returns what failed at last, with its error.

    So one bad record takes none of its batch with it; `handle` may see rows again and should key by id.
    """
    try:
        handle(batch)
        return []
    except Exception as e:
        if bit >= 48 or len(batch.limit(2).collect()) < 2:
            return [(batch, f"{type(e).__name__}: {e}"[:1000])]
        half = F.shiftright(F.xxhash64(*batch.columns), bit).bitwiseAND(1)
        parts = [batch.where(half == v) for v in (0, 1)]
        return [x for p in parts if not p.isEmpty() for x in handed(p, handle, bit + 1)]


def deliver(events: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str, dead_letters: str, once: bool = False) -> StreamingQuery:
    """Hand each micro-batch to `handle`; records that it can't take go to dead_letters with the error, and the stream goes on. redeliver() tries them again.

    A batch may come again after a failure of the driver: its folder among the dead letters is then overwritten, and `handle` should key by id.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            failed = [rows.withColumn("error", F.lit(error)) for rows, error in handed(batch, handle)]
            if failed:
                reduce(DataFrame.unionByName, failed).write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def redeliver(spark: SparkSession, dead_letters: str, handle: Callable[[DataFrame], None]) -> int:
    """Hand the dead letters over again and keep only those that fail again; how many are left."""
    old = written(spark.read.parquet(dead_letters).drop("batch", "error"), "letters")
    failed = [rows.withColumn("error", F.lit(error)) for rows, error in handed(old, handle)]
    left = written(reduce(DataFrame.unionByName, failed) if failed else old.limit(0).withColumn("error", F.lit("")), "letters")
    left.withColumn("batch", F.lit(-1)).write.mode("overwrite").partitionBy("batch").parquet(dead_letters)
    return left.count()


def windowed_counts(log: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, action, n): counts per time window; rows later than `late` behind the newest are left out."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "action").agg(F.count(F.lit(1)).alias("n"))
