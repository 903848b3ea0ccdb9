"""The outbox of change events: who may claim what, transitions as new generations, counters, and the fold of transactions with savepoints."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

STATES = ("pending", "leased", "failed", "acked", "diagnostic")


#: Columns of an outbox; others may stand behind them.
SCHEMA = "id bigint, state string, created_at timestamp_ntz, available_at timestamp_ntz, leased_until timestamp_ntz, worker_token string, lease_token string, attempts bigint, reclaims bigint, failures bigint, last_error string"


def validated(events: DataFrame) -> DataFrame:
    """events as they are; missing columns, other types and states that aren't known raise."""
    have = dict(events.dtypes)
    wrong = [f"{c} {t}" for c, t in (part.strip().rsplit(" ", 1) for part in SCHEMA.split(",")) if have.get(c) != t]
    if wrong:
        raise ValueError(f"an outbox needs {', '.join(wrong)}")
    known = F.coalesce(F.col("state").isin(*STATES), F.lit(False))
    return events.withColumn("state", F.when(known, F.col("state")).otherwise(F.raise_error(F.concat(F.lit("no such state: "), F.coalesce("state", F.lit("null"))))))


def eligible(now: Column) -> Column:
    waiting = F.col("state").isin("pending", "failed") & (F.col("available_at") <= now)
    return waiting | ((F.col("state") == "leased") & (F.col("leased_until") <= now))


def claimable(events: DataFrame, now: Column, n: int) -> DataFrame:
    return events.where(eligible(now)).orderBy("id").limit(n)


def claim(events: DataFrame, now: Column, worker: str, lease: str, n: int, seconds: int) -> DataFrame:
    """All events after the worker has claimed up to n of them, 1 to 1000. A worker with live leases gets none in addition."""
    if not 1 <= n <= 1000:
        raise ValueError("a claim takes 1 to 1000 events")
    seconds = min(3600, max(1, seconds))
    live = events.where((F.col("state") == "leased") & (F.col("worker_token") == worker) & (F.col("leased_until") > now)).agg(F.count(F.lit(1)).alias("__live"))
    chosen = claimable(events, now, n).select("id").crossJoin(F.broadcast(live)).where("__live = 0").select("id", F.lit(True).alias("__mine"))
    x = events.join(F.broadcast(chosen), "id", "left")
    mine = F.col("__mine").isNotNull()
    return x.withColumns(
        {
            "reclaims": F.when(mine & (F.col("state") == "leased"), F.col("reclaims") + 1).otherwise(F.col("reclaims")),
            "attempts": F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "leased_until": F.when(mine, now + F.expr(f"INTERVAL {seconds} SECONDS")).otherwise(F.col("leased_until")),
            "worker_token": F.when(mine, worker).otherwise(F.col("worker_token")),
            "lease_token": F.when(mine, lease).otherwise(F.col("lease_token")),
            "state": F.when(mine, "leased").otherwise(F.col("state")),
        }
    ).drop("__mine")


def _held(now: Column, ident: int, worker: str, lease: str) -> Column:
    return (F.col("id") == ident) & (F.col("state") == "leased") & (F.col("worker_token") == worker) & (F.col("lease_token") == lease) & (F.col("leased_until") > now)


def acknowledge(events: DataFrame, now: Column, ident: int, worker: str, lease: str) -> DataFrame:
    """An event is acknowledged by whoever holds its live lease; others change nothing."""
    ok = _held(now, ident, worker, lease)
    return _moved(events, ok, {"state": F.lit("acked")})


def fail(events: DataFrame, now: Column, ident: int, worker: str, lease: str, error: str, delay: int) -> DataFrame:
    ok = _held(now, ident, worker, lease)
    return _moved(events, ok, {"state": F.lit("failed"), "failures": F.col("failures") + 1, "last_error": F.lit(error), "available_at": now + F.expr(f"INTERVAL {int(delay)} SECONDS")})


def _moved(events: DataFrame, ok: Column, to: dict[str, Column]) -> DataFrame:
    to |= {c: F.lit(None) for c in ("leased_until", "lease_token", "worker_token")}
    kinds = dict(events.dtypes)
    # All columns change at once: conditions see the state before.
    return events.select(*[F.when(ok, to[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in to else F.col(c) for c in events.columns])


def counters(events: DataFrame, now: Column) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s).alias(s if s != "diagnostic" else "unsupported_boundaries")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    age = F.coalesce(F.max(F.timestamp_diff("SECOND", F.col("created_at"), now)), F.lit(0)).alias("oldest_age")
    return events.where("state <> 'acked'").agg(n("pending"), n("leased"), n("failed"), n("diagnostic"), total("attempts"), total("reclaims"), total("failures"), age)


class Fold:
    """A session's log, step by step: push() returns the events that the step commits. Only the open transaction's events are held.

    Outside a transaction an event stands at once. Rolling back to a mark drops what came after it and later marks; a rollback drops all that is open.
    """

    def __init__(self, held: dict | None = None):
        self.pending, self.marks, self.open = (held["pending"], held["marks"], held["open"]) if held else ([], {}, False)

    def held(self) -> dict:
        """What Fold() takes to go on from here."""
        return {"pending": self.pending, "marks": self.marks, "open": self.open}

    def push(self, action: str, point: str | None, event: object) -> list[object]:
        if action == "event":
            if not self.open:
                return [event]
            self.pending.append(event)
        elif action in ("begin", "commit", "commit_chain", "autocommit_1"):
            done = self.pending
            self.pending, self.marks, self.open = [], {}, action in ("begin", "commit_chain")
            return done
        elif action in ("rollback", "rollback_chain"):
            self.pending, self.marks, self.open = [], {}, action == "rollback_chain"
        elif action == "autocommit_0":
            self.open = True
        elif action == "savepoint":
            self.marks[point] = len(self.pending)
        elif action == "release_savepoint":
            self.marks.pop(point, None)
        elif action == "rollback_to" and point in self.marks:
            at = self.marks[point]
            del self.pending[at:]
            self.marks = {k: v for k, v in self.marks.items() if v <= at}
        return []


def fold(rows: list[tuple[str, str | None, object]]) -> list[object]:
    """Events that a whole log of one session leaves committed. rows: (action, savepoint, event)."""
    state = Fold()
    return [e for row in rows for e in state.push(*row)]


def _folded(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by session and seq, folded as they pass."""
    at, state = object(), Fold()
    for b in batches:
        sessions, events = [], []
        for session, action, point, event in zip(*(b.column(c).to_pylist() for c in ("session", "action", "savepoint", "event"))):
            if session != at:
                at, state = session, Fold()
            for e in state.push(action, point, event):
                sessions.append(session)
                events.append(e)
        yield pa.RecordBatch.from_arrays([pa.array(sessions, schema.field(0).type), pa.array(events, schema.field(1).type)], schema=schema)


def committed(log: DataFrame) -> DataFrame:
    """(session, event) from a log (session, seq, action, savepoint, event), each session folded in order of seq. What is still open at its end doesn't count.

    A session's log is a stream within one task, of which only the open transaction is held, however long the session is.
    """
    out = log.select("session", "event").schema
    arrow = to_arrow_schema(out)
    ordered = log.select("session", "seq", "action", "savepoint", "event").repartition("session").sortWithinPartitions("session", "seq")
    return ordered.mapInArrow(lambda it: _folded(arrow, it), out)


def normalized(events: DataFrame) -> DataFrame:
    """Events once per event_id, their tables sorted and distinct."""
    return events.withColumn("tables", F.array_sort(F.array_distinct("tables"))).dropDuplicates(["event_id"])


def fenced(claims: DataFrame) -> DataFrame:
    """(resource, fence, stale): the token that holds each resource, and how many older ones it shuts out."""
    return claims.groupBy("resource").agg(F.max("fence").alias("fence"), (F.count(F.lit(1)) - 1).alias("stale"))
