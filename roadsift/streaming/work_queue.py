"""A lease-based work queue: as a stream with state, and as a replay of a recorded stream.

Operations of a queue, in the order of (time, number): ``submit`` puts an item at the end;
``claim`` leases the oldest waiting item to a worker; ``beat`` renews the worker's oldest
lease, ``done`` ends it, ``fail`` gives it back.  Only the holder's operations count.  A
lease that is not renewed in time goes back to its old place in the queue; after
``most_attempts`` claims an item that comes back has failed instead.  Finished and failed
items leave the state; two counters stay.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.scans import ordered_scan

LEASE_US, MOST_ATTEMPTS = 86_400_000_000, 3
OUT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("queue", "number", "at")] + [T.StructField("op", T.StringType()), T.StructField("item", T.LongType())] + [T.StructField(n, T.LongType()) for n in ("waiting", "leased", "done", "failed")]
)


class Queue:
    """State of one queue; items are known by their number of arrival."""

    def __init__(self, lease: int = LEASE_US, most_attempts: int = MOST_ATTEMPTS):
        self.lease, self.most = lease, most_attempts
        self.waiting: list[tuple[int, int, int]] = []  # arrival, item, attempts: a heap
        self.held: dict[int, tuple[int, int, int, int]] = {}  # arrival: item, worker, until, attempts
        self.done = self.failed = 0

    def _back(self, arrival: int) -> None:
        item, _, _, attempts = self.held.pop(arrival)
        if attempts >= self.most:
            self.failed += 1
        else:
            heapq.heappush(self.waiting, (arrival, item, attempts))

    def reap(self, now: int) -> None:
        for arrival in [a for a, (_, _, until, _) in self.held.items() if until < now]:
            self._back(arrival)

    def apply(self, op: str, number: int, now: int, item: int | None, worker: int | None) -> int | None:
        """The item that the operation touched, if any."""
        self.reap(now)
        if op == "submit":
            heapq.heappush(self.waiting, (number, item if item is not None else number, 0))
            return item
        if op == "claim":
            if not self.waiting:
                return None
            arrival, own, attempts = heapq.heappop(self.waiting)
            self.held[arrival] = (own, worker, now + self.lease, attempts + 1)
            return own
        mine = [a for a, h in self.held.items() if h[1] == worker]
        if op not in ("beat", "done", "fail") or not mine:
            return None
        arrival = min(mine)
        own, _, _, attempts = self.held[arrival]
        if op == "beat":
            self.held[arrival] = (own, worker, now + self.lease, attempts)
        elif op == "done":
            del self.held[arrival]
            self.done += 1
        else:
            self._back(arrival)
        return own

    def counts(self) -> tuple[int, int, int, int]:
        return len(self.waiting), len(self.held), self.done, self.failed


def operations(events: DataFrame) -> DataFrame:
    """queue, number, at (microseconds), op, item, worker from an event table: users are queues, and three workers serve each."""
    kinds = {"signup": "submit", "purchase": "claim", "click": "beat", "view": "done", "error": "fail"}
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return events.select(
        F.col("user_id").cast("long").alias("queue"), F.col("event_id").cast("long").alias("number"), at.alias("at"), F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")].alias("op"),
        F.col("event_id").cast("long").alias("item"), (F.col("event_id") % 3).cast("long").alias("worker"), *[c for c in ("time",) if c in events.columns],
    )


def replay(ops: DataFrame, lease: int = LEASE_US, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """Every operation with the item it touched and the queue's counts after it, in one ordered scan."""

    def step(queue: Queue, row: dict[str, Any]) -> list[tuple]:
        touched = queue.apply(row["op"], row["number"], row["at"], row["item"], row["worker"])
        return [(row["queue"], row["number"], row["at"], row["op"], touched, *queue.counts())]

    return ordered_scan(ops.select("queue", "number", "at", "op", "item", "worker"), ["queue"], ["at", "number"], lambda: Queue(lease, most_attempts), step, OUT)


class QueueProcessor(StatefulProcessor):
    """The queue as a stateful stream: waiting items are list state, leases a map, counters a value; a timer reaps what no operation does."""

    def __init__(self, lease: int = LEASE_US, most_attempts: int = MOST_ATTEMPTS):
        self.lease, self.most = lease, most_attempts

    def init(self, handle) -> None:  # type: ignore[no-untyped-def]
        self.handle = handle
        self.waiting = handle.getListState("waiting", "arrival long, item long, attempts long")
        self.held = handle.getMapState("held", "arrival long", "item long, worker long, until long, attempts long")
        self.counters = handle.getValueState("counters", "done long, failed long")

    def _load(self) -> Queue:
        q = Queue(self.lease, self.most)
        q.waiting = [tuple(x) for x in self.waiting.get()]
        heapq.heapify(q.waiting)
        q.held = {k[0]: tuple(v) for k, v in self.held.iterator()}
        if self.counters.exists():
            q.done, q.failed = self.counters.get()
        return q

    def _save(self, q: Queue) -> None:
        if q.waiting:
            self.waiting.put(sorted(q.waiting))
        else:
            self.waiting.clear()
        for gone in [k for k in (x[0] for x in self.held.keys()) if k not in q.held]:
            self.held.removeKey((gone,))
        for arrival, lease in q.held.items():
            self.held.updateValue((arrival,), lease)
        self.counters.update((q.done, q.failed))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if q.held:
            self.handle.registerTimer(min(until for _, _, until, _ in q.held.values()) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]  # noqa: N802, N803
        q, out = self._load(), []
        for r in pd.concat(list(rows)).sort_values(["at", "number"], kind="stable").itertuples(index=False):
            touched = q.apply(r.op, int(r.number), int(r.at), None if pd.isna(r.item) else int(r.item), None if pd.isna(r.worker) else int(r.worker))
            out.append((key[0], r.number, r.at, r.op, touched, *q.counts()))
        self._save(q)
        yield pd.DataFrame(out, columns=OUT.names).astype({"item": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]  # noqa: N802, N803
        q, at = self._load(), expiredTimerInfo.getExpiryTimeInMs() * 1000
        q.reap(at)
        self._save(q)
        yield pd.DataFrame([(key[0], None, at, "reap", None, *q.counts())], columns=OUT.names).astype({"number": "Int64", "item": "Int64"})

    def close(self) -> None:
        pass


def stream(ops: DataFrame, lease: int = LEASE_US, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """``ops`` (with an event time ``time`` that has a watermark) as a stateful stream; needs the RocksDB state store.

    A restart goes on from the checkpoint with the same queue, leases and counters."""
    return ops.groupBy("queue").transformWithStateInPandas(statefulProcessor=QueueProcessor(lease, most_attempts), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
