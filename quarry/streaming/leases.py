"""Protections of publications as leases: prepared for a time, renewed once it is over, published or released.

``step`` is the rule; ``outcomes`` applies it to a log in batch, one pass over
each protection's events in order, and ``watch`` to a stream with one state a
protection and a timer that says when a lease is over, event or not.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Workers get this module's classes with their task: they needn't have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: how long a lease holds, in milliseconds.
HOLDS = 24 * 3600 * 1000


class Lease(NamedTuple):
    """``state``: none, building, prepared, published or released; ``expires``: when the lease is over, in milliseconds; ``done``: members prepared in this epoch."""

    state: str = "none"
    epoch: int = 0
    expires: int = 0
    done: int = 0


def step(lease: Lease, action: str, now: int, done: int) -> tuple[Lease, str]:
    """The lease after an action, and the outcome.

    ``begin`` opens a protection; ``progress`` counts members while it holds,
    ``prepared`` ends that; ``renew`` is for leases that are over: it raises
    the epoch and starts the count again; ``publish`` is for prepared ones that
    hold; ``release`` gives up what isn't published.
    """
    over, open_ = now >= lease.expires, lease.state in ("building", "prepared")
    if action == "begin":
        return (Lease("building", 1, now + HOLDS, 0), "applied") if lease.state == "none" else (lease, "unchanged")
    if lease.state == "none":
        return lease, "not_found"
    if action == "release":
        if lease.state == "released":
            return lease, "unchanged"
        return (lease._replace(state="released"), "applied") if open_ else (lease, "closed")
    if action not in ("renew", "progress", "prepared", "publish"):
        return lease, "refused"
    if action == "publish" and lease.state == "published":
        return lease, "unchanged"
    if not open_:
        return lease, "closed"
    if action == "renew":
        return (Lease("building", lease.epoch + 1, now + HOLDS, 0), "applied") if over else (lease, "active")
    if over:
        return lease, "expired"
    if action == "publish":
        return (lease._replace(state="published"), "applied") if lease.state == "prepared" else (lease, "refused")
    if lease.state != "building":
        return lease, "refused"
    return (lease._replace(done=lease.done + done), "applied") if action == "progress" else (lease._replace(state="prepared"), "applied")


OUTCOME = "group_id long, event_id long, action string, outcome string, state string, epoch long, done long, expires_ms long"
OUTCOME_ARROW = pa.schema([("group_id", pa.int64()), ("event_id", pa.int64()), ("action", pa.string()), ("outcome", pa.string()), ("state", pa.string()), ("epoch", pa.int64()), ("done", pa.int64()), ("expires_ms", pa.int64())])


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    going, lease = None, Lease()
    for b in batches:
        out = []
        for e in b.to_pylist():
            if e["group_id"] != going:
                going, lease = e["group_id"], Lease()
            lease, outcome = step(lease, e["action"] or "", e["ms"], e["done"] or 0)
            out.append((e["group_id"], e["event_id"], e["action"], outcome, lease.state, lease.epoch, lease.done, lease.expires))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(OUTCOME_ARROW)], schema=OUTCOME_ARROW)


def outcomes(log: DataFrame) -> DataFrame:
    """Each event's outcome and the lease after it; ``log``: group_id, ts, event_id, action, done. Events without a group are left out, those of one time go by event_id; what is held of a group is its lease."""
    rows = log.filter("group_id is not null and ts is not null").select("group_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", "action", "done")
    return rows.repartition("group_id").sortWithinPartitions("group_id", "ms", "event_id").mapInArrow(_outcomes, OUTCOME)


def over_at(found: DataFrame, now_ms: int) -> DataFrame:
    """group_id, epoch and expires_ms of the protections whose lease is over at a time and that are neither published nor released."""
    last = found.groupBy("group_id").agg(F.max_by(F.struct("state", "epoch", "expires_ms"), F.struct("epoch", "event_id")).alias("x")).select("group_id", "x.*")
    return last.filter(F.col("state").isin("building", "prepared") & (F.col("expires_ms") <= now_ms)).select("group_id", "epoch", "expires_ms")


def release_page(over: DataFrame, after: int | None = None, limit: int = 100) -> DataFrame:
    """The next protections to release, in order of their ids, after the last of the page before."""
    return (over if after is None else over.filter(F.col("group_id") > after)).orderBy("group_id").limit(limit)


class Watch(StatefulProcessor):
    """One lease a protection; a timer for its end, which tells that it is over unless it has been renewed or closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "state string, epoch long, expires long, done long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lease = Lease(*self.lease.get()) if self.lease.exists() else Lease()
        out = []
        for e in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples(index=False):
            lease, outcome = step(lease, e.action, int(e.ts.timestamp() * 1000), int(e.done))
            out.append((key[0], e.event_id, e.action, outcome, *lease_row(lease)))
        self.lease.update(tuple(lease))
        self._timer(lease)
        yield pd.DataFrame(out, columns=[f.name for f in OUTCOME_ARROW])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lease = Lease(*self.lease.get())
        if lease.state in ("building", "prepared") and lease.expires <= expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame([(key[0], None, None, "over", *lease_row(lease))], columns=[f.name for f in OUTCOME_ARROW]).astype({"event_id": "Int64"})

    def _timer(self, lease: Lease) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if lease.state in ("building", "prepared"):
            self.handle.registerTimer(lease.expires)

    def close(self) -> None:
        pass


def lease_row(lease: Lease) -> tuple[str, int, int, int]:
    return lease.state, lease.epoch, lease.done, lease.expires


def watch(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The outcomes of a stream of events, and a row ``over`` for each lease that ends: event time, a watermark of ``late``, update mode. The session needs the RocksDB state store."""
    marked = events.filter("group_id is not null").withWatermark("ts", late)
    return marked.groupBy("group_id").transformWithStateInPandas(Watch(), OUTCOME, "Update", "EventTime")
