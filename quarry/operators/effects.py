"""Receipts of effects: each effect's life validated in order, fenced by dispatch and epoch.

An effect (operation_id, effect_key) is prepared with a request, begun under a
dispatch of an attempt (from then on it is unknown whether it happened), and
completed by that dispatch or reconciled: found with a result, or absent, so
that it may begin again. Steps stream by in order; what is kept of an effect
is its state, six values, however many steps it has.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Workers get this module's functions with their task: they needn't have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP = ["operation_id", "effect_key", "event_id", "step", "epoch", "dispatch", "request", "result", "expected_revision", "op_status", "op_epoch"]
VERDICT = "operation_id long, effect_key string, event_id long, step string, outcome string, status string, revision long, unknown_change int"
VERDICT_ARROW = pa.schema([("operation_id", pa.int64()), ("effect_key", pa.string()), ("event_id", pa.int64()), ("step", pa.string()), ("outcome", pa.string()), ("status", pa.string()), ("revision", pa.int64()), ("unknown_change", pa.int32())])


@dataclass
class Receipt:
    """An effect's state; without a status it isn't prepared yet."""

    status: str | None = None
    request: str | None = None
    dispatch: str | None = None
    epoch: int | None = None
    result: str | None = None
    revision: int = -1

    def _to(self, status: str) -> str:
        self.status = status
        self.revision += 1
        return "applied"

    def prepare(self, e: dict) -> str:
        if e["epoch"] != e["op_epoch"]:
            return "stale"
        if e["op_status"] != "running":
            return "refused"
        if self.status is not None:
            return "reused" if self.request == e["request"] else "conflict"
        self.request = e["request"]
        return self._to("prepared")

    def begin(self, e: dict) -> str:
        if e["epoch"] != e["op_epoch"]:
            return "stale"
        if e["op_status"] != "running":
            return "refused"
        if self.status is None:
            return "not_found"
        if self.status != "prepared":
            return "dispatched"
        self.dispatch, self.epoch = e["dispatch"], e["epoch"]
        return self._to("unknown")

    def complete(self, e: dict) -> str:
        if e["epoch"] != e["op_epoch"]:
            return "stale"
        if self.status is None:
            return "not_found"
        if self.dispatch != e["dispatch"] or self.epoch != e["epoch"]:
            return "stale"
        if self.status == "succeeded":
            return "unchanged" if self.result == e["result"] else "conflict"
        if self.status != "unknown" or e["op_status"] not in ("running", "cancellation_requested"):
            return "unreconciled"
        self.result = e["result"]
        return self._to("succeeded")

    def reconcile(self, e: dict) -> str:
        """By any attempt: found where there is a result, else absent."""
        if self.status is None:
            return "not_found"
        if self.status != "unknown" or self.revision != e["expected_revision"]:
            return "stale"
        if e["result"] is not None:
            self.result = e["result"]
            return self._to("succeeded")
        self.dispatch = self.epoch = None
        return self._to("prepared")


def _lives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    going, receipt = None, Receipt()
    for b in batches:
        out = []
        for e in b.to_pylist():
            if (e["operation_id"], e["effect_key"]) != going:
                going, receipt = (e["operation_id"], e["effect_key"]), Receipt()
            was = receipt.status == "unknown"
            step = getattr(receipt, e["step"]) if e["step"] in ("prepare", "begin", "complete", "reconcile") else lambda _: "refused"
            outcome = step(e)
            out.append({"operation_id": e["operation_id"], "effect_key": e["effect_key"], "event_id": e["event_id"], "step": e["step"], "outcome": outcome, "status": receipt.status, "revision": receipt.revision, "unknown_change": (receipt.status == "unknown") - was})
        yield pa.RecordBatch.from_pylist(out, schema=VERDICT_ARROW)


def lives(steps: DataFrame) -> DataFrame:
    """Each step's outcome, the effect's status and revision after it, and by how much it changes the number of unknown effects.

    ``steps``: operation_id, effect_key, ts, event_id, step, epoch, dispatch,
    request, result, expected_revision, and the operation's op_status and
    op_epoch at that time. Outcomes: ``applied``; ``reused`` (prepared again
    with the same request); ``conflict`` (another request or result);
    ``unchanged``; ``dispatched`` (begun already); ``unreconciled`` (no longer
    the dispatch's to complete); ``stale`` (epoch, dispatch or revision);
    ``refused`` (the operation's state, or a step there isn't); ``not_found``.
    Steps of one time go by their event_id; a null key is an effect as well.
    """
    keys = ["operation_id", "effect_key"]
    ordered = steps.select(*STEP, "ts").repartition(*keys).sortWithinPartitions(*keys, "ts", "event_id")
    return ordered.select(*STEP).mapInArrow(_lives, VERDICT)


def receipts(verdicts: DataFrame) -> DataFrame:
    """operation_id, effect_key, the last status and revision, and the numbers of steps applied and turned down."""
    done = F.col("outcome") == "applied"
    by = verdicts.groupBy("operation_id", "effect_key").agg(F.max_by(F.struct("status", "revision"), F.struct("revision", "event_id")).alias("x"), F.count_if(done).alias("applied"), F.count_if(~done).alias("turned_down"))
    return by.select("operation_id", "effect_key", "x.status", "x.revision", "applied", "turned_down")


def reconciliation(verdicts: DataFrame) -> DataFrame:
    """Of each operation how many effects it has, how many of them are unknown at the end, and whether that needs reconciling; sums combine before the exchange."""
    by = verdicts.groupBy("operation_id").agg(F.count_distinct("effect_key").alias("effects"), F.sum("unknown_change").alias("unknown"))
    return by.withColumn("needs_reconciliation", F.col("unknown") > 0)


@dataclass
class Submission:
    """A workflow's dispatch for one attempt; ``digest`` binds the request and, once begun, the deployment."""

    digest: str
    status: str = "pending"
    deployment: str | None = None
    reference: str | None = None

    def begin(self, e: dict) -> str:
        if e["epoch"] != e["op_epoch"]:
            return "stale"
        if self.deployment is not None and self.deployment != e["deployment"]:
            return "conflict"
        if self.status == "submitted":
            return "unchanged"
        if self.status != "pending" or e["op_status"] != "queued":
            return "unreconciled"
        if self.deployment is None:
            self.deployment = e["deployment"]
            text = json.dumps({"deployment_id": self.deployment, "request_digest": self.digest}, sort_keys=True, separators=(",", ":"))
            self.digest = hashlib.sha256(text.encode()).hexdigest()
        self.status = "unknown"
        return "applied"

    def complete(self, e: dict) -> str:
        if e["epoch"] != e["op_epoch"]:
            return "stale"
        if self.status == "submitted":
            return "unchanged" if self.reference == e["reference"] else "conflict"
        if self.status != "unknown":
            return "not_begun"
        self.status, self.reference = "submitted", e["reference"]
        return "applied"

    def reconcile(self, e: dict) -> str:
        """By any attempt, with the digest that was bound: found where there is a reference, else absent."""
        if self.status != "unknown" or e["digest"] != self.digest:
            return "stale"
        self.status, self.reference = ("submitted", e["reference"]) if e["reference"] is not None else ("pending", None)
        return "applied"


SUBMISSION = ["operation_id", "epoch", "event_id", "step", "deployment", "reference", "digest", "request", "op_status", "op_epoch"]
SUBMITTED = "operation_id long, epoch long, event_id long, step string, outcome string, status string, digest string"
SUBMITTED_ARROW = pa.schema([("operation_id", pa.int64()), ("epoch", pa.int64()), ("event_id", pa.int64()), ("step", pa.string()), ("outcome", pa.string()), ("status", pa.string()), ("digest", pa.string())])


def _submissions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    going, row = None, None
    for b in batches:
        out = []
        for e in b.to_pylist():
            if row is None or (e["operation_id"], e["epoch"]) != going:
                going, row = (e["operation_id"], e["epoch"]), Submission(e["request"])
            outcome = getattr(row, e["step"])(e) if e["step"] in ("begin", "complete", "reconcile") else "refused"
            out.append({"operation_id": e["operation_id"], "epoch": e["epoch"], "event_id": e["event_id"], "step": e["step"], "outcome": outcome, "status": row.status, "digest": row.digest})
        yield pa.RecordBatch.from_pylist(out, schema=SUBMITTED_ARROW)


def submissions(steps: DataFrame) -> DataFrame:
    """Each step's outcome, and the status and digest of its dispatch after it.

    ``steps``: operation_id, epoch, ts, event_id, step (begin, complete,
    reconcile), deployment, reference, digest, request (the digest that the
    dispatch was made with), and the operation's op_status and op_epoch then.
    From its begin until it is completed or reconciled it is unknown whether a
    dispatch was taken: ``unreconciled`` if it should begin again meanwhile.
    """
    keys = ["operation_id", "epoch"]
    ordered = steps.select(*SUBMISSION, "ts").repartition(*keys).sortWithinPartitions(*keys, "ts", "event_id")
    return ordered.select(*SUBMISSION).mapInArrow(_submissions, SUBMITTED)
