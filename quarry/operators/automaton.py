"""Control of operations: the states of both services as one automaton over an ordered log, whatever an operation's length.

A log has commands (operation_id, ts, event_id, action, epoch, kind, unknown):
``epoch`` is the attempt that the sender knows, ``unknown`` says whether
effects or a dispatch of that attempt are unknown just then. A command is a
function from states to states, so a stretch of the log is one too, and
stretches are composed in order. The log is sorted by range, which cuts a long
operation anywhere; each partition folds the operations that lie in it whole,
and for the one that may go on from the partition before it gives the
composed function. Where that operation begins is then known from at most two
functions a partition, and a second pass gives every command its outcome.
No operation is ever one array, one group or one task.

``control`` gives every command's outcome and the state after it,
``final_states`` an operation's last state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import checkpointed

# Workers get this module's functions with their task: they needn't have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The states of an operation (``none``: not admitted).
STATES = ("none", "queued", "running", "cancellation_requested", "cancelled", "failed", "succeeded", "pause_requested", "paused", "reconciliation_needed")
#: Kinds with rules of their own, and those that reconciliation may be asked for.
FLOW, CLEANUP = "process_flow", "ingest_cleanup"
RECONCILABLE = (FLOW, CLEANUP, "verify_sample_artifact", "ingest_samples")
#: Commands of the operation service: states they lead on from, the state they lead to, whether they begin an attempt.
OPERATION_RULES = {
    "start": (("queued",), "running", False),
    "request_cancel": (("queued", "running"), "cancellation_requested", False),
    "confirm_cancel": (("cancellation_requested",), "cancelled", False),
    "fail": (("queued", "running", "cancellation_requested"), "failed", False),
    "succeed": (("running",), "succeeded", False),
    "retry": (("failed", "cancelled"), "queued", True),
}
#: Commands of the flow service: from each state to which, with nothing unknown and with something unknown (None: refused; the state itself: unchanged).
FLOW_RULES = {
    "start": {"queued": ("running", "running"), "running": ("running", "running"), "pause_requested": ("paused", "pause_requested"), "cancellation_requested": ("cancelled", "cancellation_requested")},
    "pause": {"queued": ("paused", "pause_requested"), "running": ("paused", "pause_requested"), "paused": ("paused", "paused"), "pause_requested": ("pause_requested", "pause_requested")},
    "request_cancel": {s: ("cancelled", "cancelled" if s == "cancelled" else "cancellation_requested") for s in ("queued", "running", "paused", "pause_requested", "failed", "reconciliation_needed", "cancellation_requested", "cancelled")},
    "fail": {"queued": ("failed", "reconciliation_needed"), "running": ("failed", "reconciliation_needed"), "failed": ("failed", "reconciliation_needed"), "reconciliation_needed": ("failed", "reconciliation_needed"), "pause_requested": ("paused", "pause_requested"), "cancellation_requested": ("cancelled", "cancellation_requested"), "succeeded": ("succeeded", "succeeded"), "paused": ("paused", "paused"), "cancelled": ("cancelled", "cancelled")},
    "succeed": {"running": ("succeeded", None)},
    "resume": {"paused": ("queued", None)},
    "retry": {"failed": ("queued", None), "reconciliation_needed": ("queued", None)},
}
#: Flow commands that begin an attempt.
NEW_ATTEMPT = ("resume", "retry")
OUTCOMES = ("applied", "unchanged", "refused", "unreconciled", "not_owned", "stale", "not_found")

# A state in the tables below: twice its place in STATES, plus one while a request to reconcile hasn't been delivered.
Step = tuple[int, bool, str]


def rule(action: str, kind: str, unknown: bool, status: str, pending: bool) -> tuple[str, bool, bool, str]:
    """What a command of the current attempt does in a state: the next state, whether a request is pending then, whether an attempt begins, and the outcome."""
    stay = (status, pending, False)
    if status == "none":
        return ("queued", False, True, "applied") if action == "admit" else (*stay, "not_found")
    if action == "admit":
        return *stay, "unchanged"
    if action == "request_reconcile":
        if kind not in RECONCILABLE or status in ("succeeded", "cancelled"):
            return *stay, "refused"
        return (*stay, "unchanged") if pending else (status, True, False, "applied")
    if action == "deliver":
        return (status, False, False, "applied") if pending else (*stay, "unchanged")
    if kind == FLOW:
        to = FLOW_RULES.get(action, {}).get(status, (None, None))[unknown]
        if to is None:
            return *stay, "refused"
        if to == status:
            return *stay, "unchanged"
        return (to, False, True, "applied") if action in NEW_ATTEMPT else (to, pending, False, "applied")
    if action in ("pause", "resume"):
        return *stay, "refused"
    if action not in OPERATION_RULES:
        return *stay, "refused"
    sources, to, new = OPERATION_RULES[action]
    if status == to and not new:
        return *stay, "unchanged"
    if status not in sources or new and status == "cancelled" and kind != CLEANUP:
        return *stay, "refused"
    if to == "cancelled" and unknown:
        return *stay, "unreconciled"
    return to, pending and not new, new, "applied"


def table(action: str, kind: str, unknown: bool) -> list[Step]:
    """A command as a function: for each state its next one, whether an attempt begins, and the outcome."""
    out = []
    for i in range(2 * len(STATES)):
        to, pending, new, outcome = rule(action, kind, unknown, STATES[i // 2], bool(i % 2))
        out.append((2 * STATES.index(to) + pending, new, outcome))
    return out


class Tables(dict):
    """Tables of commands by (action, kind, unknown), made when they are met."""

    def __missing__(self, key: tuple) -> list[Step]:
        made = self[key] = table(*key)
        return made


class Composed:
    """The function of a stretch of an operation's log: from (state, epoch) to (state, epoch, revisions made).

    States whose epoch no command of the stretch has are left as they are, so
    only epochs that occur are followed; starts that have come to one state go
    on as one class.
    """

    def __init__(self, tables: Tables, begins_here: bool) -> None:
        self.tables, self.begins_here = tables, begins_here
        self.known: set[int] = set()
        #: By current epoch and state: revisions so far, and the starts with what to add to that.
        self.classes: dict[int, dict[int, list]] = {0: {0: [0, [((0, 0), 0)]]}} if begins_here else {}

    def _join(self, epoch: int, state: int, revisions: int, starts: list) -> None:
        at = self.classes.setdefault(epoch, {})
        if state not in at:
            at[state] = [revisions, starts]
        else:
            base = at[state][0]
            at[state][1] += [(s, n + revisions - base) for s, n in starts]

    def apply(self, action: str, kind: str, unknown: bool, epoch: int) -> None:
        epoch = 0 if action == "admit" else epoch
        if not self.begins_here and epoch not in self.known:
            self.known.add(epoch)
            for state in range(2 * len(STATES)):
                if (state < 2) == (epoch == 0):  # what isn't admitted has epoch 0, all else a later one
                    self._join(epoch, state, 0, [((state, epoch), 0)])
        before, steps = self.classes.pop(epoch, None) or {}, self.tables[action, kind, unknown]
        for state, (revisions, starts) in before.items():
            to, new, outcome = steps[state]
            self._join(epoch + new, to, revisions + (outcome == "applied"), starts)

    def rows(self) -> list[tuple[int, int, int, int, int]]:
        return [(*start, state, epoch, revisions + n) for epoch, by in self.classes.items() for state, (revisions, starts) in by.items() for start, n in starts]


LOG = ["operation_id", "ts", "event_id", "action", "epoch", "kind", "unknown"]
FUNCTION = "operation_id long, part int, function array<struct<s:int,e:long,s2:int,e2:long,n:long>>"
FUNCTION_ARROW = pa.schema([("operation_id", pa.int64()), ("part", pa.int32()), ("function", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int64()), ("s2", pa.int32()), ("e2", pa.int64()), ("n", pa.int64())])))])


def _commands(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("part", "operation_id", "event_id", "action", "epoch", "kind", "unknown")), strict=True)


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each partition, the functions of its first operation and of its last, which begins there if it isn't the first."""
    tables, out = Tables(), []
    going, first, made, number = None, False, None, 0

    def row():
        return {"operation_id": going, "part": number, "function": [dict(zip(("s", "e", "s2", "e2", "n"), x, strict=True)) for x in made.rows()]}

    for number, operation, _, action, epoch, kind, unknown in _commands(batches):  # noqa: B007
        if made is None or operation != going:
            if first:
                out.append(row())
            first, made, going = made is None, Composed(tables, made is not None), operation
        made.apply(action, kind, unknown, epoch)
    if made is not None:
        out.append(row())
        yield pa.RecordBatch.from_pylist(out, schema=FUNCTION_ARROW)


def _outcomes(begins: dict[int, tuple[int, int, int]]):
    """Each command's outcome, and its operation's state, epoch and revision after it."""

    def fn(batches):
        tables, going, new_part = Tables(), None, True  # operation ids are never null: such rows are left out
        state, current, revision = 0, 0, -1
        for b in batches:
            out: list[tuple] = []
            for part, operation, event, action, epoch, kind, unknown in _commands([b]):
                if operation != going:
                    state, current, revision = begins.get(part, (0, 0, -1)) if new_part else (0, 0, -1)
                    going, new_part = operation, False
                if action != "admit" and state > 1 and kind == FLOW and action not in FLOW_ACTIONS:
                    outcome = "not_owned"
                elif action != "admit" and state > 1 and epoch != current:
                    outcome = "stale"
                else:
                    state, new, outcome = tables[action, kind, unknown][state]
                    current += new
                    revision += outcome == "applied"
                out.append((operation, event, action, outcome, STATES[state // 2], current, revision))
            columns = zip(*out, strict=True) if out else ([],) * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["operation_id", "event_id", "action", "outcome", "status", "epoch", "revision"])

    return fn


#: Commands that the flow service knows; others on its operations belong elsewhere.
FLOW_ACTIONS = (*FLOW_RULES, "request_reconcile", "deliver")


def control(log: DataFrame, parts: int | None = None) -> DataFrame:
    """operation_id, event_id, action, outcome, status, epoch and revision (of the operation after it) of every command.

    Outcomes: ``applied``; ``unchanged`` (the state is that already, or a
    request is pending); ``refused`` by the state; ``unreconciled`` (cancelling
    waits for what is unknown); ``not_owned`` (a command that the flow service
    doesn't have); ``stale`` (of another attempt); ``not_found`` (before
    admission; revision -1). A null action is refused, a null epoch is stale,
    commands without an operation are left out. Commands of one time go by
    their event_id.
    """
    spark = log.sparkSession
    order = ["operation_id", "ts", "event_id"]
    taken = log.select(*LOG).filter("operation_id is not null").withColumns({"action": F.coalesce("action", F.lit("")), "kind": F.coalesce("kind", F.lit("")), "epoch": F.coalesce("epoch", F.lit(-1)).cast("long"), "unknown": F.coalesce("unknown", F.lit(False))})
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Checkpointed, so that both passes see the same cuts.
    dealt = checkpointed(taken.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    functions = dealt.mapInArrow(_functions, FUNCTION)
    piece = F.sort_array(F.collect_list(F.struct("part", "function")))
    chains = functions.groupBy("operation_id").agg(piece.alias("pieces")).filter(F.size("pieces") > 1)

    def go(acc, x):
        hit = F.filter(x["function"], lambda f: (f["s"] == acc["s"]) & (f["e"] == acc["e"]))
        to = F.get(hit, F.lit(0))
        at = F.struct(x["part"].alias("part"), acc["s"].alias("s"), acc["e"].alias("e"), acc["n"].alias("n"))
        return F.struct(F.coalesce(to["s2"], acc["s"]).alias("s"), F.coalesce(to["e2"], acc["e"]).alias("e"), (acc["n"] + F.coalesce(to["n"], F.lit(0).cast("long"))).alias("n"), F.concat(acc["begins"], F.array(at)).alias("begins"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("e"), F.lit(-1).cast("long").alias("n"), F.array().cast("array<struct<part:int,s:int,e:long,n:long>>").alias("begins"))
    found = chains.select(F.inline(F.slice(F.aggregate("pieces", start, go)["begins"], 2, n)))
    # At most one row a partition.
    begins = {r["part"]: (r["s"], r["e"], r["n"]) for r in found.collect()}
    return dealt.mapInArrow(_outcomes(begins), "operation_id long, event_id long, action string, outcome string, status string, epoch long, revision long")


def final_states(outcomes: DataFrame, order: list[str]) -> DataFrame:
    """operation_id, its last status, epoch and revision, and how many commands came to each outcome; sums combine before the exchange."""
    last = F.max_by(F.struct("status", "epoch", "revision"), F.struct(*order)).alias("x")
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return outcomes.groupBy("operation_id").agg(last, *counts).select("operation_id", "x.status", "x.epoch", "x.revision", *OUTCOMES)
