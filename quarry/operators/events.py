"""The operation log: admission, state folds, outbox claims, inbox outcomes, checkpoints, expiry, ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From which states an event of the log may lead on, and to which (``automaton`` has the services' commands).
TRANSITIONS = {
    "queued": (("new",), "queued"),
    "running": (("queued", "running"), "running"),
    "effect_completed": (("running",), "running"),
    "failed": (("queued", "running"), "failed"),
    "succeeded": (("running",), "succeeded"),
}


def sequenced(events: DataFrame) -> DataFrame:
    """Events with their revision within the operation and the epoch: one more for each error before."""
    w = Window.partitionBy("operation_id").orderBy("ts", "event_id")
    failed = F.when(F.col("event_type") == "failed", 1).otherwise(0).cast("long")
    before = F.coalesce(F.sum(failed).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return events.withColumn("revision", F.row_number().over(w).cast("long") - 1).withColumn("epoch", before + 1)


def admit(requests: DataFrame) -> DataFrame:
    """Requests (creator, request_key, digest, seq): the first of a key is created, equal ones replay it, others conflict."""
    first = requests.groupBy("creator", "request_key").agg(F.min_by(F.struct("seq", "digest"), "seq").alias("first"))
    j = requests.join(first, ["creator", "request_key"])
    outcome = F.when(F.col("seq") == F.col("first.seq"), "created").when(F.col("digest") == F.col("first.digest"), "replayed").otherwise("conflict")
    return j.select("creator", "request_key", "seq", outcome.alias("outcome"), F.col("first.seq").alias("operation_seq"))


def transition(state: Column, event: Column) -> Column:
    """The next state, or null if the event isn't allowed in this one."""
    to = F.lit(None).cast("string")
    for name, (sources, target) in TRANSITIONS.items():
        to = F.when((event == name) & state.isin(*sources), F.lit(target)).otherwise(to)
    return to


#: States that events may lead from or to, and how many events of an operation are folded as one array.
STATES, CHUNK = ("new", "queued", "running", "failed", "succeeded"), 1024


def fold_states(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """operation_id, state, applied, refused: each operation's events in order through the automaton.

    Events are functions from states to states. ``chunk`` of them at a time
    are composed, from every state at once; an operation's chunks, a
    ``chunk``-th of its events, are then followed from the first state.
    """
    numbered = sequenced(events).select("operation_id", "revision", "event_type", F.floor(F.col("revision") / chunk).alias("chunk"))
    logs = numbered.groupBy("operation_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("revision", "event_type"))).alias("log"))

    def count(when: Column) -> Column:
        return when.cast("long")

    def from_state(s: str) -> Column:
        start = F.struct(F.lit(s).alias("state"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("refused"))

        def step(acc, e):
            to = transition(acc["state"], e["event_type"])
            return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["applied"] + count(to.isNotNull())).alias("applied"), (acc["refused"] + count(to.isNull())).alias("refused"))

        return F.aggregate("log", start, step)

    functions = logs.select("operation_id", "chunk", F.map_from_arrays(F.array(*map(F.lit, STATES)), F.array(*map(from_state, STATES))).alias("to"))
    chains = functions.groupBy("operation_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", F.map_entries("to").alias("to")))), lambda x: x["to"]).alias("chain"))
    start = F.struct(F.lit("new").alias("state"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("refused"))

    def follow(acc, entries):
        to = F.element_at(F.filter(entries, lambda x: x["key"] == acc["state"]), 1)["value"]
        return F.struct(to["state"].alias("state"), (acc["applied"] + to["applied"]).alias("applied"), (acc["refused"] + to["refused"]).alias("refused"))

    return chains.select("operation_id", F.aggregate("chain", start, follow).alias("s")).select("operation_id", "s.state", "s.applied", "s.refused")


def claim(outbox: DataFrame, now: Column, limit: int, lease_seconds: int = 30) -> DataFrame:
    """The first undispatched rows without a live lease, each with one more attempt and a new lease."""
    free = outbox.filter(~F.col("dispatched") & (F.col("lease_until").isNull() | (F.col("lease_until") <= now)))
    lease = now + F.expr(f"interval {int(lease_seconds)} seconds")
    return free.orderBy("created_at", "event_id").limit(limit).withColumns({"attempts": F.col("attempts") + 1, "lease_until": lease})


def deliveries(events: DataFrame, outbox: DataFrame, now: Column, limit: int) -> DataFrame:
    """The events (event_id, operation_id, event_type, ts) of the outbox rows (event_id, dispatched, lease_until) that may be delivered: not dispatched and without a live lease; the first by time and id."""
    free = outbox.filter(~F.col("dispatched") & (F.col("lease_until").isNull() | (F.col("lease_until") <= now))).select(F.col("event_id").alias("__e"))
    return events.join(free, F.col("event_id") == F.col("__e")).drop("__e").orderBy("ts", "event_id").limit(limit)


def acknowledge(claims: DataFrame, acks: DataFrame, now: Column) -> DataFrame:
    """Outcome of acknowledgements (event_id, claim_id) against the claims (event_id, claim_id, lease_until, dispatched)."""
    c, a = claims.alias("c"), acks.alias("a")
    j = a.join(c, F.col("a.event_id") == F.col("c.event_id"), "left")
    outcome = F.when(F.col("c.event_id").isNull(), "unknown").when(F.col("c.dispatched"), "repeated").when(F.col("a.claim_id") != F.col("c.claim_id"), "lost").when(F.col("c.lease_until") <= now, "expired").otherwise("acknowledged")
    return j.select(F.col("a.event_id"), F.col("a.claim_id"), outcome.alias("outcome"))


#: Kinds of event that the inbox knows.
KNOWN = ("queued", "running", "effect_completed", "failed", "succeeded")


def inbox(deliveries: DataFrame, current: DataFrame) -> DataFrame:
    """Each event once with its outcome: quarantined, stale (another epoch), ignored (not queued work), applied."""
    once = deliveries.dropDuplicates(["event_id"])
    j = once.join(current.select("operation_id", F.col("epoch").alias("now_epoch")), "operation_id", "left")
    outcome = F.when(~F.col("event_type").isin(*KNOWN) | F.col("now_epoch").isNull(), "quarantined").when(F.col("event_type") != "queued", "ignored").when(F.col("epoch") != F.col("now_epoch"), "stale").otherwise("applied")
    return j.select("event_id", "operation_id", "revision", outcome.alias("outcome"))


def checkpoints(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("outcome") != "quarantined").groupBy("operation_id").agg(F.max("revision").alias("revision"))


def receipts(effects: DataFrame) -> DataFrame:
    """Of each effect (effect_key, seq, status, request_digest): its last status, and whether requests differ."""
    return effects.groupBy("effect_key").agg(F.max_by("status", "seq").alias("status"), (F.count_distinct("request_digest") > 1).alias("conflict"), F.count(F.lit(1)).alias("n"))


def needs_reconciliation(effects: DataFrame) -> DataFrame:
    return effects.groupBy("operation_id").agg(F.count(F.lit(1)).alias("effects"), F.bool_or(F.col("status") == "unknown").alias("needs_reconciliation"))


def contiguous_prefix(outputs: DataFrame, steps: int) -> DataFrame:
    """How far each run may resume: members in order up to the first that lacks an output (run, position, step)."""
    done = outputs.groupBy("run", "position").agg(F.count_distinct("step").alias("steps")).filter(F.col("steps") == steps)
    w = Window.partitionBy("run").orderBy("position")
    ranked = done.withColumn("n", F.row_number().over(w).cast("long") - 1)
    return ranked.groupBy("run").agg(F.count_if(F.col("n") == F.col("position")).alias("completed"))


def expired(protected: DataFrame, now: Column) -> DataFrame:
    return protected.filter((F.col("state") != "published") & (F.col("expires_at") <= now))


def ingest(items: DataFrame, samples: DataFrame) -> DataFrame:
    """Verified items (item_id, source_key, expected_revision) against samples: created, revised, or why not."""
    i, s = items.alias("i"), samples.alias("s")
    j = i.join(s, F.col("i.source_key") == F.col("s.source_key"), "left")
    outcome = F.when(~F.col("i.verified"), "pending").when(F.col("i.expected_revision").isNull() & F.col("s.id").isNull(), "created").when(F.col("i.expected_revision").isNull(), "taken").when(F.col("s.id").isNull(), "not_found").when(F.col("s.revision") != F.col("i.expected_revision"), "stale").otherwise("revised")
    revision = F.when(outcome == "created", F.lit(1).cast("long")).when(outcome == "revised", F.col("s.revision") + 1)
    return j.select("i.item_id", "i.source_key", outcome.alias("outcome"), revision.alias("revision"))


#: Parts of an upload, all of this size but the last.
PART_BYTES, MOST_PARTS = 8 << 20, 32


def upload_complete(parts: DataFrame, last_bytes: int | None = PART_BYTES) -> DataFrame:
    """Whether an upload's parts (upload, number, bytes, declared) are whole: 1 to n, full but for the last, adding up.

    ``last_bytes``: the most that the last part may have; None where a log has single parts of any size.
    """
    by = parts.groupBy("upload").agg(F.count(F.lit(1)).alias("parts"), F.count_distinct("number").alias("numbers"), F.min("number").alias("least"), F.max("number").alias("most"), F.sum("bytes").alias("bytes"), F.max("declared").alias("declared"), F.max_by("bytes", "number").alias("last"), F.count_if(F.col("bytes") == PART_BYTES).alias("whole"))
    full = F.col("whole") - (F.col("last") == PART_BYTES).cast("long") == F.col("parts") - 1
    ok = (F.col("least") == 1) & (F.col("numbers") == F.col("parts")) & (F.col("most") == F.col("parts")) & (F.col("parts") <= MOST_PARTS) & full & (F.lit(True) if last_bytes is None else F.col("last") <= last_bytes) & (F.col("bytes") == F.col("declared"))
    return by.select("upload", "parts", "bytes", ok.alias("complete"))


def reconcile_jobs(jobs: DataFrame, active: DataFrame) -> DataFrame:
    """Jobs that claim to run but aren't active: cancelled if that was asked for, else failed."""
    stale = jobs.filter(F.col("status") == "running").join(active.select("run_id"), "run_id", "left_anti")
    return stale.select("run_id", F.when(F.col("cancel_requested"), "cancelled").otherwise("failed").alias("status"))


def upsert_latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; created_at stays that of the first. One aggregation, whose partial results combine before the exchange."""
    rest = [c for c in log.columns if c not in (key, "created_at")]
    by = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x"), F.min("created_at").alias("created_at"))
    return by.select(key, "created_at", "x.*").select(*log.columns)
