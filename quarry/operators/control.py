"""Control of operations: commands with epochs, settling of runs, the dispatcher's tick, ingestion admission, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import canonical
from quarry.operators import automaton as am
from quarry.operators import events as ev

def _case(pairs: list[tuple[Column, str]], last: Column | str) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(last) if isinstance(last, str) else last
    for when, name in reversed(pairs):
        out = F.when(F.coalesce(when, F.lit(False)), name).otherwise(out)
    return out


def service_rules(spark: SparkSession) -> DataFrame:
    """The rules of both services as rows: (action, service, unknown, status) -> (to, again, outcome). Services: flows, cleanups and all other operations."""
    actions = sorted({*am.OPERATION_RULES, *am.FLOW_RULES})
    rows = []
    for service in (am.FLOW, am.CLEANUP, "operation"):
        for action in actions:
            for unknown in (False, True):
                for status in am.STATES[1:]:
                    to, _, again, outcome = am.rule(action, service, unknown, status, False)
                    rows.append((action, service, unknown, status, to, again, outcome))
    return spark.createDataFrame(rows, "__action string, __service string, __unknown boolean, __status string, __to string, __again boolean, __outcome string")


def command_outcomes(commands: DataFrame, operations: DataFrame, unknown: DataFrame) -> DataFrame:
    """What becomes of commands (command_id, operation_id, epoch, action) on operations (operation_id, kind, status, epoch, revision), with the status, epoch and revision after each, taken by itself.

    Each service has its own rules: those of flows pause, resume, and try again
    what needs reconciling; other operations are cancelled in two steps, and
    only a cleanup may be tried again once it is cancelled. A command of an old
    attempt is stale. ``unknown`` names the operations that have unknown
    effects or dispatches.
    """
    o = operations.select(F.col("operation_id").alias("__o"), "kind", "status", F.col("epoch").alias("__epoch"), "revision")
    j = commands.join(o, F.col("operation_id") == F.col("__o"), "left")
    j = j.join(unknown.select(F.col("operation_id").alias("__u")).distinct(), F.col("operation_id") == F.col("__u"), "left")
    service = F.when(F.col("kind").isin(am.FLOW, am.CLEANUP), F.col("kind")).otherwise("operation")
    rules = F.broadcast(service_rules(commands.sparkSession))  # as many rows as there are rules
    j = j.join(rules, (F.col("action") == F.col("__action")) & (service == F.col("__service")) & (F.col("__u").isNotNull() == F.col("__unknown")) & (F.col("status") == F.col("__status")), "left")
    outcome = _case(
        [
            (F.col("__o").isNull(), "not_found"),
            ((F.col("kind") == am.FLOW) & ~F.col("action").isin(*am.FLOW_ACTIONS), "not_owned"),
            (~F.col("epoch").eqNullSafe(F.col("__epoch")), "stale"),
        ],
        F.coalesce("__outcome", F.lit("refused")),
    )
    ok = F.col("outcome") == "applied"
    return j.withColumn("outcome", outcome).select(
        "command_id", "operation_id", "outcome",
        F.when(ok, F.col("__to")).otherwise(F.col("status")).alias("status"),
        (F.col("__epoch") + F.when(ok & F.col("__again"), 1).otherwise(0)).alias("epoch"),
        (F.col("revision") + F.when(ok, 1).otherwise(0)).alias("revision"),
    )


def settle_runs(runs: DataFrame, effects: DataFrame) -> DataFrame:
    """The state of runs (operation_id, status) whose execution is over, by their effects (operation_id, kind, status).

    Unknown effects of transforms are taken as absent, for transforms can be
    computed again; unknown effects of models stay unknown. A pause or
    cancellation that was asked for happens once nothing is unknown.
    """
    lost = (F.col("status") == "unknown") & (F.col("kind") == "process.preprocess")
    by = effects.groupBy("operation_id").agg(F.count_if(lost).alias("recomputed"), F.count_if((F.col("status") == "unknown") & ~lost).alias("unknown"))
    j = runs.join(by.withColumnRenamed("operation_id", "__o"), F.col("operation_id") == F.col("__o"), "left")
    zero = F.lit(0).cast("long")
    unknown = F.coalesce("unknown", zero)
    status, clear = F.col("status"), unknown == 0
    to = (
        F.when(status.isin("succeeded", "cancelled", "paused"), status)
        .when((status == "pause_requested") & clear, "paused")
        .when((status == "cancellation_requested") & clear, "cancelled")
        .when(status.isin("pause_requested", "cancellation_requested"), status)
        .otherwise(F.when(clear, "failed").otherwise("reconciliation_needed"))
    )
    over = status.isin("succeeded", "cancelled", "paused")
    return j.select("operation_id", to.alias("status"), F.when(over, zero).otherwise(F.coalesce("recomputed", zero)).alias("recomputed"), unknown.alias("unknown"))


def dispatch_tick(outbox: DataFrame, log: DataFrame, current: DataFrame, now: Column, limit: int) -> DataFrame:
    """One tick of the dispatcher: claims the first free events of the outbox, asks the inbox, and acknowledges each with its outcome.

    ``log`` has the events (event_id, operation_id, event_type, revision,
    epoch), ``current`` the operations' epochs. Applied events are submitted.
    """
    claims = ev.claim(outbox, now, limit).select("event_id", "attempts", "lease_until")
    seen = ev.inbox(claims.join(log, "event_id"), current)
    return claims.join(seen, "event_id").select("event_id", "operation_id", "attempts", "outcome", (F.col("outcome") == "applied").alias("submitted"))


def admit_items(items: DataFrame, samples: DataFrame, origins: DataFrame) -> DataFrame:
    """Outcomes of declared items (batch, position, source_key, modality, sha256, size_bytes, metadata, target, expected_revision, retry_of), and whether all of their batch are admitted.

    A new item's source key must be free; a replacement must name the sample's
    revision and keep its key and modality; a repeated upload must repeat the
    declaration of an item of a failed or cancelled operation that hasn't been
    accepted or repeated. ``samples``: id, source_key, modality, revision;
    ``origins``: id, state, operation_status and the declaration.
    """
    declared = ["source_key", "modality", "sha256", "size_bytes", "metadata", "target", "expected_revision"]
    taken = samples.select(F.col("source_key").alias("__key")).distinct()
    target = samples.select(F.col("id").alias("__id"), F.col("source_key").alias("__tk"), F.col("modality").alias("__tm"), F.col("revision").alias("__tr"))
    origin = origins.select(F.col("id").alias("__of"), F.col("state").alias("__state"), "operation_status", F.struct(*declared).alias("__was"))
    j = items.join(target, F.col("target") == F.col("__id"), "left").join(origin, F.col("retry_of") == F.col("__of"), "left").join(taken, F.col("source_key") == F.col("__key"), "left")
    replaces, repeats = F.col("target").isNotNull(), F.col("retry_of").isNotNull()
    outcome = _case(
        [
            (repeats & F.col("__of").isNull(), "origin_not_found"),
            (repeats & ~F.col("operation_status").isin("failed", "cancelled"), "origin_active"),
            (repeats & F.col("__state").isin("accepted", "superseded"), "origin_closed"),
            (repeats & ~F.struct(*declared).eqNullSafe(F.col("__was")), "declaration_changed"),
            (replaces & F.col("__id").isNull(), "not_found"),
            (replaces & ~F.col("__tr").eqNullSafe(F.col("expected_revision")), "stale"),
            (replaces & ((F.col("__tk") != F.col("source_key")) | (F.col("__tm") != F.col("modality"))), "identity_changed"),
            (~replaces & F.col("__key").isNotNull(), "taken"),
        ],
        "admitted",
    )
    found = j.select("batch", "position", "retry_of", outcome.alias("outcome"))
    whole = found.groupBy(F.col("batch").alias("__b")).agg(F.bool_and(F.col("outcome") == "admitted").alias("batch_admitted"))
    return found.join(whole, F.col("batch") == F.col("__b")).select("batch", "position", "outcome", "batch_admitted", F.when(F.col("batch_admitted"), F.col("retry_of")).alias("superseded"))


def finalize(groups: DataFrame, datasets: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """Outcomes of publishing prepared groups (group_id, dataset_id, state, operation_status, expires_at, mode, label, candidate_state, same_generation, gate_passed, source_revision).

    ``datasets``: dataset_id, availability, draft_revision; ``versions``:
    dataset_id, label. A label is a dataset's once: of groups that ask for the
    same one, the first gets it.
    """
    d = datasets.select(F.col("dataset_id").alias("__d"), "availability", "draft_revision")
    v = versions.select(F.col("dataset_id").alias("__v"), F.col("label").alias("__label")).distinct()
    j = groups.join(d, F.col("dataset_id") == F.col("__d"), "left").join(v, (F.col("dataset_id") == F.col("__v")) & (F.col("label") == F.col("__label")), "left")
    outcome = _case(
        [
            (F.col("__d").isNull(), "not_found"),
            (F.col("state") == "published", "unchanged"),
            (F.col("availability") != "active", "archived"),
            ((F.col("state") != "prepared") | (F.col("operation_status") != "running"), "not_prepared"),
            (F.col("expires_at") <= now, "expired"),
            ((F.col("candidate_state") != "sealed") | ~F.col("same_generation"), "not_sealed"),
            (~F.col("gate_passed"), "gate_failed"),
            ((F.col("mode") == "current_draft") & (F.col("draft_revision") != F.col("source_revision")), "draft_changed"),
            (F.col("__label").isNotNull(), "label_taken"),
        ],
        "published",
    )
    rows = j.withColumn("outcome", outcome)
    w = Window.partitionBy("dataset_id", "label", "outcome").orderBy("group_id")
    again = (F.col("outcome") == "published") & (F.row_number().over(w) > 1)
    return rows.withColumn("again", again).select("group_id", "dataset_id", F.when(F.col("again"), "label_taken").otherwise(F.col("outcome")).alias("outcome"))


def truth_checks(requested: DataFrame, current: DataFrame, canonical_rows: DataFrame) -> DataFrame:
    """Members asked for (dataset, sample_id, partition, canonical_id, audited) against the current ones (dataset, sample_id, group, content_digest): a row a member of either, with the first rule it breaks or null.

    Every current member must be assigned and no other; a canonical row (id,
    unresolved) must be reviewed; only production goes without one; production
    with one needs an audit, and nothing else may have it; groups and contents
    stay in one partition.
    """
    c = current.select(F.col("dataset").alias("__cd"), F.col("sample_id").alias("__cs"), "group", "content_digest")
    j = requested.join(c, (F.col("dataset") == F.col("__cd")) & (F.col("sample_id") == F.col("__cs")), "full")
    k = canonical_rows.select(F.col("id").alias("__k"), "unresolved")
    j = j.join(k, F.col("canonical_id") == F.col("__k"), "left").withColumns({"of": F.coalesce("dataset", "__cd"), "sample": F.coalesce("sample_id", "__cs")})
    labelled, production = F.col("canonical_id").isNotNull(), F.col("partition") == "production"
    crossed = []
    for name in ("group", "content_digest"):
        by = j.filter(F.col("partition").isNotNull() & F.col(name).isNotNull()).groupBy(F.col("of").alias(f"__{name}_of"), F.col(name).alias(f"__{name}")).agg((F.min("partition") != F.max("partition")).alias(f"__{name}_crossed"))
        j = j.join(by.filter(f"__{name}_crossed"), (F.col("of") == F.col(f"__{name}_of")) & (F.col(name) == F.col(f"__{name}")), "left")
        crossed.append(F.col(f"__{name}_crossed"))
    broken = _case(
        [
            (F.col("sample_id").isNull(), "not_assigned"),
            (F.col("__cs").isNull(), "not_a_member"),
            (labelled & F.coalesce("unresolved", F.lit(True)), "not_reviewed"),
            (~production & ~labelled, "not_labelled"),
            (production & labelled & ~F.col("audited"), "not_audited"),
            (F.col("audited") & ~(production & labelled), "audit_misplaced"),
            (F.coalesce(crossed[0], F.lit(False)) | F.coalesce(crossed[1], F.lit(False)), "leaks"),
        ],
        F.lit(None).cast("string"),
    )
    return j.select(F.col("of").alias("dataset"), F.col("sample").alias("sample_id"), "partition", "canonical_id", broken.alias("problem"))


def publish_truth(checks: DataFrame, drafts: DataFrame, most: int = 500) -> DataFrame:
    """Of each dataset the outcome of publishing its truth; if nothing is wrong, its next revision and the digest of its members in order.

    ``drafts``: dataset, revision, expected_revision. At most ``most`` members
    are published at once, so the digest's text is bounded; larger ones are
    refused before it is made.
    """
    by = checks.groupBy("dataset").agg(F.count(F.lit(1)).alias("members"), F.min("problem").alias("problem"))
    j = drafts.join(by.withColumnRenamed("dataset", "__d"), F.col("dataset") == F.col("__d"), "left")
    outcome = _case(
        [
            (F.col("revision") != F.col("expected_revision"), "stale"),
            (F.col("members").isNull(), "empty"),
            (F.col("members") > most, "too_many"),
            (F.col("problem").isNotNull(), "refused"),
        ],
        "published",
    )
    found = j.select("dataset", "revision", "members", outcome.alias("outcome"))
    line = canonical.canonical_object({"canonical_id": F.col("canonical_id"), "partition": F.col("partition"), "sample_id": F.col("sample_id")})
    lines = checks.join(found.filter("outcome = 'published'").select("dataset"), "dataset", "left_semi").select(F.col("dataset").alias("__d"), F.struct("sample_id", line.alias("line")).alias("x"))
    digest = lines.groupBy("__d").agg(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), ","), F.lit("]")), 256).alias("digest"))
    out = found.join(digest, F.col("dataset") == F.col("__d"), "left")
    return out.select("dataset", "outcome", "members", F.when(F.col("outcome") == "published", F.col("revision") + 1).alias("revision"), "digest")
