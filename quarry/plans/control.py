"""Control queries: commands, settled runs, dispatcher ticks, ingestion admission, publishing of versions and truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import control as ctl
from quarry.operators import events as ev
from quarry.plans import log
from quarry.sources import fixtures as fx
from quarry.sources.fixtures import with_tables


def pick(n, *names):
    """The name at place ``n`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def sql_pick(n, *names):
    return "[" + ", ".join(f"'{x}'" for x in names) + f"][1 + ({n}) % {len(names)}]"


STATES = ("queued", "running", "failed", "paused", "cancelled", "reconciliation_needed")
KINDS = ("verify", "process_flow", "ingest_cleanup")


def operations(spark, d):
    o = F.col("operation_id")
    e = fx.operation_events(spark, d).select("operation_id").distinct()
    return e.select("operation_id", pick(F.floor(o / 7), *KINDS).alias("kind"), pick(o, *STATES).alias("status"), (1 + o % 2).alias("epoch"), (o % 9).alias("revision"))


def e02_commands(spark, d):
    n = F.col("event_id")
    asked = fx.operation_events(spark, d).select(n.alias("command_id"), (F.col("operation_id") + F.when(n % 50 == 0, 10**9).otherwise(0)).alias("operation_id"), (1 + n % 2).alias("epoch"), pick(n, "pause", "request_cancel", "retry").alias("action"))
    return ctl.command_outcomes(asked, operations(spark, d), operations(spark, d).filter("operation_id % 5 = 0"))


OPERATION = f"operation as (select distinct operation_id, {sql_pick('operation_id // 7', *KINDS)} as kind, {sql_pick('operation_id', *STATES)} as status, 1 + operation_id % 2 as epoch, operation_id % 9 as revision from event)"


def e03_retries_by_epoch(spark, d):
    """Of each action, how many commands were applied, and how many began a new epoch."""
    out = e02_commands(spark, d).withColumn("action", pick(F.col("command_id"), "pause", "request_cancel", "retry"))
    return out.groupBy("action").agg(F.count_if(F.col("outcome") == "applied").alias("applied"), F.count_if((F.col("outcome") == "applied") & (F.col("epoch") != 1 + F.col("operation_id") % 2)).alias("new_epochs"))


RUN_STATES = ("running", "pause_requested", "cancellation_requested", "succeeded", "paused", "queued")


def e22_settled(spark, d):
    e = fx.operation_events(spark, d)
    n = F.col("event_id")
    runs = e.select("operation_id").distinct().withColumn("status", pick(F.col("operation_id"), *RUN_STATES))
    effects = e.select("operation_id", F.when(n % 3 != 0, "process.preprocess").otherwise("process.model").alias("kind"), F.when(n % 50 < 3, "unknown").otherwise("succeeded").alias("status"))
    return ctl.settle_runs(runs, effects)


def e08_tick(spark, d):
    current = ev.sequenced(fx.operation_events(spark, d)).groupBy("operation_id").agg(F.max("epoch").alias("epoch")).filter("operation_id % 20 <> 0")
    seen = ev.sequenced(fx.operation_events(spark, d)).select("event_id", "operation_id", "event_type", "revision", "epoch")
    return ctl.dispatch_tick(log.outbox(spark, d), seen, current, log.now(), 2000)


def e23_admission(spark, d):
    """Every document is declared once; by its number as new, as a replacement, or as a repeated upload."""
    doc = F.col("doc_id")
    r = fx.sample_revisions(spark, d).filter("revision = 1")
    s = fx.samples(spark, d).select("id", "doc_id", "source_key", "modality", "revision")
    base = r.select("sample_id", "sha256", "size_bytes").join(s, F.col("sample_id") == F.col("id"))
    target, expected = F.when(doc % 4 == 1, F.col("id")), F.when(doc % 4 == 1, F.lit(1).cast("long"))
    origins = base.select(F.concat(F.lit("i"), doc.cast("string")).alias("id"), pick(doc, "cancelled", "accepted", "failed").alias("state"), pick(F.floor(doc / 3), "failed", "running", "cancelled").alias("operation_status"), "source_key", "modality", "sha256", "size_bytes", F.lit("{}").alias("metadata"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("long").alias("expected_revision")).filter("id not like '%7'")
    items = base.select(F.floor(doc / 5).alias("batch"), (doc % 5).alias("position"), F.when(doc % 13 == 0, F.concat("source_key", F.lit("!"))).otherwise(F.col("source_key")).alias("source_key"), "modality", "sha256", F.when(doc % 17 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"), F.lit("{}").alias("metadata"), target.alias("target"), expected.alias("expected_revision"), F.when(doc % 4 == 2, F.concat(F.lit("i"), doc.cast("string"))).alias("retry_of"))
    known = s.filter("doc_id % 4 < 2 and doc_id % 3 <> 2")
    return ctl.admit_items(items, known, origins)


def p10_finalize(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("n"), (F.col("o_custkey") % 40).cast("long").alias("dataset_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("at")).distinct()
    n = F.col("n")
    groups = o.select(n.alias("group_id"), "dataset_id", F.when(n % 19 == 0, "published").when(n % 17 == 0, "collecting").otherwise("prepared").alias("state"), F.when(n % 13 == 0, "paused").otherwise("running").alias("operation_status"), "at", (F.col("at") + F.expr("interval 24 hours")).alias("expires_at"), pick(n, "current_draft", "selected").alias("mode"), F.concat(F.lit("v"), (n % 200).cast("string")).alias("label"), F.when(n % 11 == 0, "preparing").otherwise("sealed").alias("candidate_state"), (n % 23 != 0).alias("same_generation"), (n % 7 != 0).alias("gate_passed"), (n % 3).alias("source_revision"))
    datasets = spark.range(40).filter("id % 20 <> 7").select(F.col("id").alias("dataset_id"), F.when(F.col("id") % 9 == 0, "archived").otherwise("active").alias("availability"), (F.col("id") % 3).alias("draft_revision"))
    versions = o.filter("n % 29 = 0").select("dataset_id", F.concat(F.lit("v"), (n % 200).cast("string")).alias("label"))
    return ctl.finalize(groups, datasets, versions, F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"))


def truth_parts(spark, d):
    """Documents in datasets of their group of eight sources; every tenth of the members isn't asked for."""
    doc = F.col("doc_id")
    m = fx.truth_members(spark, d)
    dataset = F.concat(F.lit("t"), F.floor(doc / 40).cast("string"))
    current = m.select(dataset.alias("dataset"), "sample_id", "group", "content_digest")
    part = F.when(F.floor(doc / 40) % 2 == 0, "train").otherwise(F.col("partition"))
    name = F.concat(F.lit("c"), doc.cast("string"), F.lit("-0"))
    labels = fx.table(spark, d, "labels").select(F.col("doc_id").alias("__l"))
    j = m.join(labels, doc == F.col("__l"), "left")
    bad = F.floor(doc / 40) % 4 >= 2  # datasets in which something is left out, not labelled or not audited
    asked = j.filter(~(bad & (doc % 40 == 9))).select(dataset.alias("dataset"), "sample_id", part.alias("partition"), F.when(F.col("__l").isNotNull() & (~bad | (doc % 40 != 3)), name).alias("canonical_id"), (F.col("__l").isNotNull() & (part == "production") & (~bad | (doc % 3 != 0))).alias("audited"))
    heads = fx.canonical(spark, d).filter("position = 0").select("id", (F.col("unresolved") & (F.substring("unit", -1, 1) == "0")).alias("unresolved"))
    return asked, current, heads


def p07_truth_checks(spark, d):
    return ctl.truth_checks(*truth_parts(spark, d))


def p07_publish(spark, d):
    checks = ctl.truth_checks(*truth_parts(spark, d))
    # Documents without labels can't be published: such rows are left to the checks above.
    ready = checks.filter("problem is null or problem in ('not_assigned', 'leaks')")
    n = F.substring("dataset", 2, 12).cast("long")
    drafts = checks.select("dataset").distinct().select("dataset", (n % 5).alias("revision"), (n % 5 + F.when(n % 6 == 5, 1).otherwise(0)).alias("expected_revision"))
    return ctl.publish_truth(ready, drafts, most=30)


RETRY = "select c.event_id as command_id, c.operation_id, action, c.epoch as asked, o.kind, o.status, o.epoch as now_epoch, o.revision, o.operation_id is null as missing, o.operation_id % 5 = 0 as unknown from (select event_id, operation_id + case when event_id % 50 = 0 then 1000000000 else 0 end as operation_id, 1 + event_id % 2 as epoch, ['pause', 'request_cancel', 'retry'][1 + event_id % 3] as action from event) c left join operation o using (operation_id)"
JUDGED = f"""ruled as (select *, case
  when missing then {{'o': 'not_found'}} when asked <> now_epoch then {{'o': 'stale'}}
  when kind = 'process_flow' and action = 'pause' then case when status in ('queued', 'running') then {{'o': 'applied', 's': if(unknown, 'pause_requested', 'paused')}} when status = 'paused' then {{'o': 'unchanged'}} else {{'o': 'refused'}} end
  when kind = 'process_flow' and action = 'request_cancel' then case when status = 'cancelled' then {{'o': 'unchanged'}} else {{'o': 'applied', 's': if(unknown, 'cancellation_requested', 'cancelled')}} end
  when kind = 'process_flow' then case when status in ('failed', 'reconciliation_needed') and not unknown then {{'o': 'applied', 's': 'queued'}} else {{'o': 'refused'}} end
  when action = 'request_cancel' and status in ('queued', 'running') then {{'o': 'applied', 's': 'cancellation_requested'}}
  when action = 'retry' and (status = 'failed' or status = 'cancelled' and kind = 'ingest_cleanup') then {{'o': 'applied', 's': 'queued'}}
  else {{'o': 'refused'}} end as r from ({RETRY})), judged as (select *, r.o as outcome, r.s as after from ruled)"""
TRUTH = (
    "part as (select doc_id, 't' || (doc_id // 40) as dataset, sample_id, \"group\", content_digest, case when (doc_id // 40) % 2 = 0 then 'train' else partition end as partition, l.d is not null as labelled, (doc_id // 40) % 4 >= 2 as bad from truth_member left join (select doc_id as d from labels) l on l.d = doc_id)",
    "asked as (select *, case when labelled and (not bad or doc_id % 40 <> 3) then 'c' || doc_id || '-0' end as canonical_id, labelled and partition = 'production' and (not bad or doc_id % 3 <> 0) as audited, bad and doc_id % 40 = 9 as absent from part)",
    "crossed as (select dataset, 'g' as k, \"group\" as v from asked where not absent group by 1, 3 having min(partition) <> max(partition) union all select dataset, 'c', content_digest from asked where not absent group by 1, 3 having min(partition) <> max(partition))",
    "checked as (select a.dataset, a.sample_id, case when not absent then partition end as partition, case when not absent then a.canonical_id end as canonical_id, case when absent then 'not_assigned' when a.canonical_id is not null and coalesce(h.unresolved, true) then 'not_reviewed' when partition <> 'production' and a.canonical_id is null then 'not_labelled' when partition = 'production' and a.canonical_id is not null and not audited then 'not_audited' when audited and not (partition = 'production' and a.canonical_id is not null) then 'audit_misplaced' when exists (select 1 from crossed x where x.dataset = a.dataset and ((x.k = 'g' and x.v = a.\"group\") or (x.k = 'c' and x.v = a.content_digest))) then 'leaks' end as problem from asked a left join (select id, unresolved and right(unit, 1) = '0' as unresolved from canonical where position = 0) h on h.id = a.canonical_id and not absent)",
)

QUERIES = {
    "e02_commands": (e02_commands, with_tables("event", "select command_id, operation_id, outcome, case when outcome = 'applied' then after else status end as status, now_epoch + case when outcome = 'applied' and action = 'retry' then 1 else 0 end as epoch, revision + case when outcome = 'applied' then 1 else 0 end as revision from judged", OPERATION, JUDGED)),
    "e03_retries_by_epoch": (e03_retries_by_epoch, with_tables("event", "select action, count(*) filter (outcome = 'applied') as applied, count(*) filter (outcome = 'applied' and action = 'retry') as new_epochs from judged group by 1", OPERATION, JUDGED)),
    "e22_settled": (e22_settled, with_tables("event", f"select operation_id, case when status in ('succeeded', 'paused', 'cancelled') then status when status = 'pause_requested' and u = 0 then 'paused' when status = 'cancellation_requested' and u = 0 then 'cancelled' when status in ('pause_requested', 'cancellation_requested') then status when u = 0 then 'failed' else 'reconciliation_needed' end as status, case when status in ('succeeded', 'paused', 'cancelled') then 0 else r end as recomputed, u as unknown from (select operation_id, {sql_pick('operation_id', *RUN_STATES)} as status, count(*) filter (event_id % 50 < 3 and event_id % 3 <> 0) as r, count(*) filter (event_id % 50 < 3 and event_id % 3 = 0) as u from event group by 1)")),
    "e08_tick": (e08_tick, with_tables("event", f"select i.event_id, i.operation_id, 1::bigint as attempts, i.outcome, i.outcome = 'applied' as submitted from inbox i join (select event_id from outbox where not dispatched and (lease_until is null or lease_until <= timestamp '{log.NOW}') order by created_at, event_id limit 2000) c using (event_id)", log.OUTBOX, log.SEQ, log.INBOX)),
    "e23_admission": (e23_admission, with_tables("sample", "select batch, position, outcome, bool_and(outcome = 'admitted') over (partition by batch) as batch_admitted, case when bool_and(outcome = 'admitted') over (partition by batch) then retry_of end as superseded from (select doc_id // 5 as batch, doc_id % 5 as position, case when doc_id % 4 = 2 then 'i' || doc_id end as retry_of, case when doc_id % 4 = 2 and doc_id % 10 = 7 then 'origin_not_found' when doc_id % 4 = 2 and (doc_id // 3) % 3 = 1 then 'origin_active' when doc_id % 4 = 2 and doc_id % 3 = 1 then 'origin_closed' when doc_id % 4 = 2 and (doc_id % 13 = 0 or doc_id % 17 = 0) then 'declaration_changed' when doc_id % 4 = 1 and doc_id % 3 = 2 then 'not_found' when doc_id % 4 = 1 and revision <> 1 then 'stale' when doc_id % 4 = 1 and doc_id % 13 = 0 then 'identity_changed' when doc_id % 4 <> 1 and doc_id % 13 <> 0 and doc_id % 4 < 2 and doc_id % 3 <> 2 then 'taken' else 'admitted' end as outcome from sample)")),
    "p10_finalize": (p10_finalize, "with g as (select distinct o_orderkey::bigint as n, (o_custkey % 40)::bigint as dataset_id, o_orderdate as placed from orders), judged as (select n, dataset_id, case when dataset_id % 20 = 7 then 'not_found' when n % 19 = 0 then 'unchanged' when dataset_id % 9 = 0 then 'archived' when n % 17 = 0 or n % 13 = 0 then 'not_prepared' when placed + interval 24 hour <= timestamp '1995-01-01' then 'expired' when n % 11 = 0 or n % 23 = 0 then 'not_sealed' when n % 7 = 0 then 'gate_failed' when n % 2 = 0 and dataset_id % 3 <> n % 3 then 'draft_changed' when exists (select 1 from g v where v.n % 29 = 0 and v.dataset_id = g.dataset_id and v.n % 200 = g.n % 200) then 'label_taken' else 'published' end as outcome from g) select n as group_id, dataset_id, case when outcome = 'published' and row_number() over (partition by dataset_id, n % 200, outcome order by n) > 1 then 'label_taken' else outcome end as outcome from judged"),
    "p07_truth_checks": (p07_truth_checks, with_tables("truth_member canonical", "select * from checked", *TRUTH)),
    "p07_publish": (p07_publish, with_tables("truth_member canonical", """select dataset, outcome, members, case when outcome = 'published' then revision + 1 end as revision, case when outcome = 'published' then digest end as digest from (select *, case when n % 6 = 5 then 'stale' when members is null then 'empty' when members > 30 then 'too_many' when problem is not null then 'refused' else 'published' end as outcome from (select distinct dataset, cast(substr(dataset, 2) as bigint) as n, cast(substr(dataset, 2) as bigint) % 5 as revision from checked) left join (select dataset, count(*) as members, min(problem) as problem, sha256('[' || string_agg('{"canonical_id":' || coalesce('"' || canonical_id || '"', 'null') || ',"partition":' || coalesce('"' || partition || '"', 'null') || ',"sample_id":"' || sample_id || '"}', ',' order by sample_id) || ']') as digest from checked where problem is null or problem in ('not_assigned', 'leaks') group by 1) using (dataset))""", *TRUTH)),
}
