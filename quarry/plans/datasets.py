"""Snapshots, quality reports, versions and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions import canonical, text
from quarry.operators import commits
from quarry.operators import publication as pub
from quarry.operators import quality, temporal
from quarry.operators.graph import shared_folder
from quarry.operators.quality import Rule
from quarry.sources import fixtures as fx
from quarry.sources import manifests
from quarry.sources.fixtures import with_tables

AT = 4
RULES = [
    Rule("r1", "minimum_samples", True, None, 10),
    Rule("r2", "minimum_samples", False, "production", 1_000_000),
    Rule("r3", "required_metadata", True, None, key="quality", max_missing="0.75"),
    Rule("r4", "required_metadata", True, "test", key="toxic", max_missing="0.1"),
    Rule("r5", "required_metadata", False, "validation", key="toxic"),
]


def sealed(spark, d):
    """The members of all drafts at one revision, with their metadata."""
    return temporal.as_of(fx.memberships(spark, d), AT).join(fx.metadata(spark, d), "sample_id", "left")


def t01_membership_asof(spark, d):
    return temporal.as_of(fx.memberships(spark, d), 3, "src3").select("sample_id", "split", "valid_from", "valid_to")


def t01_membership_asof_many(spark, d):
    m = fx.memberships(spark, d)
    drafts = m.select("draft_id").distinct().select("draft_id", F.explode(F.array(*[F.lit(r).cast("long") for r in (1, 3, 5, 7)])).alias("revision"))
    return temporal.as_of_many(m, drafts).groupBy("draft_id", "at_revision").agg(F.count(F.lit(1)).alias("members"))


def change_log(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.col("source").alias("draft_id"), F.explode((F.sequence(F.lit(1), F.lit(5))).cast("array<bigint>")).alias("revision"))
    split = F.when((F.col("doc_id") + F.col("revision")) % 5 == 0, F.lit(None).cast("string")).when((F.col("doc_id") * F.col("revision")) % 4 < 2, "train").otherwise("test")
    return docs.select("draft_id", F.concat(F.lit("doc-"), fx.pad(F.col("doc_id"))).alias("sample_id"), "revision", split.alias("split"))


CHANGES = "change_log as (select source as draft_id, 'doc-' || lpad(cast(doc_id as varchar), 12, '0') as sample_id, r as revision, case when (doc_id + r) % 5 = 0 then null when (doc_id * r) % 4 < 2 then 'train' else 'test' end as split from documents, range(1, 6) t(r))"


def t02_interval_build(spark, d):
    return temporal.build_intervals(change_log(spark, d))


def t02_committed(spark, d):
    """Three batches of edits committed one after another; those of one source expect an old revision from the second on."""
    root = f"{shared_folder(spark.sparkContext).rstrip('/')}/membership-{uuid.uuid4().hex}"
    table = commits.Versioned(spark, root, commits.MEMBERSHIP, "draft_id")
    log = change_log(spark, d)
    for r in (1, 2, 3):
        expected = F.when((F.col("draft_id") == "src3") & (F.col("revision") > 1), 0).otherwise(F.col("revision") - 1)
        commits.apply_edits(table, log.filter(F.col("revision") == r).select("draft_id", expected.cast("long").alias("expected_revision"), "sample_id", "split"))
    return commits.members_of(table.read())


def t03_removed(spark, d):
    built = temporal.build_intervals(change_log(spark, d))
    return built.groupBy("draft_id").agg(F.count_if(F.col("valid_to").isNull()).alias("open"), F.count(F.lit(1)).alias("intervals"))


def t04_interval_violations(spark, d):
    m = fx.memberships(spark, d)
    broken = m.withColumn("valid_to", F.when(F.col("doc_id") % 16 == 0, F.col("valid_to") + 2).when(F.col("doc_id") % 12 == 0, F.col("valid_from")).otherwise(F.col("valid_to")))
    return temporal.interval_violations(broken)


def t05_capture(spark, d):
    drafts = fx.memberships(spark, d).groupBy("draft_id").agg(F.max("valid_from").alias("revision"))
    body = canonical.canonical_object({"draft_id": F.col("draft_id"), "revision": F.col("revision")})
    return drafts.select("draft_id", F.col("revision").alias("source_revision"), canonical.digest(body).alias("request_digest"))


def t06_snapshot_pages(spark, d):
    rows = temporal.as_of(fx.memberships(spark, d), 3)
    return temporal.page_numbers(rows, "draft_id", "sample_id", 10).select("draft_id", "sample_id", "page")


def t07_generation_page(spark, d):
    rows = temporal.as_of(fx.memberships(spark, d), AT, "src5").filter("sample_id > 'doc-000000000020'")
    return rows.orderBy("sample_id").limit(20).select("sample_id", "split")


def t08_selection_check(spark, d):
    m = fx.memberships(spark, d).groupBy("draft_id").agg(F.max("valid_from").alias("revision"))
    s = m.select("draft_id", F.when(F.length("draft_id") % 2 == 0, "sealed").otherwise("preparing").alias("state"), (F.col("revision") - F.col("revision") % 2).alias("source_revision"), "revision")
    return s.select("draft_id", F.when(F.col("state") != "sealed", "not_sealed").when(F.col("source_revision") != F.col("revision"), "stale").otherwise("current").alias("status"))


def t09_carried_binding(spark, d):
    r = fx.sample_revisions(spark, d).withColumn("sha256", F.when(F.col("doc_id") % 14 == 0, F.lit("same")).otherwise(F.col("sha256"))).withColumn("size_bytes", F.when(F.col("doc_id") % 14 == 0, F.lit(1)).otherwise(F.col("size_bytes")))
    return temporal.carried_bindings(r)


def t10_availability(spark, d):
    e = fx.table(spark, d, "events")
    action = F.element_at(F.array(*map(F.lit, ("archive", "unarchive", "deprecate", "activate"))), (F.col("event_id") * 7 % 4 + 1).cast("int"))
    return temporal.availability_fold(e.select(F.col("user_id").cast("long").alias("version"), F.col("event_id").cast("long").alias("seq"), action.alias("action")))


def a03_minimum(spark, d):
    rules = [r for r in RULES if r.kind == "minimum_samples"]
    return quality.statuses(quality.counters(sealed(spark, d), rules), rules).select("rule_id", "examined", "status")


def a04_quality_report(spark, d):
    return quality.report(sealed(spark, d), RULES)


def a05_exact_fraction(spark, d):
    rules = [Rule(f"t{i}", "required_metadata", key="quality", max_missing=t) for i, t in enumerate(("0", "0.5", "0.625", "0.7", "1"))]
    return quality.statuses(quality.counters(sealed(spark, d), rules), rules).select("rule_id", "status")


def a06_offenders(spark, d):
    return quality.offenders(sealed(spark, d), RULES, 10)


def a07_merge(spark, d):
    m = sealed(spark, d)
    odd = F.substring("sample_id", -1, 1).cast("int") % 2 == 1
    return quality.merge_counters(quality.counters(m.filter(odd), RULES), quality.counters(m.filter(~odd), RULES))


def a07_merged_report(spark, d):
    """The report of three batches of members, each with a state of its own, the first two merged before the third comes."""
    m = sealed(spark, d).withColumn("n", F.substring("sample_id", -2, 2).cast("int") % 3)
    one, two, three = (quality.partial(m.filter(F.col("n") == i).drop("n"), RULES) for i in range(3))
    return quality.finish(quality.merge_states(three, quality.merge_states(one, two)), RULES)


def a08_gate(spark, d):
    return quality.gate(quality.report(sealed(spark, d), RULES))


def f19_running_view(spark, d):
    return quality.running_view(quality.report(sealed(spark, d), RULES), "running").select("rule_id", "status")


def members(spark, d):
    m = temporal.as_of(fx.memberships(spark, d), AT).withColumn("revision", F.lit(1).cast("long"))
    return pub.version_members(m, fx.sample_revisions(spark, d), fx.samples(spark, d), fx.artifacts(spark, d))


MEMBERS = "member as (select m.sample_id, r.id as revision_id, m.split, s.source_key, r.sha256, r.size_bytes, a.artifact_id, a.verified, a.collection_state from membership m join sample_revision r on m.sample_id = r.sample_id and r.revision = 1 join sample s on s.id = r.sample_id left join artifact a on a.artifact_id = r.sha256 where m.valid_from <= 4 and (m.valid_to is null or m.valid_to > 4))"
NEEDED = "membership sample_revision sample artifact"
REPORT = "select r.id as rule_id, r.kind, r.required, r.split, count(m.sample_id) as examined, count(case when m.sample_id is not null and r.kind = 'm' and (case r.key when 'quality' then m.quality else m.toxic end is null or case r.key when 'quality' then m.quality else m.toxic end = 'null') then 1 end) as failures, r.minimum, r.num, r.den from rule r left join sealed m on r.split is null or r.split = m.split group by all"
SEALED = "sealed as (select * from membership m left join metadata d using (sample_id) where m.valid_from <= 4 and (m.valid_to is null or m.valid_to > 4))"
RULE = "rule(id, kind, required, split, key, minimum, num, den) as (values ('r1', 'n', true, null, '', 10, 0, 1), ('r2', 'n', false, 'production', '', 1000000, 0, 1), ('r3', 'm', true, null, 'quality', 0, 3, 4), ('r4', 'm', true, 'test', 'toxic', 0, 1, 10), ('r5', 'm', false, 'validation', 'toxic', 0, 0, 1))"
STATUS = "case when kind = 'n' then case when examined >= minimum then 'passed' else 'failed' end when examined = 0 then 'unknown' when failures * den <= num * examined then 'passed' else 'failed' end"
OFFEND = "offender as (select r.id as rule_id, m.sample_id, row_number() over (partition by r.id order by m.sample_id) as n from rule r join sealed m on r.kind = 'm' and (r.split is null or r.split = m.split) where case r.key when 'quality' then m.quality else m.toxic end is null or case r.key when 'quality' then m.quality else m.toxic end = 'null')"


def report_sql(body: str) -> str:
    return with_tables("membership metadata", body, SEALED, RULE, f"counted as ({REPORT})", OFFEND)


def j02_version_members(spark, d):
    return members(spark, d)


def j05_preview_binding(spark, d):
    loc = fx.locations(spark, d)
    return members(spark, d).filter("verified").join(loc, "artifact_id").select("sample_id", "artifact_id", F.col("id").alias("location_id"))


def j13_readiness(spark, d):
    return pub.readiness(members(spark, d), 100)


def f21_evidence(spark, d):
    return members(spark, d).select("sample_id", (F.coalesce("verified", F.lit(False)) & (F.col("collection_state") == "active")).alias("intact"))


def k07_verification_work(spark, d):
    return pub.verification_work(members(spark, d))


def x03_lineage(spark, d):
    return pub.lineage(members(spark, d))


def x03_lineage_status(spark, d):
    return pub.lineage_status(pub.lineage(members(spark, d)))


def s08_manifest_members(spark, d):
    return pub.manifest_members(members(spark, d)).select("sample_id", "digest")


def s08_manifest_round_trip(spark, d):
    """All members of a version as one manifest in the shared folder, read back; each row with the whole file's digest and size."""
    m = members(spark, d)
    whole = m.select("sample_id", F.struct("sample_id", "revision_id", "split", F.struct(F.col("artifact_id").alias("id"), "sha256", "size_bytes").alias("artifact")).alias("x"))
    rows = whole.select("sample_id", canonical.json_of(F.col("x"), whole.schema["x"].dataType).alias("member"))
    path = f"{shared_folder(spark.sparkContext).rstrip('/')}/manifest-{uuid.uuid4().hex}.json"
    made = manifests.write_manifest(rows, path, {"dataset": "d", "zone": 1}, rows.count())
    back = manifests.read_manifest(spark, path, {"dataset": "d"})
    return back.select("sample_id", F.sha2("member", 256).alias("member_sha256"), F.lit(made["sha256"]).alias("sha256"), F.lit(made["size_bytes"]).cast("long").alias("size_bytes"))


def p09_batch_differences(spark, d):
    m = members(spark, d).select("sample_id", "revision_id", "split")
    batch = m.withColumn("split", F.when(F.col("sample_id").endswith("7"), "test").otherwise(F.col("split")))
    return pub.accepted_batch(batch, m)


def e15_collectable(spark, d):
    a = fx.artifacts(spark, d)
    held = [a.filter(F.col("first_doc") % n == 0) for n in (5, 7, 11)]
    return pub.collectable(a, *held, fx.locations(spark, d))


def s19_deletions(spark, d):
    """Artifacts deleted by a worker of one store; protected are those of every fifth, seventh and eleventh first document."""
    a = fx.artifacts(spark, d)
    held = [a.filter(F.col("first_doc") % n == 0) for n in (5, 7, 11)]
    loc = fx.locations(spark, d).withColumn("store_id", F.when(F.substring("artifact_id", 1, 1) < "8", F.lit("store1")).otherwise(F.col("store_id")))
    seen = loc.withColumn("outcome", F.when(F.substring("artifact_id", 2, 1) < "6", F.lit("missing")).otherwise(F.col("outcome")))
    return pub.deletions(a.select("artifact_id", "collection_state"), held, seen, "store1")


def s02_verify(spark, d):
    docs = fx.table(spark, d, "documents")
    declared = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"), (F.octet_length("text") + F.when(F.col("doc_id") % 15 == 0, 1).otherwise(0)).alias("size"), F.when(F.col("doc_id") % 12 != 0, F.col("text").cast("binary")).alias("content"))
    status = F.when(F.col("content").isNull(), "missing").when(F.octet_length("content") != F.col("size"), "corrupt").when(F.sha2("content", 256) != F.col("sha256"), "corrupt").otherwise("verified")
    return declared.select("doc_id", status.alias("status"))


def s03_range_read(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.hex(F.substring(F.col("text").cast("binary"), 11, 16)).alias("bytes"))


def x05_transforms(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(F.lower(text.strip(F.concat(F.lit("  \t"), "text", F.lit("\n ")))), 256).alias("sha256"))


def nested_metadata(spark, d):
    """doc_id and metadata of nested keys out of order, with a control character in each text."""
    docs = fx.table(spark, d, "documents")
    text_ = F.concat(F.col("text"), F.char(F.col("doc_id") % 32), F.lit('"\\/'))
    inner = F.struct(F.create_map(F.lit("é"), F.col("n_chars") / 8, F.lit("b"), -F.col("doc_id") / 4, F.col("source"), F.lit(None).cast("double")).alias("scores"), F.array(F.struct(F.col("lang").alias("z"), (F.col("doc_id") % 2 == 0).alias("A"))).alias("list"), text_.alias("Text"))
    return docs.select("doc_id", F.struct(F.col("doc_id").alias("id"), inner.alias("doc"), F.when(F.col("doc_id") % 3 == 0, inner["list"]).alias("maybe")).alias("metadata"))


def x01_canonical(spark, d):
    rows = nested_metadata(spark, d)
    kind = rows.schema["metadata"].dataType
    return rows.select("doc_id", canonical.digest(canonical.json_of(F.col("metadata"), kind)).alias("sha256"), canonical.digest(canonical.json_of(F.col("metadata"), kind, ascii=True)).alias("ascii_sha256"))


def x01_json_text(spark, d):
    """The same metadata as JSON texts of unknown keys, written in another order and with white space."""
    rows = nested_metadata(spark, d)
    m, inner = F.col("metadata"), F.col("metadata.doc")
    scores = F.to_json(inner["scores"], {"ignoreNullFields": "false"})
    lists = lambda c: F.coalesce(F.to_json(c), F.lit("null"))
    text_ = F.concat(F.lit('{"id" : '), m["id"].cast("string"), F.lit(', "maybe":\t'), lists(m["maybe"]), F.lit(', "doc": {"scores":'), scores, F.lit(', "list": '), lists(inner["list"]), F.lit(' , "Text": '), F.to_json(F.array(inner["Text"])).substr(F.lit(2), F.length(F.to_json(F.array(inner["Text"]))) - 2), F.lit("} }"))
    return rows.select("doc_id", F.sha2(canonical.json_text(text_), 256).alias("sha256"), F.sha2(canonical.json_text(text_, ascii=True), 256).alias("ascii_sha256"))


def x06_digest_chain(spark, d):
    docs = fx.table(spark, d, "documents")
    steps = [text.strip(F.col("text"))]
    steps.append(F.lower(steps[0]))
    inputs = [F.sha2("text", 256), F.sha2(steps[0], 256)]
    rows = docs.select("doc_id", F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("step"), inputs[i].alias("input_digest"), F.sha2(canonical.canonical_object({"text": steps[i]}), 256).alias("output_digest")) for i in range(2)])))
    return rows


def x07_effect_identity(spark, d):
    e = fx.operation_events(spark, d).select(F.sha2(canonical.canonical_object({"item": F.col("operation_id").cast("string"), "kind": F.col("event_type")}), 256).alias("effect_key"), F.sha2(F.round(F.col("value")).cast("long").cast("string"), 256).alias("request_digest"))
    return e.groupBy("effect_key").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("request_digest") > 1).alias("conflict"))


def x08_invocation_key(spark, d):
    e = fx.operation_events(spark, d).select("operation_id").distinct()
    key = F.concat_ws(":", F.lit("quarry"), F.lit("ns1"), F.col("operation_id").cast("string"), F.lit("1"))
    return e.select("operation_id", key.alias("invocation_key"), F.sha2(key, 256).alias("digest"))


def x04_group_key(spark, d):
    from quarry.operators import truth

    docs = fx.table(spark, d, "documents")
    group = F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 7 == 0, F.lit("  ")).otherwise(F.col("source"))
    return docs.select("doc_id", truth.group_key(group, F.col("doc_id").cast("string")).alias("group_key"))


def p11_manifest_order(spark, d):
    m = members(spark, d).withColumn("position", F.substring("sample_id", -6, 6).cast("long") % 97).withColumn("scope", F.col("split"))
    return pub.order_violations(m.groupBy("scope", "position").agg(F.min("sample_id").alias("sample_id")), "scope").select("scope", "position", "sample_id")


WHITE = "[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]"
STRIP = "regexp_replace(regexp_replace({}, '^" + WHITE + "+', ''), '" + WHITE + "+$', '')"
#: JSON strings character by character: a control by its code, whatever its place.
ESCAPED = "array_to_string(list_transform(regexp_extract_all({}, '(?s).'), lambda c: case c when '\"' then '\\\"' when '\\' then '\\\\' when chr(10) then '\\n' when chr(13) then '\\r' when chr(9) then '\\t' when chr(8) then '\\b' when chr(12) then '\\f' else case when unicode(c) < 32 then printf('\\u%04x', unicode(c)) else c end end), '')"
ASCII = ESCAPED.replace("unicode(c) < 32", "unicode(c) < 32 or unicode(c) > 126")


def _nested(escaped: str) -> str:
    q = lambda x: "'\"' || " + escaped.format(x) + " || '\"'"
    entry = lambda k, v: f"{{'k': {k}, 'v': {v}}}"
    entries = ", ".join([entry("'é'", "cast(n_chars / 8 as varchar)"), entry("'b'", "cast(-doc_id / 4 as varchar)"), entry("source", "'null'")])
    scores = f"(select string_agg({q('e.k')} || ':' || e.v, ',' order by e.k) from (select unnest([{entries}]) as e))"
    listed = f"""'[{{"A":' || (doc_id % 2 = 0) || ',"z":' || coalesce({q('lang')}, 'null') || '}}]'"""
    text = q("text || chr((doc_id % 32)::int) || '\"\\\\/'".replace("\\\\", "\\"))
    return f"""sha256('{{"doc":{{"Text":' || {text} || ',"list":' || {listed} || ',"scores":{{' || {scores} || '}}}},"id":' || doc_id || ',"maybe":' || case when doc_id % 3 = 0 then {listed} else 'null' end || '}}')"""


NESTED = f"select doc_id, {_nested(ESCAPED)} as sha256, {_nested(ASCII)} as ascii_sha256 from documents"

A04 = report_sql(f"select rule_id, required, split, {STATUS} as status, examined, failures, coalesce((select string_agg(sample_id, ',' order by sample_id) from offender o where o.rule_id = c.rule_id and n <= 25), '') as offending, failures > 25 as truncated from counted c")

QUERIES = {
    "t01_membership_asof": (t01_membership_asof, with_tables("membership", "select sample_id, split, valid_from, valid_to from membership where draft_id = 'src3' and valid_from <= 3 and (valid_to is null or valid_to > 3)")),
    "t01_membership_asof_many": (t01_membership_asof_many, with_tables("membership", "select m.draft_id, r as at_revision, count(*) as members from membership m, (values (1::bigint), (3), (5), (7)) t(r) where m.valid_from <= r and (m.valid_to is null or m.valid_to > r) group by 1, 2")),
    "t02_interval_build": (t02_interval_build, f"with {CHANGES}, real as (select *, lead(revision) over (partition by draft_id, sample_id order by revision) as valid_to from (select *, lag(split) over (partition by draft_id, sample_id order by revision) as before from change_log) where split is distinct from before) select draft_id, sample_id, split, revision as valid_from, valid_to from real where split is not null"),
    "t02_committed": (t02_committed, f"with {CHANGES}, taken as (select * from change_log where revision <= 3 and (draft_id <> 'src3' or revision = 1)), real as (select *, lead(revision) over (partition by draft_id, sample_id order by revision) as valid_to from (select *, lag(split) over (partition by draft_id, sample_id order by revision) as before from taken) where split is distinct from before) select draft_id, sample_id, split, revision as valid_from, valid_to from real where split is not null"),
    "t03_removed": (t03_removed, f"with {CHANGES}, real as (select *, lead(revision) over (partition by draft_id, sample_id order by revision) as valid_to from (select *, lag(split) over (partition by draft_id, sample_id order by revision) as before from change_log) where split is distinct from before) select draft_id, count(*) filter (valid_to is null) as open, count(*) as intervals from real where split is not null group by 1"),
    "t04_interval_violations": (t04_interval_violations, with_tables("membership", "select draft_id, sample_id, valid_from, valid_to, case when valid_to <= valid_from then 'empty' else 'overlap' end as violation from (select *, lead(valid_from) over (partition by draft_id, sample_id order by valid_from, valid_to nulls last) as nf from broken) where valid_to <= valid_from or nf < coalesce(valid_to, 9223372036854775807)", "broken as (select draft_id, sample_id, valid_from, case when doc_id % 16 = 0 then valid_to + 2 when doc_id % 12 = 0 then valid_from else valid_to end as valid_to from membership)")),
    "t05_capture": (t05_capture, with_tables("membership", "select draft_id, r as source_revision, sha256('{\"draft_id\":\"' || draft_id || '\",\"revision\":' || r || '}') as request_digest from (select draft_id, max(valid_from) as r from membership group by 1)")),
    "t06_snapshot_pages": (t06_snapshot_pages, with_tables("membership", "select draft_id, sample_id, ((row_number() over (partition by draft_id order by sample_id) - 1) // 10)::bigint as page from membership where valid_from <= 3 and (valid_to is null or valid_to > 3)")),
    "t07_generation_page": (t07_generation_page, with_tables("membership", "select sample_id, split from membership where draft_id = 'src5' and valid_from <= 4 and (valid_to is null or valid_to > 4) and sample_id > 'doc-000000000020' order by sample_id limit 20")),
    "t08_selection_check": (t08_selection_check, with_tables("membership", "select draft_id, case when length(draft_id) % 2 <> 0 then 'not_sealed' when r - r % 2 <> r then 'stale' else 'current' end as status from (select draft_id, max(valid_from) as r from membership group by 1)")),
    "t09_carried_binding": (t09_carried_binding, with_tables("sample_revision", "select sample_id, revision, doc_id % 14 = 0 and revision = 2 or coalesce(lag(sha256) over w = sha256 and lag(size_bytes) over w = size_bytes, false) as carried from sample_revision window w as (partition by sample_id order by revision)")),
    "t10_availability": (t10_availability, "with c as (select user_id::bigint as version, event_id::bigint as seq, ['archive', 'unarchive', 'deprecate', 'activate'][1 + event_id * 7 % 4] as action from events), f as (select *, coalesce(last_value(flag ignore nulls) over w, false) as archived, coalesce(last_value(flag ignore nulls) over b, false) as was from (select *, case action when 'archive' then true when 'unarchive' then false end as flag from c) window w as (partition by version order by seq rows between unbounded preceding and current row), b as (partition by version order by seq rows between unbounded preceding and 1 preceding)), u as (select *, coalesce(last_value(sets ignore nulls) over w, 'active') as under, coalesce(last_value(sets ignore nulls) over b, 'active') as under_before from (select *, case when not was and action = 'deprecate' then 'deprecated' when not was and action = 'activate' then 'active' end as sets from f) window w as (partition by version order by seq rows between unbounded preceding and current row), b as (partition by version order by seq rows between unbounded preceding and 1 preceding)) select version, seq, action, case when archived then 'archived' else under end as state, was and action in ('deprecate', 'activate') as refused, sum(case when case when archived then 'archived' else under end <> case when was then 'archived' else under_before end then 1 else 0 end) over (partition by version order by seq rows between unbounded preceding and current row) as revision from u"),
    "a03_minimum": (a03_minimum, report_sql(f"select rule_id, examined, {STATUS} as status from counted where kind = 'n'")),
    "a04_quality_report": (a04_quality_report, report_sql(f"select rule_id, required, split, {STATUS} as status, examined, failures, coalesce((select string_agg(sample_id, ',' order by sample_id) from offender o where o.rule_id = c.rule_id and n <= 25), '') as offending, failures > 25 as truncated from counted c")),
    "a05_exact_fraction": (a05_exact_fraction, with_tables("membership metadata", "select t.id as rule_id, case when e = 0 then 'unknown' when f * t.den <= t.num * e then 'passed' else 'failed' end as status from (values ('t0', 0, 1), ('t1', 1, 2), ('t2', 5, 8), ('t3', 7, 10), ('t4', 1, 1)) t(id, num, den), (select count(*) as e, count(*) filter (quality is null or quality = 'null') as f from sealed)", SEALED)),
    "a06_offenders": (a06_offenders, report_sql("select rule_id, sample_id from offender where n <= 10")),
    "a07_merge": (a07_merge, report_sql("select rule_id, examined, failures from counted")),
    "a07_merged_report": (a07_merged_report, A04),
    "a08_gate": (a08_gate, report_sql(f"select bool_and(not required or status = 'passed') as required_rules_pass, count(*) filter (required) as required_rules, count(*) filter (status = 'passed') as passed from (select required, {STATUS} as status from counted)")),
    "f19_running_view": (f19_running_view, report_sql("select rule_id, 'pending' as status from counted")),
    "f21_evidence": (f21_evidence, with_tables(NEEDED, "select sample_id, coalesce(verified, false) and collection_state = 'active' as intact from member", MEMBERS)),
    "j02_version_members": (j02_version_members, with_tables(NEEDED, "select * from member", MEMBERS)),
    "j05_preview_binding": (j05_preview_binding, with_tables(NEEDED + " location", "select m.sample_id, m.artifact_id, l.id as location_id from member m join location l using (artifact_id) where m.verified", MEMBERS)),
    "j13_readiness": (j13_readiness, with_tables(NEEDED, "select members, unbound, unready, members = 100 and unready = 0 as ready from (select count(*) as members, count(*) filter (artifact_id is null) as unbound, count(*) filter (artifact_id is null or not coalesce(verified, false) or coalesce(collection_state, '') <> 'active') as unready from member)", MEMBERS)),
    "k07_verification_work": (k07_verification_work, with_tables(NEEDED, "select distinct artifact_id, size_bytes from member where artifact_id is not null", MEMBERS)),
    "x03_lineage": (x03_lineage, with_tables(NEEDED, "select sample_id, position, kind, entry_id, case when entry_id is null then 'absent' else 'present' end as status from (select sample_id, p.position::bigint as position, p.kind, case p.kind when 'sample' then sample_id when 'revision' then revision_id when 'content' then sha256 when 'artifact' then artifact_id when 'split' then split end as entry_id from member, (values (0, 'sample'), (1, 'revision'), (2, 'content'), (3, 'artifact'), (4, 'split'), (5, 'annotation'), (6, 'transformation')) p(position, kind))", MEMBERS)),
    "x03_lineage_status": (x03_lineage_status, with_tables(NEEDED, "select sample_id, (2 * count(*) + count(*) filter (artifact_id is null))::bigint as absent, 'partial' as lineage from member group by 1", MEMBERS)),
    "s08_manifest_members": (s08_manifest_members, with_tables(NEEDED, """select sample_id, sha256('{"artifact":{"id":' || coalesce('"' || artifact_id || '"', 'null') || ',"size_bytes":' || size_bytes || '},"revision_id":"' || revision_id || '","sample_id":"' || sample_id || '","split":"' || split || '"}') as digest from member""", MEMBERS)),
    "s08_manifest_round_trip": (s08_manifest_round_trip, with_tables(NEEDED, """select sample_id, sha256(x) as member_sha256, (select sha256(t) from whole) as sha256, (select octet_length(encode(t))::bigint from whole) as size_bytes from text""", MEMBERS, """text as (select sample_id, '{"artifact":{"id":' || coalesce('"' || artifact_id || '"', 'null') || ',"sha256":"' || sha256 || '","size_bytes":' || size_bytes || '},"revision_id":"' || revision_id || '","sample_id":"' || sample_id || '","split":"' || split || '"}' as x from member)""", """whole as (select '{"dataset":"d","members":[' || string_agg(x, ',' order by sample_id) || '],"zone":1}' as t from text)""")),
    "p09_batch_differences": (p09_batch_differences, with_tables(NEEDED, "select sample_id, revision_id, 'test' as split, 'not_sealed' as problem from member where sample_id like '%7' and split <> 'test' union all select sample_id, revision_id, split, 'lacking' from member where sample_id like '%7' and split <> 'test'", MEMBERS)),
    "p11_manifest_order": (p11_manifest_order, with_tables(NEEDED, "select scope, position, sample_id from (select *, lag(sample_id) over (partition by scope order by position) as before from (select split as scope, cast(right(sample_id, 6) as bigint) % 97 as position, min(sample_id) as sample_id from member group by 1, 2)) where before >= sample_id", MEMBERS)),
    "e15_collectable": (e15_collectable, with_tables("artifact location", "select a.artifact_id, count(l.id) as placements from artifact a left join location l using (artifact_id) where first_doc % 5 <> 0 and first_doc % 7 <> 0 and first_doc % 11 <> 0 group by 1 having count(l.id) <= 100")),
    "s19_deletions": (s19_deletions, with_tables("artifact location", "select artifact_id, n as placements, outcome, case outcome when 'unconfirmed' then 'deleting' when 'deleted' then 'deleted' else collection_state end as collection_state from (select *, case when first_doc % 5 = 0 or first_doc % 7 = 0 or first_doc % 11 = 0 then 'protected' when n > 100 or others > 0 then 'unqualified' when gone < n then 'unconfirmed' else 'deleted' end as outcome from (select a.artifact_id, any_value(collection_state) as collection_state, any_value(first_doc) as first_doc, count(l.id) as n, count(l.id) filter (a.artifact_id >= '8' and store_id <> 'store1') as others, count(l.id) filter (substr(a.artifact_id, 2, 1) < '6' or l.outcome = 'missing') as gone from artifact a left join location l using (artifact_id) group by 1))")),
    "s02_verify": (s02_verify, "select doc_id, case when doc_id % 12 = 0 then 'missing' when doc_id % 15 = 0 or doc_id % 10 = 0 then 'corrupt' else 'verified' end as status from documents"),
    "s03_range_read": (s03_range_read, "select doc_id, substr(hex(encode(text)), 21, 32) as bytes from documents"),
    "x01_canonical": (x01_canonical, NESTED),
    "x01_json_text": (x01_json_text, NESTED),
    "x04_group_key": (x04_group_key, "select doc_id, case when doc_id % 3 = 0 then 'sample:' || doc_id when doc_id % 7 = 0 then null else 'group:' || source end as group_key from documents"),
    "x05_transforms": (x05_transforms, f"select doc_id, sha256(lower({STRIP.format('text')})) as sha256 from documents"),
    "x06_digest_chain": (x06_digest_chain, f"""select doc_id, s as step, case s when 0 then sha256(text) else sha256(a) end as input_digest, sha256('{{"text":"' || {ESCAPED.format('case s when 0 then a else b end')} || '"}}') as output_digest from (select *, lower(a) as b from (select doc_id, text, {STRIP.format('text')} as a from documents)), range(0, 2) r(s)"""),
    "x07_effect_identity": (x07_effect_identity, with_tables("event", """select sha256('{"item":"' || operation_id || '","kind":"' || event_type || '"}') as effect_key, count(*) as n, count(distinct cast(round(value) as bigint)) > 1 as conflict from event group by 1""")),
    "x08_invocation_key": (x08_invocation_key, with_tables("event", "select distinct operation_id, 'quarry:ns1:' || operation_id || ':1' as invocation_key, sha256('quarry:ns1:' || operation_id || ':1') as digest from event")),
}
