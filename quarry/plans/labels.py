"""Annotation and truth queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import annotation as a
from quarry.operators import catalog, truth
from quarry.sources import fixtures as fx
from quarry.sources.fixtures import with_tables


def assigned(spark, d):
    units = fx.table(spark, d, "labels").select(fx.pad(F.col("doc_id")).alias("unit"))
    return units.select("unit", F.explode(F.array(*map(F.lit, fx.RATERS))).alias("rater"))


def selected(spark, d):
    return a.selection(fx.originals(spark, d), assigned(spark, d))


def w01_latest(spark, d):
    return a.latest(fx.originals(spark, d)).select("unit", "native_id", "sequence", "label", "state")


def w02_selection(spark, d):
    return selected(spark, d)


def a09_state_counts(spark, d):
    return a.state_counts(selected(spark, d))


def a10_disagreement(spark, d):
    return a.disagreement(selected(spark, d), len(fx.RATERS))


def cells(spark, d):
    return a.confusion(selected(spark, d), list(fx.RATERS), ["0", "1"])


def a11_confusion(spark, d):
    return cells(spark, d)


def a12_kappa(spark, d):
    return a.agreement(cells(spark, d))


def a13_wilson(spark, d):
    low, high = a.wilson(F.col("agreed"), F.col("n"))
    return a.agreement(cells(spark, d)).select("left", "right", low.alias("low"), high.alias("high"))


def p05_agreement_report(spark, d):
    low, high = a.wilson(F.col("agreed"), F.col("n"))
    return a.agreement(cells(spark, d)).withColumns({"low": low, "high": high})


def requested_reports(spark, d):
    """Reports by source of the labelled documents; every seventh document has another schema in two sources, and equal texts are one revision."""
    labelled = fx.table(spark, d, "labels").select("doc_id").join(fx.table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")
    schema = F.when((F.col("doc_id") % 7 == 0) & F.col("source").isin("src1", "src2"), "v2").otherwise("v1")
    return labelled.select(F.col("source").alias("report"), fx.pad(F.col("doc_id")).alias("unit"), F.sha2("text", 256).alias("revision_id"), schema.alias("schema"), F.lit("c").alias("cohort"), F.explode(F.array(*map(F.lit, fx.RATERS))).alias("rater"))


def p05_report_counts(spark, d):
    return a.report_counts(requested_reports(spark, d), selected(spark, d))


def p05_report_pairs(spark, d):
    return a.report_pairs(requested_reports(spark, d), selected(spark, d))


def p16_cohort_admission(spark, d):
    """Suppliers as cohorts admitted, customers as requests: some for two cohorts' origins, some for one that differs, some without a reason."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    name = lambda x, prefix: F.concat(F.lit(prefix), x.cast("string"))
    cohorts = fx.table(spark, d, "supplier").select(name(s, "c").alias("cohort"), F.col("s_nationkey").cast("long").alias("namespace"), F.col("s_name").alias("name"), name(s, "https://b").alias("browser_origin"), name(s, "https://m").alias("machine_origin"), F.lit("image").alias("image"), F.lit("https://issuer").alias("issuer"))
    of = c % 50
    mine = fx.table(spark, d, "customer").withColumn("of", of).join(fx.table(spark, d, "supplier").select(s.alias("of"), "s_name", "s_nationkey"), "of", "left")
    requests = mine.select(c.cast("long").alias("request"), F.coalesce("s_nationkey", F.lit(0)).cast("long").alias("namespace"), F.when(c % 9 == 0, F.lit(" ")).otherwise(F.coalesce("s_name", F.lit("new"))).alias("name"), name(F.when(c % 4 == 0, c + 100_000).otherwise(F.col("of")), "https://b").alias("browser_origin"), name(F.when(c % 7 == 0, F.col("of") + 1).when(c % 4 == 0, c + 100_000).otherwise(F.col("of")), "https://m").alias("machine_origin"), F.when(c % 5 == 0, "other").otherwise("image").alias("image"), F.when(c % 11 == 0, "http://issuer").otherwise("https://issuer").alias("issuer"), F.lit("asked").alias("reason"))
    return a.cohort_admissions(requests, cohorts)


COHORTS = """with request as (select c_custkey::bigint as request, c_custkey % 50 as o, case when c_custkey % 4 = 0 then c_custkey + 100000 else c_custkey % 50 end as b, case when c_custkey % 7 = 0 then c_custkey % 50 + 1 when c_custkey % 4 = 0 then c_custkey + 100000 else c_custkey % 50 end as m, c_custkey % 9 = 0 or c_custkey % 11 = 0 as bad, c_custkey % 5 = 0 as other from customer),
near as (select request, o, b, m, bad, other, x.s_suppkey as xs, y.s_suppkey as ys from request left join supplier x on x.s_suppkey = b left join supplier y on y.s_suppkey = m)
select request, outcome, case when outcome = 'known' then 'c' || xs end as cohort from (select *, case when bad then 'invalid' when xs <> ys then 'overlaps' when xs is null and ys is null then 'admitted' when xs = ys and xs = o and not other then 'known' else 'shared' end as outcome from near)"""
REPORTS = "asked as (select source as report, lpad(cast(l.doc_id as varchar), 12, '0') as unit, text, l.doc_id % 7 = 0 and source in ('src1', 'src2') as other from labels l join documents d using (doc_id)), judged as (select report, case when count(distinct other) > 1 then 'mixed' when count(distinct text) <> count(distinct unit) then 'repeated' when count(distinct unit) > 100 then 'too_many' else 'created' end as outcome from asked group by 1)"


def w03_import_diff(spark, d):
    known = a.latest(fx.originals(spark, d)).select("unit", "native_id", "sequence", "native_deleted", F.coalesce("label", F.lit("-")).alias("digest"))
    labels = fx.table(spark, d, "labels").select("doc_id", "quality")
    incoming = labels.filter("doc_id % 4 <> 1").select(fx.pad(F.col("doc_id")).alias("unit"), F.concat_ws("-", F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, F.lit("z")).otherwise(F.lit("a"))).alias("native_id"), F.col("quality").cast("string").alias("digest"))
    return a.import_diff(known.filter("native_id like '%-a'"), incoming)


def p04_assignment_detail(spark, d):
    return a.assignment_detail(assigned(spark, d), fx.originals(spark, d), catalog.heads(fx.canonical(spark, d)))


def p16_cohort_overlap(spark, d):
    o = fx.originals(spark, d).select("rater", F.substring("unit", -2, 2).alias("cohort")).distinct()
    return o.groupBy("cohort").agg(F.count(F.lit(1)).alias("contributors"), F.array_join(F.sort_array(F.collect_list("rater")), ",").alias("raters"))


def a14_leakage(spark, d):
    return truth.leakage(fx.truth_members(spark, d))


def history(spark, d):
    m = fx.truth_members(spark, d)
    return m.filter("doc_id % 6 < 3").withColumn("partition", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))


HISTORY = "history as (select sample_id, doc_id, \"group\", content_digest, case when doc_id % 5 = 0 then 'test' else 'train' end as partition from truth_member where doc_id % 6 < 3)"


def a15_reuse(spark, d):
    return truth.reused_test(fx.truth_members(spark, d), history(spark, d)).select("sample_id", "partition")


def a16_confirmation(spark, d):
    return truth.fresh_confirmation(fx.truth_members(spark, d), history(spark, d))


def a25_audit_counts(spark, d):
    m = fx.truth_members(spark, d).withColumn("audit", F.when(F.col("doc_id") % 3 == 0, "ok"))
    return m.groupBy("partition").agg(F.count(F.lit(1)).alias("members"), F.count("audit").alias("audited"))


def w05_components(spark, d):
    return truth.train_components(fx.truth_members(spark, d))


def w05_validation_split(spark, d):
    return truth.validation_split(fx.truth_members(spark, d))


def w05_error_status(spark, d):
    m = fx.truth_members(spark, d).withColumn("group", F.lit("one"))
    return truth.validation_split(m).groupBy("status").agg(F.count(F.lit(1)).alias("groups"))


def p08_workspace(spark, d):
    heads = catalog.heads(fx.canonical(spark, d))
    m = fx.table(spark, d, "labels").select(fx.pad(F.col("doc_id")).alias("unit"))
    return truth.workspace(m, heads).select("unit", "canonical_id", "label", "unresolved")


def j12_latest_truth(spark, d):
    v = fx.truth_members(spark, d).select(F.col("partition").alias("dataset"), F.col("doc_id").alias("pinned_revision"), F.col("sample_id").alias("id"))
    return v.groupBy("dataset").agg(F.max("pinned_revision").alias("pinned_revision"), F.max_by("id", "pinned_revision").alias("id"))


def p06_adjudication(spark, d):
    heads = catalog.heads(fx.canonical(spark, d))
    asked = fx.table(spark, d, "labels").select(fx.pad(F.col("doc_id")).alias("unit"), F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("-1")).alias("expected_head"), F.when(F.col("doc_id") % 4 != 0, F.lit("1")).alias("label"))
    j = asked.join(heads.select("unit", F.col("id").alias("head")), "unit", "left")
    ok = F.col("head") == F.col("expected_head")
    return j.select("unit", F.when(ok, "appended").otherwise("stale").alias("outcome"), F.when(ok, F.col("label").isNull()).alias("unresolved"))


LATEST = "latest as (select * from original qualify row_number() over (partition by unit, native_id order by sequence desc) = 1)"
SELECTED = "selected as (select u.unit, u.rater, case when l.state = 'submitted' then 'submitted' when l.state = 'cancelled' and not l.native_deleted then 'abstained' else 'missing' end as state, case when l.state = 'submitted' then l.label end as label, case when l.state = 'submitted' or (l.state = 'cancelled' and not l.native_deleted) then l.assistance else 'unknown' end as assistance from (select lpad(cast(doc_id as varchar), 12, '0') as unit, r.rater from labels, (values ('a'), ('b'), ('c')) r(rater)) u left join latest l using (unit, rater))"
CELLS = "cell as (select p.l as \"left\", p.r as \"right\", x.v as left_label, y.v as right_label, count(w.unit) as n from (values ('a', 'b'), ('a', 'c'), ('b', 'c')) p(l, r), (values ('0'), ('1')) x(v), (values ('0'), ('1')) y(v) left join (select s.unit, s.rater as sr, t.rater as tr, s.label as sl, t.label as tl from selected s join selected t on s.unit = t.unit and s.rater < t.rater where s.state = 'submitted' and t.state = 'submitted') w on w.sr = p.l and w.tr = p.r and w.sl = x.v and w.tl = y.v group by 1, 2, 3, 4)"
PAIR = "pair as (select c.\"left\", c.\"right\", sum(n)::bigint as n, sum(case when left_label = right_label then n else 0 end)::bigint as agreed, any_value(ch.chance)::bigint as chance from cell c join (select a.\"left\", a.\"right\", sum(a.l * b.r) as chance from (select \"left\", \"right\", left_label as v, sum(n) as l from cell group by 1, 2, 3) a join (select \"left\", \"right\", right_label as v, sum(n) as r from cell group by 1, 2, 3) b on a.\"left\" = b.\"left\" and a.\"right\" = b.\"right\" and a.v = b.v group by 1, 2) ch on ch.\"left\" = c.\"left\" and ch.\"right\" = c.\"right\" group by 1, 2)"
KAPPA = "\"left\", \"right\", n, agreed, case when n > 0 then round(agreed::double / n, 12) end as observed, case when n > 0 and chance <> n * n then round((agreed * n - chance)::double / (n * n - chance), 12) end as kappa, case when n = 0 then 'no overlap' when chance = n * n then 'constant identical marginals' end as undefined"
_Z = "1.959963984540054::double"
_P = "(agreed::double / n)"
_MID = f"(({_P} + {_Z} * {_Z} / (2 * n::double)) / (1 + {_Z} * {_Z} / n::double))"
_HALF = f"({_Z} * sqrt({_P} * (1 - {_P}) / n::double + {_Z} * {_Z} / (4 * n::double * n::double)) / (1 + {_Z} * {_Z} / n::double))"
WILSON = f"case when n > 0 then round(greatest(0.0, {_MID} - {_HALF}), 12) end as low, case when n > 0 then round(least(1.0, {_MID} + {_HALF}), 12) end as high"


def selected_sql(body: str, *more: str) -> str:
    return with_tables("original", body, LATEST, SELECTED, *more)


COMPONENTS = 'edge as (select distinct a."group" as a, b."group" as b from truth_member a join truth_member b on a.content_digest = b.content_digest where a.partition = \'train\' and b.partition = \'train\'), reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a), comp as (select a as "group", min(b) as component from reach group by 1)'
SPLIT = """named as (select component, sha256('["' || string_agg("group", '","' order by "group") || '"]') as o from comp group by 1), ranked as (select component, row_number() over (order by o, component) as rank, count(*) over () as total from named)"""


def components_sql(body: str, *more: str) -> str:
    return with_tables("truth_member", body, COMPONENTS, *more).replace("with ", "with recursive ", 1)


HEAD = "head as (select * from canonical c where not exists (select 1 from canonical s where s.prior_id = c.id))"
QUERIES = {
    "w01_latest": (w01_latest, with_tables("original", "select unit, native_id, sequence, label, state from latest", LATEST)),
    "w02_selection": (w02_selection, selected_sql("select * from selected")),
    "w03_import_diff": (w03_import_diff, with_tables("original", "select unit, native_id, sequence, change from (select coalesce(k.unit, i.unit) as unit, coalesce(k.native_id, i.native_id) as native_id, coalesce(k.sequence, 0) + 1 as sequence, case when k.native_id is null then 'new' when i.native_id is null and not k.native_deleted then 'deleted' when k.digest <> i.digest then 'changed' end as change from (select unit, native_id, sequence, native_deleted, coalesce(label, '-') as digest from latest where native_id like '%-a') k full join (select lpad(cast(doc_id as varchar), 12, '0') as unit, doc_id || '-' || case when doc_id % 9 = 0 then 'z' else 'a' end as native_id, cast(quality as varchar) as digest from labels where doc_id % 4 <> 1) i on k.unit = i.unit and k.native_id = i.native_id) where change is not null", LATEST)),
    "a09_state_counts": (a09_state_counts, selected_sql("select rater, count(*) filter (state = 'submitted') as submitted, count(*) filter (state = 'abstained') as abstained, count(*) filter (state = 'missing') as missing, count(*) filter (assistance = 'assisted') as assisted, count(*) filter (assistance = 'unknown') as unknown from selected group by 1")),
    "a10_disagreement": (a10_disagreement, selected_sql("select unit, count(distinct case when state = 'submitted' then label end) as labels, count(*) filter (state = 'submitted') as submitted from selected group by 1 having count(distinct case when state = 'submitted' then label end) > 1 or count(*) filter (state = 'submitted') <> 3")),
    "a11_confusion": (a11_confusion, selected_sql("select * from cell", CELLS)),
    "a12_kappa": (a12_kappa, selected_sql(f"select {KAPPA} from pair", CELLS, PAIR)),
    "a13_wilson": (a13_wilson, selected_sql(f'select "left", "right", {WILSON} from pair', CELLS, PAIR)),
    "p16_cohort_admission": (p16_cohort_admission, COHORTS),
    "p05_report_counts": (p05_report_counts, selected_sql("select report, outcome, " + ", ".join(f"case when outcome = 'created' then {c} end as {c}" for c in ("submitted", "abstained", "missing", "assisted", "disagreements")) + " from judged join (select report, sum(s)::bigint as submitted, sum(ab)::bigint as abstained, sum(m)::bigint as missing, sum(assisted)::bigint as assisted, count(*) filter (labels > 1 or s <> 3) as disagreements from (select report, unit, count(*) filter (state = 'submitted') as s, count(*) filter (state = 'abstained') as ab, count(*) filter (state = 'missing') as m, count(*) filter (assistance = 'assisted') as assisted, count(distinct label) as labels from asked join selected using (unit) group by 1, 2) group by 1) using (report)", REPORTS)),
    "p05_report_pairs": (p05_report_pairs, selected_sql("select q.report, s.rater as \"left\", t.rater as \"right\", s.label as left_label, t.label as right_label, count(*) as n from asked q join judged j on j.report = q.report and outcome = 'created' join selected s on s.unit = q.unit join selected t on s.unit = t.unit and s.rater < t.rater where s.state = 'submitted' and t.state = 'submitted' group by 1, 2, 3, 4, 5", REPORTS)),
    "p05_agreement_report": (p05_agreement_report, selected_sql(f"select {KAPPA}, {WILSON} from pair", CELLS, PAIR)),
    "p04_assignment_detail": (p04_assignment_detail, with_tables("original canonical", "select unit, (select count(*) from original o where o.unit = u.unit) as originals, 3 - (select count(distinct rater) from original o where o.unit = u.unit) as missing_contributors, (select max(id) from head h where h.unit = u.unit) as canonical_id from (select lpad(cast(doc_id as varchar), 12, '0') as unit from labels) u", HEAD)),
    "p06_adjudication": (p06_adjudication, with_tables("canonical", "select u.unit, case when h.id = 'c' || doc_id || '-1' then 'appended' else 'stale' end as outcome, case when h.id = 'c' || doc_id || '-1' then doc_id % 4 = 0 end as unresolved from (select doc_id, lpad(cast(doc_id as varchar), 12, '0') as unit from labels) u left join head h using (unit)", HEAD)),
    "p08_workspace": (p08_workspace, with_tables("canonical", "select unit, h.id as canonical_id, case when not h.unresolved then h.label end as label, h.unresolved from (select lpad(cast(doc_id as varchar), 12, '0') as unit from labels) u left join head h using (unit)", HEAD)),
    "p16_cohort_overlap": (p16_cohort_overlap, with_tables("original", "select right(unit, 2) as cohort, count(distinct rater) as contributors, string_agg(distinct rater, ',' order by rater) as raters from original group by 1")),
    "a14_leakage": (a14_leakage, with_tables("truth_member", "select kind, value, count(distinct partition) as partitions from (select 'group' as kind, \"group\" as value, partition from truth_member union all select 'content', content_digest, partition from truth_member) group by 1, 2 having count(distinct partition) > 1")),
    "a15_reuse": (a15_reuse, with_tables("truth_member", "select sample_id, partition from truth_member m where partition = 'train' and (exists (select 1 from history h where h.partition = 'test' and h.content_digest = m.content_digest) or exists (select 1 from history h where h.partition = 'test' and h.\"group\" = m.\"group\"))", HISTORY)),
    "a16_confirmation": (a16_confirmation, with_tables("truth_member", "select tests, fresh, tests > 0 and tests = fresh as confirmed from (select count(*) as tests, count(*) filter (content_digest not in (select content_digest from history) and \"group\" not in (select \"group\" from history)) as fresh from truth_member where partition = 'test')", HISTORY)),
    "a25_audit_counts": (a25_audit_counts, with_tables("truth_member", "select partition, count(*) as members, count(*) filter (doc_id % 3 = 0) as audited from truth_member group by 1")),
    "w05_components": (w05_components, components_sql('select "group", component from comp')),
    "w05_validation_split": (w05_validation_split, components_sql("select c.\"group\", c.component, case when total < 2 then 'too few components' else 'split' end as status, case when total >= 2 and rank <= greatest(1, total // 5) then 'validation' else 'train' end as partition from comp c join ranked r using (component)", SPLIT)),
    "w05_error_status": (w05_error_status, "select 'too few groups' as status, 1::bigint as groups"),
    "j12_latest_truth": (j12_latest_truth, with_tables("truth_member", "select partition as dataset, max(doc_id) as pinned_revision, arg_max(sample_id, doc_id) as id from truth_member group by 1")),
}
