"""Catalog, paging, join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import catalog as c
from quarry.operators import temporal
from quarry.sources import fixtures as fx
from quarry.sources.fixtures import with_tables


def s01_table_scan(spark, d):
    return fx.table(spark, d, "supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"))


def s06_declarations(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("source").alias("source_key"))
    return c.unique_violations(docs, "source_key").select("source_key", "n")


def s07_source_keys(spark, d):
    p = fx.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("relative"))
    ok = F.col("relative").rlike(r"^[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*$") & (F.octet_length("relative") <= 1024) & ~F.col("relative").contains("..")
    return p.select(F.col("page_id").cast("long").alias("page_id"), ok.alias("valid"), F.when(ok, F.concat_ws("/", F.lit("in"), F.lit("ns1"), "relative")).alias("object_key"))


def f01_readable(spark, d):
    nations = fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("namespace"), F.col("n_name").alias("name"))
    return c.readable(nations, fx.grants(spark, d), "p4", "write").select("namespace", "name")


def f02_catalog_search(spark, d):
    return c.search(fx.catalog(spark, d), text="A", after="000000000020", limit=10).select("id", "slug", "name", "next_after", "total")


def f03_keyset_page(spark, d):
    return c.keyset_page(fx.samples(spark, d), "id", "doc-000000000010", 25).select("id", "source_key", "next_after")


def f05_current_revision(spark, d):
    return c.current_revision(fx.samples(spark, d), fx.sample_revisions(spark, d))


def f06_exact_revision(spark, d):
    return c.scoped(fx.sample_revisions(spark, d), {"sample_id": "doc-000000000014"}, revision=2).select("id", "sample_id", "revision", "sha256")


def f07_active_versions(spark, d):
    rows = fx.catalog(spark, d).filter(F.col("availability") != "archived")
    return c.keyset_page(rows, "id", None, 50).select("id", "availability", "next_after", rows.agg(F.count(F.lit(1))).scalar().alias("total"))


def f08_operation_kinds(spark, d):
    return fx.operation_events(spark, d).filter(F.col("event_type").isin("failed", "succeeded")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def f11_value_guard(spark, d):
    docs = fx.table(spark, d, "documents")
    ok = (F.instr("text", "\0") == 0) & (F.octet_length("text") <= 16384)
    return docs.select("doc_id", ok.alias("valid"))


def f09_preview(spark, d):
    docs = fx.table(spark, d, "documents")
    kind, text, cut = c.utf8_preview(F.col("text").cast("binary"), 4096)
    return docs.select("doc_id", kind.alias("kind"), F.length(text).cast("long").alias("chars"), cut.alias("truncated"))


def f10_model_input(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    return docs.filter((F.octet_length("text") <= 65536) & (F.instr("text", "\0") == 0)).select("doc_id", F.sha2("text", 256).alias("sha256"))


def f13_output_pages(spark, d):
    out = process_outputs(spark, d)
    ids = out.select("sample_id").distinct().orderBy("sample_id").limit(25)
    return out.join(ids, "sample_id", "left_semi").select("sample_id", "step_position", "output_digest")


def process_outputs(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text", F.explode((F.array(F.lit(0), F.lit(1))).cast("array<bigint>")).alias("step_position"))
    docs = docs.filter((F.col("step_position") == 0) | (F.col("doc_id") % 23 != 0))
    return docs.select(F.concat(F.lit("doc-"), fx.pad(F.col("doc_id"))).alias("sample_id"), "doc_id", "step_position", F.sha2(F.concat_ws("#", "text", F.col("step_position").cast("string")), 256).alias("output_digest"))


OUTPUTS = "output as (select 'doc-' || lpad(cast(doc_id as varchar), 12, '0') as sample_id, doc_id, s as step_position, sha256(text || '#' || s) as output_digest from documents, range(0, 2) r(s) where s = 0 or doc_id % 23 <> 0)"


def f15_candidate_pages(spark, d):
    pages = fx.page_texts(spark, d)
    return c.first_by(pages, "doc", "page", 5).select("doc", "page", "position")


def f16_scoped_list(spark, d):
    rows = c.scoped(fx.samples(spark, d).withColumn("dataset", F.split("source_key", "/")[0]), {"dataset": "src3"})
    return c.keyset_page(rows, "id", None, 10).select("id", "dataset", "next_after")


def f18_write_outcomes(spark, d):
    cat = fx.catalog(spark, d).withColumn("revision", F.length("name").cast("long") % 3)
    commands = fx.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("command_id"), F.concat(F.lit("part-"), (F.col("p_partkey") * 2).cast("string")).alias("slug"), F.when(F.col("p_partkey") % 3 != 0, F.lit(1).cast("long")).alias("expected_revision"))
    return c.admit_writes(commands, cat)


def f20_placement_fallback(spark, d):
    return c.placement_fallback(fx.locations(spark, d))


def j06_chain_head(spark, d):
    return c.heads(fx.canonical(spark, d)).select("id", "unit", "label", "unresolved")


def j07_bound_artifacts(spark, d):
    a = fx.artifacts(spark, d)
    bound = fx.sample_revisions(spark, d).filter("revision = 1").select("sha256").distinct()
    return a.join(bound, a.artifact_id == bound.sha256, "left_semi").filter("verified").select("artifact_id", "size_bytes")


def j10_parent_child(spark, d):
    n, r = fx.table(spark, d, "nation"), fx.table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("dataset"), F.col("n_name").alias("draft"))


def j11_first_placement(spark, d):
    return c.first_by(fx.locations(spark, d), "artifact_id", "id", 1).select("artifact_id", "id", "store_id")


def j09_retry_lineage(spark, d):
    return c.retry_lineage(items(spark, d)).select("id", "retry_of", "retried_by")


def items(spark, d):
    o = fx.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("long").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") - 1).cast("long").alias("retry_of"))


def j14_fuzzy_titles(spark, d):
    titles = fx.table(spark, d, "part").select("p_name")
    wanted = fx.table(spark, d, "part").select(F.concat((F.col("p_partkey") % 50).cast("string"), F.lit(". "), F.upper(F.substring_index("p_name", " ", 2))))
    return c.containments(titles, wanted).select(F.col("left").alias("title"), F.col("right").alias("wanted"))


def k02_newest_first(spark, d):
    return fx.operation_events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "operation_id", "event_type")


def k03_composite_order(spark, d):
    return fx.operation_events(spark, d).orderBy("ts", "event_id").limit(50).select("event_id", "event_type")


def k04_set_difference(spark, d):
    done = process_outputs(spark, d).filter("step_position = 1")
    return c.remaining(fx.samples(spark, d).withColumnRenamed("id", "sample_id"), done, "sample_id").select("sample_id")


def k05_set_equality(spark, d):
    asked = fx.table(spark, d, "labels").select("doc_id")
    there = fx.table(spark, d, "documents").filter("doc_id % 3 <> 0").select("doc_id")
    return c.set_difference_both(asked, there).groupBy("only_in").agg(F.count(F.lit(1)).alias("n"))


def k06_target_pages(spark, d):
    pages = fx.page_texts(spark, d).select("doc", "page")
    tagged, noted = pages.filter("page % 3 = 0"), pages.filter("page % 2 = 0").withColumn("page", F.col("page") + 1)
    return tagged.union(noted).distinct().join(pages, ["doc", "page"], "left_semi").select("doc", "page")


def k08_unique_tags(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.split(F.concat_ws(",", "lang", F.lit(" "), "source", "lang", F.lit("")), ",").alias("tags"))
    clean = F.array_distinct(F.filter(F.transform("tags", lambda x: F.trim(x)), lambda x: x != ""))
    return docs.select("doc_id", F.array_join(clean, ",").alias("tags"))


def f14_job_list(spark, d):
    e = fx.operation_events(spark, d)
    jobs = e.groupBy("operation_id").agg(F.max("ts").alias("updated_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), F.count(F.lit(1)).alias("events"))
    return jobs.orderBy(F.desc("updated_at"), "operation_id").limit(20)


def f17_point_read(spark, d):
    return c.scoped(fx.catalog(spark, d), {"owner": "Brand#11"}, id="000000000003").select("id", "slug")


def t11_next_revision(spark, d):
    known = fx.sample_revisions(spark, d).select("sample_id", "revision")
    commands = fx.samples(spark, d).select(F.col("id").alias("sample_id"), (F.col("doc_id") % 3).alias("expected_revision"))
    return temporal.revision_outcomes(commands, known, ["sample_id"])


QUERIES = {
    "s01_table_scan": (s01_table_scan, "select s_suppkey::bigint as id, s_name as name from supplier where s_nationkey < 5"),
    "s06_declarations": (s06_declarations, "select source as source_key, count(*) as n from documents group by 1 having count(*) > 1"),
    "s07_source_keys": (s07_source_keys, r"select page_id::bigint as page_id, ok as valid, case when ok then 'in/ns1/' || relative end as object_key from (select page_id, relative, regexp_full_match(relative, '[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*') and octet_length(encode(relative)) <= 1024 and not contains(relative, '..') as ok from (select page_id, regexp_replace(url, '^[a-z]+://', '') as relative from pages))"),
    "f01_readable": (f01_readable, with_tables("grants", "select n_nationkey::bigint as namespace, n_name as name from nation where n_nationkey in (select namespace from grants where principal = 'p4' and not disabled and access = 'write')")),
    "f02_catalog_search": (f02_catalog_search, with_tables("catalog", "select id, slug, name, (select case when count(*) > 10 then max(case when n = 10 then id end) end from top) as next_after, (select count(*) from hits) as total from top where n <= 10", "hits as (select * from catalog where (contains(lower(name), 'a') or contains(lower(slug), 'a')) and availability <> 'archived')", "top as (select *, row_number() over (order by id) as n from hits where id > '000000000020' qualify n <= 11)")),
    "f03_keyset_page": (f03_keyset_page, with_tables("sample", "select id, source_key, (select case when count(*) > 25 then max(case when n = 25 then id end) end from top) as next_after from top where n <= 25", "top as (select *, row_number() over (order by id) as n from sample where id > 'doc-000000000010' qualify n <= 26)")),
    "f05_current_revision": (f05_current_revision, with_tables("sample sample_revision", "select s.id as sample_id, s.source_key, r.id as revision_id, r.revision, r.sha256, r.size_bytes from sample s join sample_revision r on s.id = r.sample_id and s.revision = r.revision")),
    "f06_exact_revision": (f06_exact_revision, with_tables("sample_revision", "select id, sample_id, revision, sha256 from sample_revision where sample_id = 'doc-000000000014' and revision = 2")),
    "f07_active_versions": (f07_active_versions, with_tables("catalog", "select id, availability, (select case when count(*) > 50 then max(case when n = 50 then id end) end from top) as next_after, (select count(*) from catalog where availability <> 'archived') as total from top where n <= 50", "top as (select *, row_number() over (order by id) as n from catalog where availability <> 'archived' qualify n <= 51)")),
    "f08_operation_kinds": (f08_operation_kinds, with_tables("event", "select event_type, count(*) as n from event where event_type in ('failed', 'succeeded') group by 1")),
    "f09_preview": (f09_preview, "select doc_id, case when head is null or contains(head, chr(0)) then 'binary' else 'text' end as kind, case when not contains(head, chr(0)) then length(head) end as chars, octet_length(b) > 4096 and head is not null and not contains(head, chr(0)) as truncated from (select doc_id, b, coalesce(try(decode(b[1:4096])), try(decode(b[1:4095])), try(decode(b[1:4094])), try(decode(b[1:4093]))) as head from (select doc_id, encode(text) as b from documents))"),
    "f10_model_input": (f10_model_input, "select doc_id, sha256(text) as sha256 from documents where octet_length(encode(text)) <= 65536 and not contains(text, chr(0))"),
    "f11_value_guard": (f11_value_guard, "select doc_id, not contains(text, chr(0)) and octet_length(encode(text)) <= 16384 as valid from documents"),
    "f13_output_pages": (f13_output_pages, f"with {OUTPUTS} select sample_id, step_position, output_digest from output where sample_id in (select distinct sample_id from output order by 1 limit 25)"),
    "f14_job_list": (f14_job_list, with_tables("event", "select operation_id, max(ts) as updated_at, arg_max(event_type, row(ts, event_id)) as last_event, count(*) as events from event group by 1 order by updated_at desc, operation_id limit 20")),
    "f15_candidate_pages": (f15_candidate_pages, with_tables("page_text", "select doc, page, row_number() over (partition by doc order by page) as position from page_text qualify position <= 5")),
    "f16_scoped_list": (f16_scoped_list, with_tables("sample", "select id, 'src3' as dataset, (select case when count(*) > 10 then max(case when n = 10 then id end) end from top) as next_after from top where n <= 10", "top as (select *, row_number() over (order by id) as n from sample where split_part(source_key, '/', 1) = 'src3' qualify n <= 11)")),
    "f17_point_read": (f17_point_read, with_tables("catalog", "select id, slug from catalog where owner = 'Brand#11' and id = '000000000003'")),
    "f18_write_outcomes": (f18_write_outcomes, with_tables("catalog", "select c.p_partkey::bigint as command_id, c.slug, case when c.expected is null and k.slug is null then 'created' when c.expected is null then 'conflict' when k.slug is null then 'not_found' when k.availability = 'archived' then 'archived' when length(k.name) % 3 <> c.expected then 'stale' else 'updated' end as outcome from (select p_partkey, 'part-' || (p_partkey * 2) as slug, case when p_partkey % 3 <> 0 then 1 end as expected from part) c left join catalog k on c.slug = k.slug")),
    "f20_placement_fallback": (f20_placement_fallback, with_tables("location", "select artifact_id, min(case when outcome = 'good' then id end) as location_id, case when min(case when outcome = 'good' then id end) is null then arg_max(outcome, case outcome when 'missing' then 1 when 'unavailable' then 2 when 'corrupt' then 3 else 0 end) end as error from few group by 1", "few as (select * from location qualify row_number() over (partition by artifact_id order by id) <= 4)")),
    "j06_chain_head": (j06_chain_head, with_tables("canonical", "select id, unit, label, unresolved from canonical c where not exists (select 1 from canonical s where s.prior_id = c.id)")),
    "j07_bound_artifacts": (j07_bound_artifacts, with_tables("artifact sample_revision", "select artifact_id, size_bytes from artifact a where verified and exists (select 1 from sample_revision r where r.revision = 1 and r.sha256 = a.artifact_id)")),
    "j09_retry_lineage": (j09_retry_lineage, "with item as (select o_orderkey::bigint as id, case when o_orderkey % 5 = 0 then o_orderkey - 1 end::bigint as retry_of from orders) select i.id, i.retry_of, c.id as retried_by from item i left join item c on c.retry_of = i.id"),
    "j10_parent_child": (j10_parent_child, "select r_name as dataset, n_name as draft from nation join region on n_regionkey = r_regionkey"),
    "j11_first_placement": (j11_first_placement, with_tables("location", "select artifact_id, id, store_id from location qualify row_number() over (partition by artifact_id order by id) = 1")),
    "j14_fuzzy_titles": (j14_fuzzy_titles, r"with side as (select distinct 'l' as s, p_name as title from part union all select distinct 'r', (p_partkey % 50) || '. ' || upper(array_to_string(string_split(p_name, ' ')[1:2], ' ')) from part), keyed as (select *, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(title, '^[0-9]{1,3}[.)]\s+', ''))), '\s+', ' ', 'g'), '[^\p{L}\p{N}\s./-]+', '', 'g')) as key from side) select l.title, r.title as wanted from keyed l join keyed r on l.s = 'l' and r.s = 'r' and l.key <> '' and r.key <> '' and (contains(l.key, r.key) or contains(r.key, l.key))"),
    "k02_newest_first": (k02_newest_first, with_tables("event", "select event_id, operation_id, event_type from event order by ts desc, event_id desc limit 20")),
    "k03_composite_order": (k03_composite_order, with_tables("event", "select event_id, event_type from event order by ts, event_id limit 50")),
    "k04_set_difference": (k04_set_difference, with_tables("sample", "select id as sample_id from sample where id not in (select sample_id from output where step_position = 1)", OUTPUTS)),
    "k05_set_equality": (k05_set_equality, "with a as (select doc_id from labels), b as (select doc_id from documents where doc_id % 3 <> 0) select 'left' as only_in, count(*) as n from (select * from a except select * from b) having count(*) > 0 union all select 'right', count(*) from (select * from b except select * from a) having count(*) > 0"),
    "k06_target_pages": (k06_target_pages, with_tables("page_text", "select distinct doc, page from (select doc, page from page_text where page % 3 = 0 union all select doc, page + 1 from page_text where page % 2 = 0) t where exists (select 1 from page_text p where p.doc = t.doc and p.page = t.page)")),
    "k08_unique_tags": (k08_unique_tags, "select doc_id, lang || ',' || source as tags from documents"),
    "t11_next_revision": (t11_next_revision, with_tables("sample sample_revision", "select s.id as sample_id, s.doc_id % 3 as expected_revision, case when s.doc_id % 3 = m then m + 1 end as revision, case when s.doc_id % 3 = m then 'appended' else 'stale' end as outcome from sample s join (select sample_id, max(revision) as m from sample_revision group by 1) r on r.sample_id = s.id")),
}
