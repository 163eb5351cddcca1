"""Composite and supporting queries: structure, flows, jobs, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import events as ev
from quarry.operators import flows, structure
from quarry.plans.datasets import members
from quarry.plans.labels import cells, selected
from quarry.sources import fixtures as fx
from quarry.sources.fixtures import with_tables


def toc(spark, d):
    """Regions and their nations as the contents of twenty documents, printed one page later in each."""
    n, r = fx.table(spark, d, "nation"), fx.table(spark, d, "region")
    top = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.concat(F.col("r_regionkey").cast("string"), F.lit(". "), "r_name").alias("title"), F.col("r_regionkey").cast("long").alias("at"))
    sub = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("title"), (F.col("n_nationkey") + 10).cast("long").alias("at"))
    every = F.explode(F.sequence(F.lit(1), F.lit(20)).cast("array<bigint>")).alias("doc")
    return top.unionByName(sub).select(every, "id", "parent", "title", "at").withColumn("printed", F.col("at") + F.col("doc")).drop("at")


def w16_toc_paths(spark, d):
    return structure.flatten_toc(toc(spark, d)).select("doc", "id", F.array_join("path", " > ").alias("path"), "printed")


def w16_page_paths(spark, d):
    """Pages of the twenty documents: by printed number, and beyond the contents by a heading."""
    names = fx.table(spark, d, "nation").select((F.col("n_nationkey") + 200).cast("long").alias("page"), F.concat(F.lit("9. "), F.lower("n_name"), F.lit(" !")).alias("heading"))
    pages = spark.range(1, 65).select(F.col("id").alias("page"), F.lit("").alias("heading")).unionByName(names)
    pages = pages.select(F.explode(F.sequence(F.lit(1), F.lit(20)).cast("array<bigint>")).alias("doc"), "page", "heading", F.lit(2).cast("long").alias("offset"))
    return structure.paths_from_toc(pages, structure.flatten_toc(toc(spark, d))).select("doc", "page", F.array_join("path", " > ").alias("path"))


def text_lines(spark, d):
    return fx.lines(spark, d).select("doc", (F.floor(F.col("pos") / 10) + 1).alias("page"), "pos", "text")


def w19_line_blocks(spark, d):
    return structure.line_blocks(text_lines(spark, d)).select("doc", "page", "block", "kind", "lines", F.sha2("t", 256).alias("sha256"))


def list_items(spark, d):
    """Documents as lists: every second line of the even ones is a numbered head."""
    li = fx.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = (F.col("doc_id") % 2 == 0) & (F.col("pos") % 3 == 0)
    return li.select(F.col("doc_id").alias("doc"), F.col("pos").cast("long").alias("pos"), F.when(head, F.concat(F.lit("4. Head "), F.substring_index("line", " ", 1))).when(F.col("pos") % 3 == 1, F.concat(F.lit("- "), "line")).otherwise(F.concat("line", F.lit(" • in • out"))).alias("text"))


def w20_numbered_groups(spark, d):
    return structure.numbered_groups(list_items(spark, d)).select("doc", "groups", F.sha2("md", 256).alias("sha256"))


def w25_rebase(spark, d):
    rows = fx.lines(spark, d).select("doc", (F.floor(F.col("pos") / 10) + 1).alias("page"), "pos", (F.col("pos") % 4 + 1).alias("lvl"), (F.col("doc") % 4).alias("depth"))
    return structure.rebase_headings(rows).select("doc", "pos", "level")


def x18_block_roles(spark, d):
    rows = text_lines(spark, d).select("doc", "pos", "text", F.when(F.col("pos") % 3 == 0, "heading").when(F.col("pos") % 3 == 1, "paragraph").otherwise("table").alias("kind"))
    role = structure.block_role(F.col("kind"), F.lit(2), F.col("text"))
    return rows.groupBy("doc", role.alias("role")).agg(F.count(F.lit(1)).alias("n"))


def x24_hints(spark, d):
    """Parts as blocks; every brand but those that end in 5 has a hint."""
    parts = fx.table(spark, d, "part")
    blocks = parts.select(F.col("p_partkey").cast("long").alias("pos"), F.when(F.col("p_partkey") % 2 == 0, "heading").otherwise("paragraph").alias("k"), F.col("p_brand").alias("t"), F.lit(2).cast("long").alias("lvl"))
    last = F.substring("p_brand", -1, 1).cast("long")
    hints = parts.select("p_brand").distinct().filter(last != 5).select(F.concat(F.lit("3. "), F.lower("p_brand")).alias("title"), (last + 1).alias("level"))
    return structure.apply_hints(blocks, hints).select("pos", "lvl")


def x25_titles(spark, d):
    docs = fx.table(spark, d, "documents")
    md = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), "source", F.lit("\n"), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", F.sha2(structure.titled(md, F.when(F.col("doc_id") % 3 != 0, F.col("source"))), 256).alias("sha256"))


def x27_photos(spark, d):
    li = fx.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, F.lit(" Portrait")).otherwise(F.lit(""))).alias("t"))
    return li.select("id", structure.looks_like_photo(F.col("t"), F.lit(None).cast("string")).alias("photo"), F.round(structure.photo_width((F.col("id") % 10 + 1) / 20, (F.col("id") % 7 + 1) / 20, F.lit(800), F.lit(600)), 6).alias("width"))


def x28_useful_figures(spark, d):
    b = fx.table(spark, d, "orders").select((F.col("o_custkey") % 20).cast("long").alias("doc"), F.col("o_orderkey").cast("long").alias("pos"), F.when(F.col("o_orderkey") % 2 == 0, "figure").otherwise("paragraph").alias("k"), F.concat(F.lit("f"), (F.col("o_orderkey") % 9).cast("string")).alias("id"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("artifacts/f"), (F.col("o_orderkey") % 9).cast("string"))).alias("artifact")).distinct()
    reviews = spark.range(0, 20).select(F.col("id").alias("doc"), F.concat(F.lit("f"), (F.col("id") % 9).cast("string")).alias("figure"), F.when(F.col("id") % 3 == 0, "not_useful").otherwise("useful").alias("verdict"))
    return structure.useful_figures(b, reviews).select("doc", "pos", "k")


def u03_answers(spark, d):
    """Parts as lines of fifty documents, each with two answers."""
    doc = (F.col("p_partkey") % 50).cast("long")
    c = fx.table(spark, d, "part").select(doc.alias("doc"), F.col("p_partkey").cast("long").alias("pos"), F.col("p_brand").alias("text"), F.lit("paragraph").alias("role"), (F.col("p_partkey") % 2 == 0).alias("uncertain"))
    two = F.array(F.struct(F.concat(F.lit("Brand#1"), (F.col("id") % 5 + 1).cast("string")).alias("text"), F.lit("heading").alias("role")), F.struct(F.lit("brand").alias("text"), F.lit("ol_item").alias("role")))
    a = spark.range(50).select(F.col("id").alias("doc"), F.inline(two))
    return structure.override_uncertain(c, a).select("pos", "role")


def p01_admission(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").cast("long").alias("c")).distinct()
    runs = o.select("id", F.when(F.col("id") % 3 != 0, F.lit("c")).alias("candidate"), F.when(F.col("id") % 2 == 0, F.lit("v")).alias("version"), F.when(F.col("s") == "P", "preparing").otherwise("sealed").alias("state"), (F.col("c") % 50).alias("members"), F.lit(40).cast("long").alias("max_members"), (F.col("id") % 4).alias("model_steps"), F.lit(60).cast("long").alias("max_model_calls"))
    return flows.admit_runs(runs).select("id", "candidate", "version", "members", "outcome")


def p02_flow_outputs(spark, d):
    return flows.run_steps(fx.table(spark, d, "documents"), ["identity", "strip", "lowercase"])


def e26_job_moves(spark, d):
    e = fx.operation_events(spark, d)
    names = F.array(*map(F.lit, ("queued", "running", "completed", "failed", "cancelled")))
    rows = e.select("event_id", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("state"), F.element_at(names, (F.col("event_id") % 7 % 5 + 1).cast("int")).alias("wanted"))
    return rows.withColumn("to", flows.job_move(F.col("state"), F.col("wanted")))


def x34_stage_view(spark, d):
    e = fx.operation_events(spark, d)
    phase = F.element_at(F.array(*map(F.lit, ("structure", "stitch", "write", "done", "extract"))), (F.col("event_id") % 5 + 1).cast("int"))
    return flows.stage_view(e.select(F.col("operation_id").alias("run_id"), phase.alias("phase")))


def x35_models(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"))
    prov, tr = F.when(F.col("id") % 2 == 0, "gemini").otherwise("glm"), F.when(F.col("id") % 3 == 0, "openrouter").otherwise("native")
    model = F.when(F.col("id") % 5 == 0, "google/flash-2.5").when(F.col("id") % 7 == 0, "z-ai/glm-4").when(F.col("id") % 11 == 0, "-bad").otherwise("flash")
    return p.select("id", flows.model_valid(prov, tr, model, F.when(F.col("id") % 13 == 0, "exact").otherwise("mutable_alias")).alias("valid"))


def x33_label_views(spark, d):
    r = fx.table(spark, d, "region")
    labels = F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit("good & new"), F.lit('b"ad'))).otherwise(F.array(F.lit("one"), F.lit("one")))
    return r.select(F.col("r_regionkey").cast("long").alias("id"), flows.label_view(labels, F.col("r_name")).alias("view"))


def x37_paths(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"))
    k = F.col("id").cast("string")
    path = F.when(F.col("id") % 4 == 0, F.concat(F.lit("/home/u/data/data/x"), k)).when(F.col("id") % 4 == 1, F.concat(F.lit("data/y"), k)).when(F.col("id") % 4 == 2, F.concat(F.lit("/srv/data/z"), k)).otherwise(F.concat(F.lit("./w"), k))
    return p.select("id", flows.data_path(path, "/srv/data").alias("path"))


def x38_validators(spark, d):
    docs = fx.table(spark, d, "documents")
    a = F.array("lang", "source", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.lit("x")))
    return docs.select("doc_id", ((F.size(F.array_distinct(a)) == F.size(a)) & (tx.trim(F.col("source")) != "")).alias("valid"))


def x39_retry_after(spark, d):
    n = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("n_nationkey")).distinct()
    v = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.col("n_nationkey").cast("string"), F.lit(".5"))).when(F.col("n_nationkey") % 3 == 1, F.lit("soon")).otherwise(F.lit("-1"))
    return n.select(F.col("n_nationkey").cast("long").alias("id"), flows.retry_after_ms(v).alias("ms"))


def x39_retry_dates(spark, d):
    """Pauses given as dates of orders, as seconds, or as neither, seen at one time."""
    o = fx.table(spark, d, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    v = F.when(k % 3 == 0, F.concat(F.lit("Mon, "), F.date_format(day, "dd MMM yyyy"), F.lit(" 12:00:00 GMT"))).when(k % 3 == 1, (k % 100).cast("string")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    now = F.to_timestamp(F.lit("1995-06-01 00:00:00 +0000"), "yyyy-MM-dd HH:mm:ss Z")
    return o.select(k.cast("long").alias("id"), flows.retry_after_ms(v, now).alias("ms"))


def x32_modes(spark, d):
    n = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("n_nationkey")).distinct()
    raw = F.element_at(F.array(*map(F.lit, (" OFF", "0", "false", "Force ", "auto", "x"))), (F.col("n_nationkey") % 6 + 1).cast("int"))
    t = tx.trim(F.lower(raw))
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.when(t.isin("off", "0", "false"), "off").when(t == "force", "force").otherwise("auto").alias("mode"))


def x40_figures_missing(spark, d):
    p = fx.page_texts(spark, d)
    keep = F.array(F.struct(F.lit("figure").alias("k"), (F.col("page") % 3 != 0).alias("boxed"), (F.col("page") % 2 == 0).alias("file")), F.struct(F.lit("paragraph").alias("k"), F.lit(False).alias("boxed"), F.lit(False).alias("file")))
    return p.select("doc", "page", F.exists(keep, lambda b: (b["k"] == "figure") & ~(b["boxed"] & b["file"])).alias("missing"))


def x02_coherence(spark, d):
    r = fx.sample_revisions(spark, d)
    ann, sch, rev = F.col("doc_id") % 2 == 0, F.col("doc_id") % 4 == 0, F.when(F.col("doc_id") % 6 == 0, F.col("sha256")).otherwise(F.lit(None))
    return r.select("id", ((~ann | sch) & (rev.isNull() | ann)).alias("coherent"))


def f22_preview_kinds(spark, d):
    li = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("id"), (F.col("l_quantity") * 1_000_000).cast("long").alias("bytes"), (F.col("l_linenumber") * 5_000_000).cast("long").alias("pixels"), F.col("l_linestatus").alias("s")).distinct()
    ok = (F.col("s") == "O") & (F.col("bytes") <= 8 << 20) & (F.col("pixels") <= 20_000_000)
    return li.select("id", "bytes", "pixels", "s", F.when(ok, "thumbnail").otherwise("download").alias("preview"))


def j03_publication_members(spark, d):
    return members(spark, d).filter("sample_id > 'doc-000000000050'").orderBy("sample_id").limit(50).select("sample_id", "artifact_id", "verified")


def j04_process_plan(spark, d):
    loc = fx.locations(spark, d).groupBy("artifact_id").agg(F.min("id").alias("location_id"))
    j = members(spark, d).join(loc, "artifact_id", "left")
    guard = F.when(F.col("artifact_id").isNull(), "unbound").when(~F.col("verified"), "unverified").when(F.col("location_id").isNull(), "no_location").otherwise("ready")
    return j.select("sample_id", "location_id", guard.alias("guard"))


def j08_event_outbox(spark, d):
    """The first thirty deliveries: events joined to their outbox rows, those dispatched or leased left out."""
    return ev.deliveries(fx.operation_events(spark, d), _g.outbox(spark, d), _g.now(), 30).select("event_id", "operation_id", "event_type")


def a01_counts(spark, d):
    return fx.samples(spark, d).groupBy(F.split("source_key", "/")[0].alias("dataset")).agg(F.count(F.lit(1)).alias("total"))


def a02_latest(spark, d):
    from quarry.operators import catalog

    return catalog.latest_revision(fx.sample_revisions(spark, d), ["sample_id"])


def p07_publish_check(spark, d):
    from quarry.operators import truth

    m = fx.truth_members(spark, d)
    leaks = truth.leakage(m).agg(F.count(F.lit(1)).alias("leaks"))
    by = m.groupBy("partition").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("group").alias("groups"))
    return by.withColumn("publishable", leaks.scalar() == 0)


def p05_units(spark, d):
    s = selected(spark, d)
    return s.groupBy("unit").agg(F.count(F.lit(1)).alias("contributors"), F.count_if(F.col("state") == "submitted").alias("submitted"))


def e03_retries(spark, d):
    e = fx.operation_events(spark, d)
    by = ev.fold_states(e)
    epochs = ev.sequenced(e).groupBy("operation_id").agg(F.max("epoch").alias("epoch"))
    return by.join(epochs, "operation_id").select("operation_id", F.when(F.col("state") == "failed", F.col("epoch") + 1).otherwise(F.col("epoch")).alias("next_epoch"), (F.col("state") == "failed").alias("retryable"))


def e19_dispatches(spark, d):
    e = ev.sequenced(fx.operation_events(spark, d))
    return e.groupBy("operation_id", "epoch").agg(F.max_by(F.when(F.col("event_type") == "queued", "pending").when(F.col("event_type") == "running", "submitted").otherwise("unknown"), "revision").alias("status"), F.count(F.lit(1)).alias("events"))


def s19_deletion(spark, d):
    loc = fx.locations(spark, d)
    by = loc.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("placements"), F.count_if(F.col("outcome") == "missing").alias("gone"))
    return by.select("artifact_id", F.when(F.col("placements") == F.col("gone"), "deleted").otherwise("deleting").alias("state"))


def cells_total(spark, d):
    return cells(spark, d).groupBy("left", "right").agg(F.sum("n").alias("overlap"))


from quarry.plans import datasets as _d  # noqa: E402
from quarry.plans import labels as _l  # noqa: E402
from quarry.plans import log as _g  # noqa: E402

_M = lambda body: with_tables(_d.NEEDED, body, _d.MEMBERS)
QUERIES = {
    "w16_toc_paths": (w16_toc_paths, "select doc, id, path, n + doc as printed from (select 'r' || r_regionkey as id, r_name as path, r_regionkey::bigint as n from region union all select 'n' || n_nationkey, r_name || ' > ' || n_name, n_nationkey + 10 from nation join region on n_regionkey = r_regionkey), range(1, 21) d(doc)"),
    "w16_page_paths": (w16_page_paths, "with flat as (select r_name as title, r_name as path, 1 as n, r_regionkey::bigint as at from region union all select n_name, r_name || ' > ' || n_name, 2, n_nationkey + 10 from nation join region on n_regionkey = r_regionkey), p as (select page, '' as heading from range(1, 65) t(page) union all select n_nationkey + 200, lower(n_name) from nation) select d.doc, p.page, coalesce((select arg_max(path, row(case when f.at + d.doc + 2 = p.page then 2 else 1 end, n, replace(path, ' > ', chr(10)))) from flat f where f.at + d.doc + 2 = p.page or (p.heading <> '' and (contains(lower(f.title), p.heading) or contains(p.heading, lower(f.title))))), '') as path from p, range(1, 21) d(doc)"),
    "w19_line_blocks": (w19_line_blocks, None),
    "w20_numbered_groups": (w20_numbered_groups, None),
    "w25_rebase": (w25_rebase, with_tables("line", "select doc, pos, case when doc % 4 > 0 then least(6, least(6, doc % 4 + 1) + pos % 4 + 1 - min(pos % 4 + 1) over (partition by doc, pos // 10)) else pos % 4 + 1 end::bigint as level from line")),
    "x18_block_roles": (x18_block_roles, None),
    "x24_hints": (x24_hints, "select p_partkey::bigint as pos, case when p_partkey % 2 = 0 and right(p_brand, 1) <> '5' then cast(right(p_brand, 1) as bigint) + 1 else 2 end as lvl from part"),
    "x25_titles": (x25_titles, "select doc_id, sha256(case when doc_id % 3 = 0 then md when starts_with(md, '# ' || source) then md else '# ' || source || chr(10) || chr(10) || md end) as sha256 from (select *, case when doc_id % 2 = 0 then '# ' || source || chr(10) || text else text end as md from documents)"),
    "x27_photos": (x27_photos, f"select id, regexp_matches(lower(t), '{structure.PHOTO}') as photo, round(case when h * 600 < 8 then w when w <= target * 1.02 then least(w, target) else greatest(0.03, target) end, 6) as width from (select *, greatest(0.0::double, least(1.0::double, h * 600 * 0.92 / 800)) as target from (select p_partkey::bigint as id, p_name || case when p_partkey % 5 = 0 then ' Portrait' else '' end as t, (p_partkey % 10 + 1) / 20 as w, (p_partkey % 7 + 1) / 20 as h from part))"),
    "x28_useful_figures": (x28_useful_figures, "with b as (select distinct o_custkey % 20 as doc, o_orderkey::bigint as pos, case when o_orderkey % 2 = 0 then 'figure' else 'paragraph' end as k, o_orderkey % 9 as f from orders) select doc, pos, k from b where not (k = 'figure' and doc % 3 = 0 and f = doc % 9)"),
    "u03_answers": (u03_answers, "select p_partkey::bigint as pos, case when p_partkey % 2 = 0 then case when lower(p_brand) = 'brand#1' || (p_partkey % 50 % 5 + 1) then 'heading' else 'ol_item' end else 'paragraph' end as role from part"),
    "p01_admission": (p01_admission, "select distinct id, case when id % 3 <> 0 then 'c' end as candidate, case when id % 2 = 0 then 'v' end as version, members, case when (id % 3 = 0) = (id % 2 <> 0) then 'invalid' when s = 'P' or members not between 1 and 40 then 'not_admissible' when id % 4 * members > 60 then 'over_budget' else 'admitted' end as outcome from (select o_orderkey::bigint as id, o_orderstatus as s, (o_custkey % 50)::bigint as members from orders)"),
    "p02_flow_outputs": (p02_flow_outputs, f"""select doc_id, s as step, sha256(case s when 2 then a else text end) as input_digest, sha256('{{"text":"' || {_d.ESCAPED.format('case s when 0 then text when 1 then a else b end')} || '"}}') as output_digest, octet_length(encode(case s when 0 then text when 1 then a else b end))::bigint as bytes from (select *, lower(a) as b from (select doc_id, text, {_d.STRIP.format('text')} as a from documents)), range(0, 3) r(s)"""),
    "e26_job_moves": (e26_job_moves, with_tables("event", "select event_id, state, wanted, case when (state = 'queued' and wanted in ('running', 'cancelled')) or (state = 'running' and wanted in ('completed', 'failed', 'cancelled')) or (state in ('completed', 'failed', 'cancelled') and wanted = 'queued') then wanted else state end as \"to\" from (select event_id, ['queued', 'running', 'completed', 'failed', 'cancelled'][1 + event_id % 5] as state, ['queued', 'running', 'completed', 'failed', 'cancelled'][1 + event_id % 7 % 5] as wanted from event)")),
    "x34_stage_view": (x34_stage_view, with_tables("event", "select r.run_id, t.stage::bigint as stage, t.label, count(p.step) as done, count(*) as total from (select distinct operation_id as run_id from event) r cross join (values (0, 'assemble', 'structure'), (0, 'assemble', 'stitch'), (1, 'write', 'write'), (2, 'done', 'done')) t(stage, label, step) left join (select distinct operation_id as run_id, ['structure', 'stitch', 'write', 'done', 'extract'][1 + event_id % 5] as step from event) p on p.run_id = r.run_id and p.step = t.step group by 1, 2, 3")),
    "x35_models": (x35_models, "select id, case when tr = 'openrouter' then ident <> 'exact' and ((prov = 'gemini' and regexp_full_match(model, 'google/[a-zA-Z0-9][a-zA-Z0-9_.-]*')) or (prov = 'glm' and regexp_full_match(model, 'z-ai/[a-zA-Z0-9][a-zA-Z0-9_.-]*'))) else regexp_full_match(model, '[a-zA-Z0-9][a-zA-Z0-9_.-]*') end as valid from (select p_partkey::bigint as id, case when p_partkey % 2 = 0 then 'gemini' else 'glm' end as prov, case when p_partkey % 3 = 0 then 'openrouter' else 'native' end as tr, case when p_partkey % 5 = 0 then 'google/flash-2.5' when p_partkey % 7 = 0 then 'z-ai/glm-4' when p_partkey % 11 = 0 then '-bad' else 'flash' end as model, case when p_partkey % 13 = 0 then 'exact' else 'mutable_alias' end as ident from part)"),
    "x33_label_views": (x33_label_views, """select r_regionkey::bigint as id, case when r_regionkey % 2 = 0 then '<View><Header value="' || r_name || '"/><Text name="text" value="$text"/><Choices name="label" toName="text" choice="single" required="true"><Choice value="good &amp; new"/><Choice value=''b"ad''/></Choices><Choices name="assistance" toName="text" choice="single"><Choice value="independent"/><Choice value="assisted"/><Choice value="unknown"/></Choices></View>' end as view from region"""),
    "x37_paths": (x37_paths, "select p_partkey::bigint as id, case p_partkey % 4 when 0 then '/srv/data/x' when 1 then '/srv/data/y' when 2 then '/srv/data/z' else '/srv/data/w' end || p_partkey as path from part"),
    "x38_validators": (x38_validators, "select doc_id, doc_id % 3 <> 0 and lang <> source and lang <> 'x' and source <> 'x' and trim(source) <> '' as valid from documents"),
    "x39_retry_after": (x39_retry_after, "select n_nationkey::bigint as id, case when n_nationkey % 3 = 0 then n_nationkey * 1000 + 500 end::bigint as ms from (select distinct o_orderkey as n_nationkey from orders)"),
    "x39_retry_dates": (x39_retry_dates, "select o_orderkey::bigint as id, case o_orderkey % 3 when 0 then greatest(0, epoch_ms(o_orderdate::timestamp + interval 12 hour) - epoch_ms(timestamp '1995-06-01')) when 1 then (o_orderkey % 100) * 1000 end::bigint as ms from orders"),
    "x32_modes": (x32_modes, "select n_nationkey::bigint as id, case when n_nationkey % 6 < 3 then 'off' when n_nationkey % 6 = 3 then 'force' else 'auto' end as mode from (select distinct o_orderkey as n_nationkey from orders)"),
    "x40_figures_missing": (x40_figures_missing, with_tables("page_text", "select doc, page, not (page % 3 <> 0 and page % 2 = 0) as missing from page_text")),
    "x02_coherence": (x02_coherence, with_tables("sample_revision", "select id, (doc_id % 2 <> 0 or doc_id % 4 = 0) and (doc_id % 6 <> 0 or doc_id % 2 = 0) as coherent from sample_revision")),
    "f22_preview_kinds": (f22_preview_kinds, f"select distinct l_orderkey::bigint as id, (l_quantity * 1000000)::bigint as bytes, (l_linenumber * 5000000)::bigint as pixels, l_linestatus as s, case when l_linestatus = 'O' and (l_quantity * 1000000)::bigint <= {8 << 20} and l_linenumber * 5000000 <= 20000000 then 'thumbnail' else 'download' end as preview from lineitem"),
    "j03_publication_members": (j03_publication_members, _M("select sample_id, artifact_id, verified from member where sample_id > 'doc-000000000050' order by sample_id limit 50")),
    "j04_process_plan": (j04_process_plan, with_tables(_d.NEEDED + " location", "select m.sample_id, l.location_id, case when m.artifact_id is null then 'unbound' when not m.verified then 'unverified' when l.location_id is null then 'no_location' else 'ready' end as guard from member m left join (select artifact_id, min(id) as location_id from location group by 1) l using (artifact_id)", _d.MEMBERS)),
    "j08_event_outbox": (j08_event_outbox, with_tables("event", f"select event_id, operation_id, event_type from event join outbox using (event_id) where not dispatched and not coalesce(lease_until > timestamp '{_g.NOW}', false) order by ts, event_id limit 30", _g.OUTBOX)),
    "a01_counts": (a01_counts, "select source as dataset, count(*) as total from documents group by 1"),
    "a02_latest": (a02_latest, with_tables("sample_revision", "select sample_id, max(revision) as revision, arg_max(id, revision) as revision_id from sample_revision group by 1")),
    "p07_publish_check": (p07_publish_check, with_tables("truth_member", "select partition, count(*) as members, count(distinct \"group\") as groups, (select count(*) from (select \"group\" from truth_member group by 1 having count(distinct partition) > 1 union all select content_digest from truth_member group by 1 having count(distinct partition) > 1)) = 0 as publishable from truth_member group by 1")),
    "p05_units": (p05_units, _l.selected_sql("select unit, count(*) as contributors, count(*) filter (state = 'submitted') as submitted from selected group by 1")),
    "e03_retries": (e03_retries, with_tables("event", "select operation_id, case when state = 'failed' then epoch + 1 else epoch end as next_epoch, state = 'failed' as retryable from (select operation_id, state from fold qualify row_number() over (partition by operation_id order by n desc) = 1) f join (select operation_id, max(epoch) as epoch from seq group by 1) using (operation_id)", _g.SEQ, _g.FOLD).replace("with ", "with recursive ", 1)),
    "e19_dispatches": (e19_dispatches, with_tables("event", "select operation_id, epoch, arg_max(case event_type when 'queued' then 'pending' when 'running' then 'submitted' else 'unknown' end, revision) as status, count(*) as events from seq group by 1, 2", _g.SEQ)),
    "s19_deletion": (s19_deletion, with_tables("location", "select artifact_id, case when count(*) = count(*) filter (outcome = 'missing') then 'deleted' else 'deleting' end as state from location group by 1")),
    "a11_overlap": (cells_total, _l.selected_sql('select "left", "right", sum(n)::bigint as overlap from cell group by 1, 2', _l.CELLS)),
}
