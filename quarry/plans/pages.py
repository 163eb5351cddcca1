"""Page, text and structure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import pages as pg
from quarry.sources import fixtures as fx
from quarry.sources.fixtures import with_tables


def page_paths(spark, d):
    p = fx.page_texts(spark, d)
    crumb = F.when(F.col("page") % 2 == 0, F.concat(F.col("role"), F.lit(" > 1. c"), (F.col("doc") % 3).cast("string"), F.when(F.col("page") % 4 == 0, F.lit(" > Deep")).otherwise(F.lit("")))).otherwise(F.lit(""))
    return p.select("doc", "page", tx.breadcrumb(crumb).alias("path"))


def x16_breadcrumbs(spark, d):
    return page_paths(spark, d).select("doc", "page", F.array_join("path", "|").alias("path"))


def w06_path_carry(spark, d):
    return pg.carry_path(page_paths(spark, d)).select("doc", "page", F.array_join("section", "|").alias("section"))


def w07_path_diff(spark, d):
    return pg.path_headings(pg.carry_path(page_paths(spark, d)))


def roled(spark, d):
    return fx.lines(spark, d).select("doc", (F.floor(F.col("pos") / 10) + 1).alias("page"), "pos", "text", tx.line_roles(F.col("text")).alias("proposed"))


def x17_line_roles(spark, d):
    best = tx.best_role(F.col("proposed"))
    return roled(spark, d).select("doc", "pos", best["role"].alias("role"), best["level"].alias("level"), F.round(best["score"], 6).alias("score"))


def w22_uncertain(spark, d):
    return roled(spark, d).groupBy("doc").agg(F.count_if(tx.uncertain(F.col("proposed"))).alias("uncertain"), F.count(F.lit(1)).alias("lines"))


def w23_review(spark, d):
    rows = roled(spark, d).withColumn("best", tx.best_role(F.col("proposed"))["role"])
    return rows.groupBy("doc").agg(F.count_if(F.col("best") == "heading").alias("headings"), F.count_if(tx.uncertain(F.col("proposed"))).alias("uncertain"), F.array_join(F.sort_array(F.collect_set(F.when(tx.uncertain(F.col("proposed")), F.col("page")))).cast("array<string>"), ",").alias("pages"))


def w08_list_runs(spark, d):
    rows = roled(spark, d).withColumn("role", tx.best_role(F.col("proposed"))["role"])
    return pg.list_runs(rows).groupBy("doc", "page").agg(F.count_if("promoted").alias("promoted"), F.count_if(F.col("role") == "ol_item").alias("items"))


def headings(spark, d):
    rows = fx.lines(spark, d).filter("length(text) > 0")
    return rows.select("doc", (F.floor(F.col("pos") / 10) + 1).alias("page"), "pos", "text", F.when(F.col("pos") % 3 == 0, "heading").otherwise("paragraph").alias("role"), (F.col("pos") % 4 + 1).alias("lvl"), (F.col("doc") % 3).alias("depth"))


def w09_levels(spark, d):
    """Levels of headings under sections of no, one or two titles; labels of repeated sections and titles of the path among them."""
    pos = F.col("pos")
    text = F.when(pos % 7 == 0, "What it is").when(pos % 7 == 3, "Make it Yours:").when(pos % 7 == 5, "1. Book").otherwise(F.concat(F.lit("Title "), (pos % 4).cast("string")))
    rows = fx.lines(spark, d).filter("length(text) > 0").select("doc", (F.floor(pos / 10) + 1).alias("page"), "pos", text.alias("text"), F.when(pos % 3 == 0, "heading").when(pos % 3 == 1, "paragraph").otherwise("ol_item").alias("role"), F.when(pos % 9 == 0, None).when((pos % 3 == 0) | (pos % 5 == 0), pos % 4 + 1).cast("int").alias("hlevel"), F.lit(2).alias("blevel"), F.slice(F.array(F.lit("Book"), F.lit("Part")), F.lit(1), (F.col("doc") % 3).cast("int")).alias("section"))
    out = pg.resolve_levels(rows.withColumn("key", tx.section_key(F.col("text"))))
    return out.filter("role in ('heading', 'chrome')").select("doc", "page", "pos", "role", "level")


LEVELS = """base as (select doc, pos, pos // 10 + 1 as page, pos % 3 = 0 as head, doc % 3 >= 1 and pos % 7 = 5 as named, pos % 7 in (0, 3) as label, pos % 7 = 0 as peer, case when pos % 9 <> 0 and (pos % 3 = 0 or pos % 5 = 0) then pos % 4 + 1 end as hl, doc % 3 + 1 as base, pos % 3 = 2 as item from line where length(text) > 0),
least as (select *, min(coalesce(hl, 2)) filter ((head or hl is not null) and not named and not item) over (partition by doc, page) as least_hl, first_value(base + peer::int) over (partition by doc, head, label, peer order by pos) as locked from base)""", """select doc, page, pos, case when named then 'chrome' else 'heading' end as role, case when not named then case when label then locked else base + greatest(0, coalesce(hl, 2) - coalesce(least_hl, coalesce(hl, 2))) end end::bigint as level from least where head"""


def w10_fix_headings(spark, d):
    heads = headings(spark, d).filter("role = 'heading'").select("doc", "page", "pos", F.concat(F.lit("Part "), (F.floor(F.col("pos") / 6) % 4).cast("string")).alias("text"), F.col("lvl").alias("level"))
    return pg.fix_headings(heads)


def w11_monotone(spark, d):
    numbers = fx.lines(spark, d).select("doc", "pos", (F.length("text").cast("long") % 9 + F.col("pos")).alias("n"))
    return pg.preserve_numbers(numbers)


def blocks(spark, d):
    rows = fx.lines(spark, d)
    pos = F.col("pos")
    kind = F.when(pos % 6 == 0, "heading").when(pos % 6 == 4, "list").when(pos % 6 == 5, "caption").otherwise("paragraph")
    cont = F.when(pos % 6 == 1, "start").when(pos % 6 == 2, "mid").when(pos % 6 == 3, "end")
    return rows.select("doc", (F.floor(pos / 10) + 1).alias("page"), "pos", kind.alias("k"), F.col("text").alias("t"), (pos % 3 + 1).cast("int").alias("lvl"), F.lit(None).cast("string").alias("tone"), cont.alias("cont"))


def continued(spark, d):
    """Blocks whose continued ones are paragraphs, lists and tables in turn; tables begin without text."""
    b = blocks(spark, d)
    kind = F.element_at(F.array(F.lit("paragraph"), F.lit("list"), F.lit("table")), (F.floor(F.col("pos") / 6) % 3 + 1).cast("int"))
    k = F.when(F.col("cont").isNotNull(), kind).otherwise(F.col("k"))
    # Every seventh middle has lost its beginning, every fifth end is of another kind.
    cont = F.when((F.col("cont") == "start") & (F.col("pos") % 7 == 0), None).otherwise(F.col("cont"))
    k = F.when((F.col("cont") == "end") & (F.col("pos") % 5 == 0), "paragraph").otherwise(k)
    b = b.withColumns({"k": k, "cont": cont})
    t = F.when((F.col("k") == "table") & (F.col("cont") == "start"), " ").otherwise(F.col("t"))
    return b.select("doc", "page", "pos", "k", t.alias("t"), "cont", F.when(F.col("k") == "list", F.array("t", F.lit("x"))).alias("items"), F.when(F.col("k") == "table", F.array(F.array("t"))).alias("rows"))


def w12_merge(spark, d):
    m = pg.merge_continuations(continued(spark, d))
    return m.select("doc", "page", "pos", "k", F.sha2("t", 256).alias("sha256"), F.array_join("items", "|").alias("items"), F.size("rows").cast("long").alias("n_rows"))


def w18_figures(spark, d):
    """Lines as blocks of pages of ten; every fifth is a figure with a box in fractions or thousandths, or without one."""
    b = blocks(spark, d)
    pos = F.col("pos")
    y = F.when(pos % 4 != 0, (pos * 37 % 100) / F.when(F.col("doc") % 3 == 0, 0.1).otherwise(100.0))
    z = F.when(pos % 10 < 2, "top").when(pos % 10 > 6, "bottom").otherwise("body")
    rows = b.select("doc", "page", "pos", F.when(pos % 5 == 2, "figure").otherwise(F.col("k")).alias("k"), y.alias("y"), F.when(pos % 5 == 2, F.when(pos % 3 == 0, z)).otherwise(z).alias("z"), F.when(pos % 9 == 0, "bottom").alias("edge"))
    return pg.figures_in_order(rows)


def w13_strip_edges(spark, d):
    b = blocks(spark, d).select("doc", "page", "pos", (F.col("pos") % 10 < 3).alias("at_start"), (F.col("pos") % 10 > 7).alias("at_end"), (F.length("t") % 3 != 0).alias("chrome"))
    return pg.strip_edges(b).select("doc", "page", "pos")


def discards(spark, d):
    p = fx.page_texts(spark, d)
    return p.select("doc", "page", F.when(F.col("page") % 3 == 0, "page_number").when(F.col("role") == "user", "running_header").otherwise("layout_noise").alias("k"), F.concat(F.lit("No.  "), (F.col("page") % 2).cast("string"), F.lit("!")).alias("t"))


def w14_fingerprints(spark, d):
    return pg.chrome_fingerprints(discards(spark, d))


def w14_fingerprints_lenient(spark, d):
    return pg.chrome_fingerprints(discards(spark, d), "lenient")


def w15_offset_vote(spark, d):
    p = fx.page_texts(spark, d)
    name = F.concat(F.lit("Item "), (F.length("text") % 5).cast("string"))
    entries = p.select("doc", F.col("page").alias("pos"), F.concat(F.lit("7. "), name).alias("title"), F.when(F.col("page") % 3 != 0, F.col("page") * 2 - 1).alias("printed"))
    crumb = F.concat(F.upper(name), F.lit(" (of the list)"))
    titles = p.select("doc", "page", F.posexplode(F.array(name, crumb, F.lit("!"))).alias("i", "title"))
    return pg.offset_votes(entries, titles)


def w17_first_titles(spark, d):
    p = fx.page_texts(spark, d).select("doc", "page", tx.section_key(F.concat(F.lit("1. Part "), (F.length("text") % 3).cast("string"))).alias("key"), F.length("text").cast("long").alias("raw"))
    return p.groupBy("doc", "key").agg(F.min_by("raw", "page").alias("raw"), F.min("page").alias("page"))


def w24_stitch(spark, d):
    p = fx.page_texts(spark, d).filter(tx.trim(F.col("text")) != "")
    by = p.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("md"))
    return by.select("doc", F.sha2("md", 256).alias("sha256"), F.length("md").cast("long").alias("chars"))


def x12_text_assessment(spark, d):
    return fx.page_texts(spark, d).select("doc", "page", F.array_join(tx.assess_page(F.col("text")), ",").alias("reasons"))


def a24_uneven_text(spark, d):
    return pg.usable_override(fx.page_texts(spark, d).select("doc", "page", F.when(F.length("text") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("reasons")))


def x13_clean(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(tx.clean_page(F.concat(F.lit("\r\n a-\nb  \n\n\n\n"), "text")), 256).alias("sha256"))


def x14_chrome_keys(spark, d):
    return fx.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), tx.chrome_key(F.concat(F.lit(" #"), "p_name", F.lit("  / "), "p_type", F.lit("!"))).alias("key"))


def x15_section_keys(spark, d):
    return fx.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), tx.section_key(F.concat((F.col("p_partkey") % 120).cast("string"), F.lit(") "), "p_name")).alias("key"))


def x20_prompts(spark, d):
    return fx.lines(spark, d).groupBy("doc").agg(F.count_if(tx.prompt_heading(F.concat("text", F.when(F.col("pos") % 2 == 0, F.lit(":")).otherwise(F.lit(""))))).alias("prompts"))


def x21_page_validate(spark, d):
    p = fx.page_texts(spark, d)
    keep = F.filter(F.array(F.struct(F.when(F.col("page") % 2 == 0, "top").otherwise("body").alias("z"), F.lit(None).cast("string").alias("edge"), F.when(F.col("page") % 3 == 0, F.concat(F.lit("Page "), F.col("page").cast("string"))).otherwise(F.col("text")).alias("t"))), lambda b: F.col("doc") % 7 != 0)
    rows = p.select("doc", "page", (F.lit(2) + F.col("doc") % 2).alias("pages"), (F.col("page") + (F.col("doc") % 5 == 0).cast("int")).alias("wanted_page"), F.lit(2).cast("long").alias("wanted_pages"), keep.alias("keep"), (F.col("doc") % 4 % 2).alias("discard_count"))
    return pg.validate_pages(rows).select("doc", "page", F.array_join("reasons", ",").alias("reasons"), "keep_chars")


def x22_md_validate(spark, d):
    p = fx.page_texts(spark, d)
    md = F.when(F.col("page") % 4 == 0, F.concat(F.lit("# Page "), F.col("page").cast("string"), F.lit("\n---"))).when(F.col("page") % 4 == 1, F.concat(F.lit("```\n"), "text")).when(F.col("page") % 4 == 2, F.lit(" \n ")).otherwise(F.col("text"))
    return p.select("doc", "page", F.array_join(tx.validate_markdown(md), ",").alias("reasons"))


def x23_compile(spark, d):
    return pg.document_markdown(blocks(spark, d)).select("doc", F.sha2("markdown", 256).alias("sha256"))


def x23_tables(spark, d):
    n = fx.table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.array(F.concat("n_name", F.lit("|x")), F.col("n_nationkey").cast("string")))).alias("rows"))
    return n.select(F.col("n_regionkey").cast("long").alias("region"), pg.table_markdown(F.array(F.lit("name"), F.lit("key"), F.lit("none")), F.col("rows")).alias("md"))


def a19_progress(spark, d):
    return pg.progress_rollup(fx.progress(spark, d))


def a20_outputs(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.sum(tx.count(F.concat(F.lit("# A\n"), "text"), r"(?m)^#{1,6}[ \t]+\S+")).cast("long").alias("headings"))


def a21_page_list(spark, d):
    p = fx.page_texts(spark, d)
    md = p.filter("page % 2 = 0").select("doc", "page", F.length("text").cast("long").alias("chars"))
    art = p.filter("page % 3 = 0").select("doc", "page", F.lit(1).cast("long").alias("figures"))
    j = md.join(art, ["doc", "page"], "full")
    zero = F.lit(0).cast("long")
    return j.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce("chars", zero)).alias("chars"), F.sum(F.coalesce("figures", zero)).alias("figures"))


def a22_kinds(spark, d):
    b = blocks(spark, d)
    by = b.groupBy("doc", "page", "k").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("doc", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "n"))), lambda x: F.concat(x["k"], F.lit(":"), x["n"].cast("string"))), " ").alias("kinds"))


def a23_plan(spark, d):
    from pyspark.sql import Window

    p = fx.progress(spark, d).select("doc", "page", (F.col("status") == "pending").alias("blank"))
    every = F.bool_and("blank").over(Window.partitionBy("doc"))
    rows = p.select("doc", (~F.col("blank") | every).alias("digest"))
    by = rows.groupBy("doc").agg(F.count_if("digest").alias("digest"), F.count_if(~F.col("digest")).alias("skip"))
    return by.select("doc", "digest", "skip", F.least(F.lit(4), F.greatest(F.col("digest"), F.lit(1))).cast("long").alias("concurrency"))


def x26_boxes(spark, d):
    li = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("o"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("double").alias("q")).distinct()
    scale = F.when(F.col("o") % 3 == 0, 100.0).when(F.col("o") % 3 == 1, 1.0).otherwise(0.02)
    box = pg.normal_box(F.col("q") / 50 / scale, F.col("q") / 60 / scale, (F.col("n") + 1) / 10 / scale, F.col("n") / 20 / scale, F.lit(800), F.lit(1200))
    return li.select("o", "n", "q", F.round(box["x"], 6).alias("x"), F.round(box["y"], 6).alias("y"), F.round(box["w"], 6).alias("w"), F.round(box["h"], 6).alias("h"))


def x30_page_classes(spark, d):
    e = fx.operation_events(spark, d)
    mean, sd = 230 + F.col("event_id") % 25, F.col("event_id") % 23
    return e.select("event_id", pg.page_class(mean, sd).alias("class"))


def x31_backoff(spark, d):
    return fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("attempt"), tx.backoff_ms(F.col("n_nationkey") + 1, 500, 60_000).alias("ms"))


def x36_names(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("n")).distinct()
    return o.select("n", tx.page_file(F.col("n")).alias("name"))


def s12_page_split(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\f")).alias("i", "t")).filter(tx.trim(F.col("t")) != "")
    return pages.select("doc_id", (F.col("i") + 1).cast("long").alias("page"), F.length("t").cast("long").alias("chars"))


def s18_html(spark, d):
    return fx.table(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.sha2(tx.html_escape(F.col("html")), 256).alias("sha256"))


BLOCK = "block as (select doc, pos // 10 + 1 as page, pos, case when pos % 6 = 0 then 'heading' when pos % 6 = 4 then 'list' when pos % 6 = 5 then 'caption' else 'paragraph' end as k, text as t from line)"
PATH = "path as (select doc, page, case when page % 2 = 0 then role || '|c' || (doc % 3) || case when page % 4 = 0 then '|Deep' else '' end else '' end as p from page_text)"
CARRY = "carry as (select doc, page, coalesce(last_value(nullif(p, '') ignore nulls) over (partition by doc order by page), '') as section from path)"
DISCARD = "discard as (select doc, page, k, k || ':no. ' || (page % 2) as fp from (select *, case when page % 3 = 0 then 'page_number' when role = 'user' then 'running_header' else 'layout_noise' end as k from page_text))"
VOTES = "vote as (select doc, fp, count(distinct page) as pages, bool_or(k in ('page_number', 'running_header')) as strong from discard group by 1, 2)"

QUERIES = {
    "x16_breadcrumbs": (x16_breadcrumbs, with_tables("page_text", "select doc, page, p as path from path", PATH)),
    "w06_path_carry": (w06_path_carry, with_tables("page_text", "select * from carry", PATH, CARRY)),
    "w07_path_diff": (w07_path_diff, with_tables("page_text", "select doc, page, least(6, start + i)::bigint as level, title from (select doc, page, start, unnest(s[start + 1:]) as title, unnest(range(1, len(s[start + 1:]) + 1)) as i from (select doc, page, s, coalesce(list_filter(range(1, greatest(len(s), len(b)) + 1), lambda i: s[i] is distinct from b[i])[1] - 1, len(s)) as start from (select doc, page, s, coalesce(lag(s) over (partition by doc order by page), []) as b from (select doc, page, coalesce(last_value(string_split(nullif(p, ''), '|') ignore nulls) over (partition by doc order by page rows between unbounded preceding and current row), []) as s from path))))", PATH)),
    "x17_line_roles": (x17_line_roles, None),
    "w22_uncertain": (w22_uncertain, None),
    "w23_review": (w23_review, None),
    "w08_list_runs": (w08_list_runs, None),
    "w09_levels": (w09_levels, with_tables("line", LEVELS[1], LEVELS[0])),
    "w10_fix_headings": (w10_fix_headings, with_tables("line", "select doc, page, pos, text, min(level) over (partition by doc, text) as level from (select *, lag(text) over w as pt, lag(level) over w as pl from (select doc, pos // 10 + 1 as page, pos, 'Part ' || (pos // 6 % 4) as text, pos % 4 + 1 as level from line where length(text) > 0 and pos % 3 = 0) window w as (partition by doc order by page, pos)) where not coalesce(pt = text and pl = level, false)")),
    "w11_monotone": (w11_monotone, with_tables("line", "select doc, count(*) as numbers, sum(back)::bigint as inversions, sum(back) = 0 or sum(back) * 10 < count(*) - 1 as preserve from (select doc, coalesce(n < lag(n) over (partition by doc order by pos) and n <> 1, false)::bigint as back from (select doc, pos, length(text) % 9 + pos as n from line)) group by 1")),
    "w12_merge": (w12_merge, with_tables("line", "select doc, f.page as page, f.pos as pos, k, sha256(case when k = 'paragraph' then list_reduce(ts, lambda a, x: regexp_replace(a, '\\s+$', '') || ' ' || regexp_replace(x, '^\\s+', '')) when k = 'table' and trim(ts[1]) = '' then coalesce(list_filter(ts, lambda x: trim(x) <> '')[1], ts[1]) else ts[1] end) as sha256, case when k = 'list' then array_to_string(list_transform(own, lambda x: x || '|x'), '|') else '' end as items, case when k = 'table' then len(ts) else 0 end as n_rows from (select doc, min(k) as k, min({'page': page, 'pos': pos}) as f, list(t order by page, pos) as ts, list(own order by page, pos) as own from opened group by doc, island, case when opener is distinct from 'start' then pos end)", BLOCK, "was as (select *, case pos % 6 when 1 then 'start' when 2 then 'mid' when 3 then 'end' end as c from block)", "made as (select doc, page, pos, case when c = 'end' and pos % 5 = 0 then 'paragraph' when c is not null then ['paragraph', 'list', 'table'][1 + pos // 6 % 3] else k end as k, t as own, case when c = 'start' and pos % 7 = 0 then null else c end as cont from was)", "went as (select *, case when k = 'table' and cont = 'start' then ' ' else own end as t, coalesce(cont in ('mid', 'end') and k in ('paragraph', 'list', 'table') and lag(k) over w = k and lag(cont) over w in ('start', 'mid'), false) as goes from made window w as (partition by doc order by page, pos))", "island as (select *, sum(case when goes then 0 else 1 end) over (partition by doc order by page, pos) as island from went)", "opened as (select *, first_value(cont) over (partition by doc, island order by page, pos) as opener from island)")),
    "w18_figures": (w18_figures, None),
    "w13_strip_edges": (w13_strip_edges, with_tables("line", "select doc, page, pos from (select doc, page, pos, min(case when not (chrome and s) then pos end) over w as f, max(case when not (chrome and e) then pos end) over w as l from (select doc, page, pos, pos % 10 < 3 as s, pos % 10 > 7 as e, length(t) % 3 <> 0 as chrome from block) window w as (partition by doc, page)) where pos between f and l", BLOCK)),
    "w14_fingerprints": (w14_fingerprints, with_tables("page_text", "select doc, fp as fingerprint, pages from vote where pages >= 2 or strong", DISCARD, VOTES)),
    "w14_fingerprints_lenient": (w14_fingerprints_lenient, with_tables("page_text", "select doc, fp as fingerprint, pages from vote where pages >= 3 or fp like 'page_number:%'", DISCARD, VOTES)),
    "w15_offset_vote": (w15_offset_vote, with_tables("page_text", "select doc, \"offset\", votes from (select e.doc, p.page - e.printed as \"offset\", count(*) as votes, min(e.page * 100000 + p.page * 10 + p.i) as seen from entry e join title p on e.doc = p.doc and (contains(e.key, p.key) or contains(p.key, e.key)) where e.n <= 24 and p.n <= 12 group by 1, 2) qualify row_number() over (partition by doc order by votes desc, seen) = 1", "entry as (select doc, page, page * 2 - 1 as printed, 'item ' || (length(text) % 5) as key, row_number() over (partition by doc order by page) as n from page_text where page % 3 <> 0)", "title as (select doc, page, i, case i when 0 then 'item ' || (length(text) % 5) else 'item ' || (length(text) % 5) || ' of the list' end as key, dense_rank() over (partition by doc order by page) as n from page_text, range(0, 2) r(i))")),
    "w17_first_titles": (w17_first_titles, with_tables("page_text", "select doc, 'part ' || (length(text) % 3) as key, arg_min(length(text), page) as raw, min(page) as page from page_text group by 1, 2")),
    "w24_stitch": (w24_stitch, with_tables("page_text", "select doc, sha256(md) as sha256, length(md) as chars from (select doc, string_agg(text, chr(10) || chr(10) order by page) as md from page_text where trim(text) <> '' group by 1)")),
    "x12_text_assessment": (x12_text_assessment, None),
    "a24_uneven_text": (a24_uneven_text, with_tables("page_text", "select doc, page, u and not (count(*) over w >= 5 and sum(u::int) over w * 4 < count(*) over w * 3) as use_text from (select doc, page, length(text) % 3 <> 0 as u from page_text) window w as (partition by doc)")),
    "x13_clean": (x13_clean, None),
    "x14_chrome_keys": (x14_chrome_keys, "select p_partkey::bigint as id, trim(regexp_replace(regexp_replace(lower(' #' || p_name || '  / ' || p_type || '!'), '\\s+', ' ', 'g'), '[^\\p{L}\\p{N}\\s./-]+', '', 'g')) as key from part"),
    "x15_section_keys": (x15_section_keys, "select p_partkey::bigint as id, trim(regexp_replace(regexp_replace(lower(p_name), '\\s+', ' ', 'g'), '[^\\p{L}\\p{N}\\s./-]+', '', 'g')) as key from part"),
    "x20_prompts": (x20_prompts, None),
    "x21_page_validate": (x21_page_validate, with_tables("page_text", "select doc, page, array_to_string(list_filter([case when page <> wanted then 'page_mismatch' end, case when 2 + doc % 2 <> 2 then 'pages_mismatch' end, case when not filled and dropped = 0 then 'empty' end, case when n > 0 and n < 12 then 'keep_too_short' end, case when filled and (num or trim(t) = '') and n > 0 then 'keep_chrome_only' end, case when n >= 24 and dropped = 0 then 'discard_empty' end, case when dropped = 0 and filled and page % 2 = 0 and num then 'page_number_in_keep' end], lambda x: x is not null), ',') as reasons, n as keep_chars from (select *, case when filled then length(t) else 0 end as n, regexp_matches(trim(t), '(?i)^(#{1,6}\\s*)?(page\\s*[0-9]+(\\s*(of|/)\\s*[0-9]+)?|[0-9]+\\s*/\\s*[0-9]+|[0-9]{1,4})$') as num from (select doc, page, page + case when doc % 5 = 0 then 1 else 0 end as wanted, doc % 4 % 2 as dropped, doc % 7 <> 0 as filled, case when page % 3 = 0 then 'Page ' || page else text end as t from page_text))")),
    "x22_md_validate": (x22_md_validate, with_tables("page_text", "select doc, page, case when t = '' then 'empty' else array_to_string(list_filter([case when length(t) < 24 then 'too_short' end, case when len(regexp_extract_all(t, '```')) % 2 <> 0 then 'unbalanced_fences' end, case when len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '' and not regexp_matches(trim(x), '(?i)^(#{1,6}\\s*)?(page\\s*[0-9]+(\\s*(of|/)\\s*[0-9]+)?|[0-9]+\\s*/\\s*[0-9]+|-+)$'))) = 0 then 'chrome_only' end], lambda x: x is not null), ',') end as reasons from (select doc, page, trim(case page % 4 when 0 then '# Page ' || page || chr(10) || '---' when 1 then '```' || chr(10) || text when 2 then '' else text end, ' ' || chr(10) || chr(9) || chr(13)) as t from page_text)")),
    "x23_compile": (x23_compile, None),
    "x23_tables": (x23_tables, "select n_regionkey::bigint as region, '| name | key | none |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_name || '\\|x | ' || n_nationkey || ' |  |', chr(10) order by n_name || '|x') as md from nation group by 1"),
    "a19_progress": (a19_progress, with_tables("progress", "select doc, count(*) as pages, count(*) filter (status = 'done') as done, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'pending') as pending, least(99, count(*) filter (status = 'done') * 100 // count(*))::bigint as percent from progress group by 1")),
    "a20_outputs": (a20_outputs, "select source, count(*) as files, sum(octet_length(encode(text)))::bigint as bytes, sum(len(regexp_extract_all('# A' || chr(10) || text, '(?m)^#{1,6}[ \\t]+\\S+')))::bigint as headings from documents group by 1"),
    "a21_page_list": (a21_page_list, with_tables("page_text", "select doc, count(*) as pages, sum(case when page % 2 = 0 then length(text) else 0 end)::bigint as chars, sum(case when page % 3 = 0 then 1 else 0 end)::bigint as figures from page_text where page % 2 = 0 or page % 3 = 0 group by 1")),
    "a22_kinds": (a22_kinds, with_tables("line", "select doc, page, string_agg(k || ':' || n, ' ' order by k) as kinds from (select doc, page, k, count(*) as n from block group by 1, 2, 3) group by 1, 2", BLOCK)),
    "a23_plan": (a23_plan, with_tables("progress", "select doc, digest, n - digest as skip, least(4, greatest(digest, 1))::bigint as concurrency from (select doc, count(*) as n, case when count(*) filter (status <> 'pending') = 0 then count(*) else count(*) filter (status <> 'pending') end as digest from progress group by 1)")),
    "x26_boxes": (x26_boxes, "with li as (select distinct l_orderkey::bigint as o, l_linenumber::bigint as n, l_quantity::double as q from lineitem), b as (select *, q / 50 / k as x, q / 60 / k as y, (n + 1) / 10 / k as w, n / 20 / k as h from (select *, case o % 3 when 0 then 100.0::double when 1 then 1.0::double else 0.02::double end as k from li)), f as (select o, n, q, x / sx as x, y / sy as y, w / sx as w, h / sy as h from (select *, case when greatest(x + w, y + h) <= 1.5 then 1.0::double when greatest(x + w, y + h) <= 1000 then 1000.0::double else 800.0::double end as sx, case when greatest(x + w, y + h) <= 1.5 then 1.0::double when greatest(x + w, y + h) <= 1000 then 1000.0::double else 1200.0::double end as sy from b)), c as (select *, greatest(0, least(1, x)) as cx, greatest(0, least(1, y)) as cy, w between 0.03 and 1.5 and h between 0.03 and 1.5 as ok from f) select o, n, q, case when ok then round(cx, 6) end as x, case when ok then round(cy, 6) end as y, case when ok then round(least(w, 1 - cx), 6) end as w, case when ok then round(least(h, 1 - cy), 6) end as h from c"),
    "x30_page_classes": (x30_page_classes, with_tables("event", "select event_id, case when 230 + event_id % 25 > 245 and event_id % 23 < 8 then 'blank' when 230 + event_id % 25 > 235 and event_id % 23 < 18 then 'sparse' else 'content' end as \"class\" from event")),
    "x31_backoff": (x31_backoff, "select n_nationkey::bigint as attempt, least(60000.0, 500 * pow(2.0, n_nationkey))::bigint as ms from nation"),
    "x36_names": (x36_names, "select distinct o_orderkey::bigint as n, 'page-' || case when length(o_orderkey::varchar) < 3 then lpad(o_orderkey::varchar, 3, '0') else o_orderkey::varchar end || '.md' as name from orders"),
    "s12_page_split": (s12_page_split, "select doc_id, page, length(t) as chars from (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(1, len(string_split(text, chr(10))) + 1)) as page from documents) where trim(t, ' ' || chr(9) || chr(13)) <> ''"),
    "s18_html": (s18_html, "select page_id::bigint as page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) as sha256 from pages"),
}
