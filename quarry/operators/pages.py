"""Pages of documents as a table of blocks (doc, page, pos, k, z, t, ...): carried paths, runs, levels, merges, chrome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx


def carry_path(pages: DataFrame, path: str = "path") -> DataFrame:
    """Each page's section path: its own, else that of the last page that had one."""
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.size(path) > 0, F.col(path))
    return pages.withColumn("section", F.coalesce(F.last(own, True).over(w), F.array().cast("array<string>")))


def path_tail(section: Column, before: Column) -> Column:
    """The headings (level, title) that a change of path from ``before`` to ``section`` brings: the tail after what both share, without numbers."""
    same = F.zip_with(F.transform(section, tx.section_key), F.transform(before, tx.section_key), lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.array_position(same, False)
    start = F.when(shared > 0, shared - 1).otherwise(F.size(section)).cast("int")
    tail = F.slice(section, start + 1, F.greatest(F.size(section) - start, F.lit(0)))
    return F.transform(tail, lambda x, i: F.struct(F.least(F.lit(6), start + i + 1).cast("long").alias("level"), tx.without_number(x).alias("title")))


def path_headings(pages: DataFrame) -> DataFrame:
    """doc, page, level and title of the headings that a change of path brings: its tail after what it shares with the page before."""
    w = Window.partitionBy("doc").orderBy("page")
    rows = pages.withColumn("prev", F.coalesce(F.lag("section").over(w), F.array().cast("array<string>")))
    return rows.select("doc", "page", F.inline(path_tail(F.col("section"), F.col("prev"))))


def list_runs(lines: DataFrame, order: str = "pos", keep: list[str] | None = None) -> DataFrame:
    """Lines (doc, page, pos, text, role) with the runs of list-like lines of a page promoted to ``ol_item``.

    A run has two lines or more, or is a lone line ``a.``; prompts end runs.
    ``order``: the column of a line's place on its page; ``keep``: the columns
    that stay beside role and promoted.
    """
    t = tx.trim(F.col("text"))
    letter, number = t.rlike(tx.LETTER), t.rlike(tx.NUMBER)
    prompt = tx.prompt_heading(F.col("text"))
    short = F.length("text") <= 80
    cue = ~prompt & ((F.col("role") == "ol_item") | letter | (number & short))
    opens = ~prompt & ((F.col("role") == "ol_item") | ((F.col("role") == "heading") & letter & short))
    w = Window.partitionBy("doc", "page").orderBy(order)
    no = lambda c: F.coalesce(c, F.lit(False))
    rows = lines.withColumns({"cue": no(cue), "opens": no(opens), "a": F.lower(F.regexp_extract(t, tx.LETTER, 1)) == "a", "__n": F.row_number().over(w)})
    # Within neighbouring cues the run begins at the first line that may open one, and goes on to their end: one order of rows does for all.
    upto = lambda when: F.coalesce(F.last(F.when(when, F.col("__n")), True).over(w), F.lit(0))
    rows = rows.withColumn("in_run", F.col("cue") & (upto(F.col("cue") & F.col("opens")) > upto(~F.col("cue"))))
    promoted = F.col("in_run") & (no(F.lag("in_run").over(w)) | no(F.lead("in_run").over(w)) | F.col("a"))
    kept = ["doc", "page", "pos", "text"] if keep is None else keep
    return rows.withColumn("promoted", F.coalesce(promoted, F.lit(False))).select(*kept, F.when(F.col("promoted"), "ol_item").otherwise(F.col("role")).alias("role"), "promoted")


def resolve_levels(lines: DataFrame, order: str = "pos") -> DataFrame:
    """Levels of heading lines under their pages' sections: ``role`` and ``level`` of lines (doc, page, text, key, role, hlevel, blevel, section).

    ``hlevel`` is the level at which a line is proposed as a heading (null: it
    isn't), ``blevel`` that of its best role. A heading that the path names is
    chrome, but for labels of repeated sections. Such a label takes the level
    that its slot got first in the document: the body's base, one below it for
    peers. Others stand as far under the base as their proposal is under the
    page's least one; the path's own titles, list items and chrome don't count.
    """
    clamp = lambda c: F.least(F.lit(6), F.greatest(F.lit(1), c))
    # Only headings and what is proposed as one count against the path.
    named = F.when((F.col("role") == "heading") | F.col("hlevel").isNotNull(), F.array_contains(F.transform("section", tx.section_key), F.col("key"))).otherwise(F.lit(False))
    rows = lines.withColumns({"__named": named, "__label": tx.is_section_label(F.col("text")), "__slot": tx.slot_key(F.col("text"))})
    head = F.col("role") == "heading"
    rows = rows.withColumn("role", F.when(head & F.col("__named") & ~F.col("__label"), "chrome").otherwise(F.col("role")))
    base = clamp(F.size("section") + 1)
    seen = F.coalesce(F.col("hlevel"), F.col("blevel"), F.lit(2))
    counts = (head | F.col("hlevel").isNotNull()) & ~F.col("__named") & ~F.col("role").isin("ol_item", "ul_item", "chrome")
    least = F.min(F.when(counts, seen)).over(Window.partitionBy("doc", "page"))
    first = F.when(F.col("__slot") == tx.BLOCK_SLOT, base).otherwise(clamp(base + 1))
    lock = F.min(F.when(head & F.col("__label"), F.struct("page", F.col(order).alias("at"), first.alias("level")))).over(Window.partitionBy("doc", "__slot"))["level"]
    rows = rows.withColumn("__least", F.coalesce(least, seen)).withColumn("__lock", lock)
    level = F.when(F.col("__label"), F.col("__lock")).otherwise(clamp(base + F.greatest(F.lit(0), seen - F.col("__least"))))
    return rows.withColumn("level", F.when(head, level).cast("long")).drop("__named", "__label", "__slot", "__least", "__lock")


def heading_levels(lines: DataFrame) -> DataFrame:
    """Levels of heading lines (doc, page, pos, role, lvl, depth): depth + 1, plus how far a line stands under the page's least; 1 to 6."""
    least = F.min("lvl").over(Window.partitionBy("doc", "page"))
    base = F.least(F.lit(6), F.greatest(F.lit(1), F.col("depth") + 1))
    level = F.least(F.lit(6), F.greatest(F.lit(1), base + F.col("lvl") - least))
    rows = lines.withColumn("level", F.when(F.col("role") == "heading", level).cast("long"))
    heads = rows.filter("role = 'heading'")
    w = Window.partitionBy("doc").orderBy("page", "pos")
    return heads.withColumn("jump", F.coalesce(F.col("level") - F.lag("level").over(w) > 2, F.lit(False)))


def fix_headings(heads: DataFrame) -> DataFrame:
    """Drop a heading equal to the one before it; a title with several levels takes the least."""
    w = Window.partitionBy("doc").orderBy("page", "pos")
    rows = heads.withColumn("key", tx.section_key(F.col("text")))
    again = (F.lag("key").over(w) == F.col("key")) & (F.lag("level").over(w) == F.col("level"))
    kept = rows.withColumn("again", F.coalesce(again, F.lit(False))).filter(~F.col("again"))
    return kept.withColumn("level", F.min("level").over(Window.partitionBy("doc", "key"))).select("doc", "page", "pos", "text", "level")


def preserve_numbers(numbers: DataFrame) -> DataFrame:
    """Whether the catalog numbers of a document are chapters: under a tenth of the steps goes back (to other than 1)."""
    w = Window.partitionBy("doc").orderBy("pos")
    prev = F.lag("n").over(w)
    rows = numbers.select("doc", "n", F.coalesce((F.col("n") < prev) & (F.col("n") != 1), F.lit(False)).cast("long").alias("back"))
    by = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("numbers"), F.sum("back").alias("inversions"))
    return by.select("doc", "numbers", "inversions", ((F.col("inversions") == 0) | (F.col("inversions") * 10 < F.col("numbers") - 1)).alias("preserve"))


#: Kinds of discarded blocks that are page furniture even once.
STRONG = ("page_number", "running_header", "running_footer", "folio", "branding")


def chrome_fingerprints(discards: DataFrame, mode: str = "normal") -> DataFrame:
    """doc, fingerprint and pages of texts that count as page furniture (discards: doc, page, k, t)."""
    norm = tx.chrome_key(F.col("t"))
    mark = F.when(norm != "", norm).when(F.col("k").isin("branding", "decorative"), "(mark)")
    once = discards.select("doc", "page", "k", F.concat_ws(":", "k", mark).alias("fingerprint"), mark.alias("mark")).filter("mark is not null").drop("mark").distinct()
    votes = once.groupBy("doc", "fingerprint").agg(F.count(F.lit(1)).alias("pages"), F.bool_or(F.col("k").isin(*STRONG)).alias("strong"))
    if mode == "lenient":
        ok = F.col("fingerprint").startswith("page_number:") | (F.col("pages") >= 3)
    else:
        ok = F.lit(mode == "aggressive") | (F.col("pages") >= 2) | F.col("strong")
    return votes.filter(ok).select("doc", "fingerprint", "pages")


def strip_edges(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, page, pos, at_start, at_end, chrome) of each page between its first and last one that isn't strippable."""
    w = Window.partitionBy("doc", "page")
    first = F.min(F.when(~(F.col("chrome") & F.col("at_start")), F.col("pos"))).over(w)
    last = F.max(F.when(~(F.col("chrome") & F.col("at_end")), F.col("pos"))).over(w)
    return blocks.withColumns({"__first": first, "__last": last}).filter((F.col("pos") >= F.col("__first")) & (F.col("pos") <= F.col("__last"))).drop("__first", "__last")


def offset_votes(entries: DataFrame, titles: DataFrame, most_entries: int = 24, most_pages: int = 12) -> DataFrame:
    """The offset from printed to real pages that most matches speak for, the first seen of equals.

    Entries (doc, pos, title, printed) of the contents, the first that have a
    printed page, are matched with the titles (doc, page, i, title: headings
    and last breadcrumbs) of the first pages: normalised, they are equal or one
    contains the other.
    """
    e = entries.filter(F.col("printed").isNotNull()).withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("pos")))
    e = e.filter(F.col("n") <= most_entries).withColumn("key", tx.section_key(F.col("title"))).filter("key <> ''").alias("e")
    p = titles.withColumn("n", F.dense_rank().over(Window.partitionBy("doc").orderBy("page")))
    p = p.filter(F.col("n") <= most_pages).withColumn("key", tx.section_key(F.col("title"))).filter("key <> ''").alias("p")
    met = e.join(p, (F.col("e.doc") == F.col("p.doc")) & (F.col("e.key").contains(F.col("p.key")) | F.col("p.key").contains(F.col("e.key"))))
    votes = met.groupBy(F.col("e.doc").alias("doc"), (F.col("p.page") - F.col("e.printed")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct(F.col("e.pos"), F.col("p.page"), F.col("p.i"))).alias("seen"))
    w = Window.partitionBy("doc").orderBy(F.desc("votes"), "seen")
    return votes.withColumn("n", F.row_number().over(w)).filter("n = 1").select("doc", "offset", "votes")


def merge_continuations(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, page, pos, k, t, cont, items, rows) with continued ones put together: paragraphs' texts joined, lists' items and tables' rows one after another.

    A block goes on if it is in the middle or at the end of something of the
    kind of the block before, which begins it or is in its middle. Runs of such
    blocks are islands; those that nothing begins stay as they are. A table
    without text of its own takes the first text of its parts.
    """
    w = Window.partitionBy("doc").orderBy("page", "pos")
    on = F.col("cont").isin("mid", "end") & F.col("k").isin("paragraph", "list", "table") & (F.lag("k").over(w) == F.col("k")) & F.lag("cont").over(w).isin("start", "mid")
    found = blocks.withColumn("on", F.coalesce(on, F.lit(False))).withColumn("island", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(w))
    begun = F.first("cont").over(Window.partitionBy("doc", "island").orderBy("page", "pos")).eqNullSafe("start")
    found = found.withColumn("alone", F.when(~begun, F.struct("page", "pos")))
    parts = F.sort_array(F.collect_list(F.struct("page", "pos", "t", "items", "rows")))
    by = found.groupBy("doc", "island", "alone").agg(F.min("k").alias("k"), parts.alias("p"))
    first, rest = F.col("p")[0], F.slice("p", 2, F.size("p") - 1)
    joined = F.aggregate(rest, first["t"], lambda acc, x: F.concat(tx.trim_end(acc), F.lit(" "), tx.trim_start(x["t"])))
    filled = F.filter("p", lambda x: tx.trim(x["t"]) != "")
    text = F.when(F.col("k") == "paragraph", joined).when((F.col("k") == "table") & (F.size(filled) > 0) & (tx.trim(first["t"]) == ""), F.get(filled, F.lit(0))["t"]).otherwise(first["t"])
    gathered = lambda c: F.flatten(F.transform(F.filter("p", lambda x: x[c].isNotNull()), lambda x: x[c]))
    return by.select("doc", first["page"].alias("page"), first["pos"].alias("pos"), "k", text.alias("t"), gathered("items").alias("items"), gathered("rows").alias("rows"))


def validate_pages(pages: DataFrame) -> DataFrame:
    """Why page IRs are refused: pages (doc, page, pages, wanted_page, wanted_pages, keep array<struct<z, edge, t>>, discard_count)."""
    chars = F.aggregate("keep", F.lit(0), lambda acc, b: acc + F.length(b["t"]))
    number = lambda b: tx.page_number_like(b["t"])
    only = (F.size("keep") > 0) & F.forall("keep", lambda b: number(b) | (tx.trim(b["t"]) == ""))
    leaked = (F.col("discard_count") == 0) & F.exists("keep", lambda b: (b["z"].isin("top", "bottom") | b["edge"].isNotNull()) & number(b))
    reasons = [
        (F.col("page") != F.col("wanted_page"), "page_mismatch"),
        (F.col("pages") != F.col("wanted_pages"), "pages_mismatch"),
        ((F.size("keep") == 0) & (F.col("discard_count") == 0), "empty"),
        ((chars > 0) & (chars < 12), "keep_too_short"),
        (only & (chars > 0), "keep_chrome_only"),
        ((F.col("wanted_pages") > 1) & (chars >= 24) & (F.col("discard_count") == 0), "discard_empty"),
        (leaked, "page_number_in_keep"),
    ]
    return pages.select("doc", "page", F.array_compact(F.array(*[F.when(c, F.lit(why)) for c, why in reasons])).alias("reasons"), chars.cast("long").alias("keep_chars"))


def block_markdown(k: Column, t: Column, lvl: Column, tone: Column) -> Column:
    """Markdown of a block of one text."""
    body = tx.trim(t)
    return (
        F.when(k == "heading", F.concat(F.repeat(F.lit("#"), lvl), F.lit(" "), body))
        .when(k == "callout", F.concat(F.lit("> **"), F.upper(F.coalesce(tone, F.lit("note"))), F.lit(":** "), body))
        .when(k == "caption", F.concat(F.lit("*"), body, F.lit("*")))
        .when(k == "code", F.concat(F.lit("```\n"), F.regexp_replace(t, r"\s+$", ""), F.lit("\n```")))
        .when(k == "math", F.concat(F.lit("$"), body, F.lit("$")))
        .when(k == "list", F.concat(F.lit("- "), F.regexp_replace(body, r"^[-*•]\s+", "")))
        .otherwise(body)
    )


def document_markdown(blocks: DataFrame) -> DataFrame:
    """The Markdown of each document: its blocks' in order, an empty line between, none for empty blocks."""
    md = block_markdown(F.col("k"), F.col("t"), F.col("lvl"), F.col("tone"))
    parts = blocks.select("doc", F.struct("page", "pos", md.alias("md")).alias("b")).filter(F.length("b.md") > 0)
    return parts.groupBy("doc").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["md"]), "\n\n"), F.lit("\n")).alias("markdown"))


def table_markdown(headers: Column, rows: Column) -> Column:
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), "\n", " ")
    line = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: line(F.transform(headers, lambda _, i: cell(F.get(r, i)))))
    return F.array_join(F.concat(F.array(line(F.transform(headers, cell)), line(F.transform(headers, lambda _: F.lit("---")))), body), "\n")


def progress_rollup(progress: DataFrame, by: str = "doc", completed: Column | None = None) -> DataFrame:
    """Counts of pages by status, and a percentage that stays under 100 until the run is completed."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = progress.groupBy(by).agg(F.count(F.lit(1)).alias("pages"), n("done").alias("done"), n("failed").alias("failed"), n("pending").alias("pending"))
    pct = F.floor(F.col("done") * 100 / F.col("pages"))
    full = F.lit(False) if completed is None else completed
    return out.withColumn("percent", F.when(full, F.lit(100)).otherwise(F.least(F.lit(99), pct)).cast("long"))


def usable_override(pages: DataFrame, least_pages: int = 5) -> DataFrame:
    """Whether a page's text is used: its own reasons, overruled if the document has enough texts of which under 75 % are usable."""
    w = Window.partitionBy("doc")
    usable = (F.size("reasons") == 0).cast("int")
    bad = (F.count(F.lit(1)).over(w) >= least_pages) & (F.sum(usable).over(w) * 4 < F.count(F.lit(1)).over(w) * 3)
    return pages.select("doc", "page", ((usable == 1) & ~bad).alias("use_text"))


def normal_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box as fractions of its page, from fractions, thousandths or pixels; null if it is too small or off the page."""
    most = F.greatest(x + w, y + h)
    sx = F.when(most <= 1.5, 1.0).when(most <= 1000, 1000.0).otherwise(width.cast("double"))
    sy = F.when(most <= 1.5, 1.0).when(most <= 1000, 1000.0).otherwise(height.cast("double"))
    fx, fy, fw, fh = x / sx, y / sy, w / sx, h / sy
    ok = (fw >= 0.03) & (fh >= 0.03) & (fw <= 1.5) & (fh <= 1.5)
    cx, cy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fx)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), fy))
    return F.when(ok, F.struct(cx.alias("x"), cy.alias("y"), F.least(fw, 1 - cx).alias("w"), F.least(fh, 1 - cy).alias("h")))


def page_class(mean: Column, sd: Column) -> Column:
    return F.when((mean > 245) & (sd < 8), "blank").when((mean > 235) & (sd < 18), "sparse").otherwise("content")


def figure_height(y: Column, z: Column) -> Column:
    """How far down its page a figure stands, 0 to 1: from its box, in fractions or thousandths, else from its zone."""
    zone = F.when(z == "top", 0.1).when(z == "bottom", 0.85).otherwise(0.5)
    return F.when(y.isNull() | F.isnan(y), zone).when(y <= 1, y).when(y <= 1000, y / 1000).otherwise(0.5)


def figure_order(blocks: Column) -> Column:
    """The places (``pos``) of a page's blocks, an array of structs (pos, figure, heading, low, h, top) in order, once its figures stand where they belong.

    Figures are put in from the top down. High ones (above 0.35 or in the top
    zone) go behind the first heading, else first; low ones (below 0.65, or
    low) before the run of low texts and figures that ends the page; others in
    proportion to their height.
    """
    others = F.filter(blocks, lambda b: ~b["figure"])
    figures = F.array_sort(F.transform(F.filter(blocks, lambda b: b["figure"]), lambda b: F.struct(b["h"].alias("h"), b["pos"].alias("pos"), b.alias("b"))))

    def put(done: Column, x: Column) -> Column:
        fig, n = x["b"], F.size(done)
        after_heading = F.array_position(F.transform(done, lambda b: b["heading"]), True).cast("int")
        # Behind the last text that isn't low stands the run that ends the page; a figure in front of its first text stays in front.
        last_high = F.aggregate(F.transform(done, lambda b, i: F.when(~b["figure"] & ~b["low"], i + 1).otherwise(0)), F.lit(0), lambda acc, i: F.greatest(acc, i))
        first_text = F.aggregate(F.transform(done, lambda b, i: F.when(~b["figure"] & (i >= last_high), i).otherwise(n)), n, lambda acc, i: F.least(acc, i))
        middle = F.greatest(F.lit(1), F.least(n, F.floor(n * fig["h"]).cast("int")))
        at = F.when((fig["h"] < 0.35) | fig["top"], after_heading).when((fig["h"] > 0.65) | fig["low"], first_text).otherwise(middle)
        return F.concat(F.slice(done, F.lit(1), at), F.array(fig), F.slice(done, at + 1, F.greatest(n - at, F.lit(0))))

    return F.transform(F.aggregate(figures, others, put), lambda b: b["pos"])


def figures_in_order(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, page, pos, k, y, z, edge) with figures put where they stand, from the top down; rank is the new place. Each figure's place depends on those put before it, so a page's places are one array."""
    low = F.coalesce((F.col("z") == "bottom") | (F.col("edge") == "bottom"), F.lit(False))
    item = F.struct("pos", (F.col("k") == "figure").alias("figure"), (F.col("k") == "heading").alias("heading"), low.alias("low"), figure_height(F.col("y"), F.col("z")).alias("h"), F.col("z").eqNullSafe("top").alias("top"))
    by = blocks.groupBy("doc", "page").agg(F.array_sort(F.collect_list(item)).alias("b"), F.map_from_entries(F.collect_list(F.struct("pos", "k"))).alias("kinds"))
    placed = by.select("doc", "page", "kinds", F.posexplode(figure_order(F.col("b"))).alias("rank", "pos"))
    return placed.select("doc", "page", "pos", F.element_at("kinds", F.col("pos")).alias("k"), F.col("rank").cast("long"))
