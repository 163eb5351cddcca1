"""Tables of contents, text pages as blocks, list groups, figures and structure hints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.binding import let
from quarry.operators.graph import checkpointed


def flatten_toc(entries: DataFrame) -> DataFrame:
    """Rows (doc, id, parent, title, printed, level) with the path of titles from the root, however deep: a join a level, until no level is left."""
    clean = tx.without_number(tx.trim(F.col("title")))
    rows = entries.withColumn("title", clean)
    level = rows.filter("parent is null").withColumn("path", F.array("title"))
    out = []
    while not out or not level.isEmpty():
        level = checkpointed(level)
        out.append(level)
        up = level.select(F.col("doc").alias("__doc"), F.col("id").alias("__id"), F.col("path").alias("__path"))
        level = rows.join(up, (F.col("doc") == F.col("__doc")) & (F.col("parent") == F.col("__id"))).withColumn("path", F.concat("__path", F.array("title"))).drop("__doc", "__id", "__path")
    return reduce(DataFrame.unionByName, out)


def paths_from_toc(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """Each page's path (doc, page, heading, offset): that of the entries printed on it, else of those whose title matches its heading; the longest."""
    t = toc.select(F.col("doc").alias("__doc"), "printed", "path", tx.section_key(F.col("title")).alias("key"))
    p = pages.withColumn("__h", tx.section_key(F.col("heading")))
    met = p.join(t, p.doc == F.col("__doc"))
    exact = F.coalesce(F.col("printed") + F.col("offset") == F.col("page"), F.lit(False))
    fuzzy = (F.length("__h") > 0) & (F.col("key").contains(F.col("__h")) | F.col("__h").contains(F.col("key")))
    rank = F.when(exact, 2).when(fuzzy, 1)
    best = met.withColumn("__r", rank).filter("__r is not null").groupBy("doc", "page").agg(F.max_by("path", F.struct("__r", F.size("path"), F.array_join("path", "\n"))).alias("path"))
    return pages.select("doc", "page").join(best, ["doc", "page"], "left").select("doc", "page", F.coalesce("path", F.array().cast("array<string>")).alias("path"))


def line_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of a text page's lines (doc, page, pos, text): lists of one kind and paragraphs run on, headings stand alone."""
    rows = lines.withColumn("line", tx.trim(F.col("text"))).filter("line <> ''")
    best = tx.best_role(tx.line_roles(F.col("line")))
    kind = let(best, lambda b: F.when(b["role"].isin("ol_item", "ul_item"), b["role"]).when((b["role"] == "heading") & (b["score"] >= 0.5), "heading").otherwise("paragraph"))
    w = Window.partitionBy("doc", "page").orderBy("pos")
    rows = rows.withColumn("kind", kind)
    new = (F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(w))
    rows = rows.withColumn("block", F.sum(new.cast("long")).over(w))
    text = F.when(F.col("kind") == "heading", F.regexp_replace("line", ":$", "")).when(F.col("kind") == "paragraph", F.col("line")).otherwise(tx.without_marker(F.col("line")))
    items = F.sort_array(F.collect_list(F.struct("pos", text.alias("x"))))
    by = rows.groupBy("doc", "page", "block", "kind").agg(F.transform(items, lambda i: i["x"]).alias("items"))
    sep = F.when(F.col("kind") == "paragraph", F.array_join("items", " ")).otherwise(F.array_join("items", "\n"))
    return by.select("doc", "page", "block", "kind", F.size("items").cast("long").alias("lines"), sep.alias("t"))


def embedded_lines(item: Column) -> Column:
    """A list item's lines (an array): its head, then what it holds below, by line breaks or else by inner bullets."""
    filled = lambda a: F.filter(F.transform(a, tx.trim), lambda x: x != "")
    bare = lambda x: tx.trim(F.regexp_replace(F.regexp_replace(x, r"^[•▪◦*\-]\s+", ""), r"^[0-9]+[.)]\s+", ""))

    def of(raw: Column) -> Column:
        lines = F.when(raw.contains("\n"), filled(F.split(raw, "\n+"))).otherwise(filled(F.split(raw, "\\s*•\\s*")))
        # Breaks of line count first, inner bullets only where there are none.
        whole = lambda p: F.when(F.size(p) > 1, F.concat(F.array(F.regexp_replace(p[0], r"^[•▪◦]\s+", "")), F.filter(F.transform(F.slice(p, 2, F.size(p)), bare), lambda x: x != ""))).otherwise(F.array(raw))
        return F.when(raw.contains("\n") | raw.contains("•"), let(lines, whole)).otherwise(F.array(raw))

    return let(tx.trim(F.replace(item, F.lit("\r\n"), F.lit("\n"))), of)


def numbered_groups(items: DataFrame) -> DataFrame:
    """Lists (items: doc, pos, text) in which numbered or ``To ...:`` heads stand among plain items, as Markdown: heads numbered anew, the others under them.

    Lists with fewer than two heads, with items before the first, or with
    nothing under any head are none of these and don't come out.
    """
    lines = items.select("doc", "pos", F.posexplode(embedded_lines(F.col("text"))).alias("i", "line")).filter("i > 0 or line <> ''")
    line = F.col("line")
    head = (F.col("i") == 0) & (line.rlike(r"^[0-9]+[.)]\s+\S") | line.rlike(r"(?i)^To\s+\S.+:$"))
    w = Window.partitionBy("doc").orderBy("pos", "i")
    rows = lines.withColumn("head", head).withColumn("group", F.sum(F.col("head").cast("long")).over(w))
    under = tx.trim(F.regexp_replace(line, r"^[-*•]\s+", ""))
    md = F.when(F.col("head"), tx.trim_end(F.concat(F.col("group").cast("string"), F.lit(". "), tx.without_number(line)))).when(under != "", F.concat(F.lit("   - "), under))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(md.isNotNull(), F.struct("pos", "i", md.alias("x"))))), lambda x: x["x"]), "\n")
    by = rows.groupBy("doc").agg(F.min("group").alias("first"), F.max("group").alias("groups"), F.count_if(~F.col("head")).alias("nested"), listed.alias("md"))
    return by.filter("first > 0 and groups > 1 and nested > 0").select("doc", "groups", "md")


def block_proposals(kind: Column, level: Column, text: Column) -> Column:
    """Proposals (role, level, score) for a heading or paragraph: headings gain by their kind and keep their level, paragraphs hold against weak heading cues."""

    def of(fresh: Column) -> Column:
        make = lambda p, lvl, score: F.struct(p["role"].alias("role"), lvl.alias("level"), score.alias("score"))
        head = lambda p: p["role"] == "heading"
        listed = F.exists(fresh, lambda p: p["role"].isin("ol_item", "ul_item"))
        up = F.transform(fresh, lambda p: make(p, F.when(head(p), level.cast("int")).otherwise(p["level"]), F.when(head(p), F.least(F.lit(1.0), p["score"] + 0.25)).otherwise(p["score"])))
        more = F.when(F.exists(fresh, head), up).otherwise(F.concat(up, F.array(F.struct(F.lit("heading").alias("role"), level.cast("int").alias("level"), F.lit(0.7).alias("score")))))
        up = F.transform(more, lambda p: make(p, p["level"], F.when(head(p) & ~listed, F.greatest(p["score"], F.lit(0.8))).otherwise(p["score"])))
        weak = let(tx.best_role(fresh), lambda b: head(b) & (b["score"] < 0.7))
        held = F.transform(fresh, lambda p: make(p, p["level"], F.when(weak & (p["role"] == "paragraph"), F.greatest(p["score"], F.lit(0.75))).otherwise(p["score"])))
        return F.when(kind == "heading", up).otherwise(held)

    return let(tx.line_roles(text), of)


def block_role(kind: Column, level: Column, text: Column) -> Column:
    """The role of a block: lists stay lists; others take their best proposal."""
    best = let(block_proposals(kind, level, text), tx.best_role)
    return F.when(kind == "list", F.lit("ul_item")).when(kind.isin("heading", "paragraph"), best["role"]).otherwise(F.lit("paragraph"))


def rebase_headings(blocks: DataFrame) -> DataFrame:
    """Levels under the path's depth: the page's least level becomes depth + 1; pages without a path keep theirs; at most 6."""
    least = F.min("lvl").over(Window.partitionBy("doc", "page"))
    level = F.least(F.lit(6), F.least(F.lit(6), F.col("depth") + 1) + F.col("lvl") - least)
    return blocks.withColumn("level", F.when(F.col("depth") > 0, level).otherwise(F.col("lvl")).cast("long"))


def apply_hints(blocks: DataFrame, hints: DataFrame) -> DataFrame:
    """Headings take the level that a hint (title, level) gives their title; hints are a small listing."""
    h = hints.select(tx.section_key(F.col("title")).alias("__key"), F.col("level").alias("__level")).dropDuplicates(["__key"])
    rows = blocks.withColumn("__mine", tx.section_key(F.col("t")))
    j = rows.join(h, F.col("__mine") == F.col("__key"), "left")
    return j.withColumn("lvl", F.when(F.col("k") == "heading", F.coalesce("__level", "lvl")).otherwise(F.col("lvl"))).drop("__mine", "__key", "__level")


def titled(markdown: Column, title: Column) -> Column:
    head = F.concat(F.lit("# "), tx.trim(title))
    return F.when(F.coalesce(tx.trim(title) == "", F.lit(True)) | markdown.startswith(head), markdown).otherwise(F.concat(head, F.lit("\n\n"), markdown))


#: Fixed value: what speaks for a photograph of a person.
PHOTO = r"photo|portrait|headshot|profile|avatar|face|person|author|head\b|@[\w.]+"


def looks_like_photo(text: Column, caption: Column) -> Column:
    return F.lower(F.concat_ws(" ", text, F.coalesce(caption, F.lit("")))).rlike(PHOTO)


def photo_width(w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    """The width of a photo's box, at most 0.92 of its height in pixels."""
    target = F.greatest(F.lit(0.0), F.least(F.lit(1.0), h * img_h * 0.92 / img_w))
    tight = F.when(w <= target * 1.02, F.least(w, target)).otherwise(F.greatest(F.lit(0.03), target))
    return F.when((img_w < 8) | (img_h < 8) | (h * img_h < 8), w).otherwise(tight)


def useful_figures(blocks: DataFrame, reviews: DataFrame) -> DataFrame:
    """Blocks without the figures that a review (doc, figure, verdict) calls not useful, and without captions that name them."""
    bad = reviews.filter("verdict = 'not_useful'").select("doc", F.col("figure").alias("__f")).distinct()
    named = F.coalesce("artifact", "id")
    j = blocks.withColumn("__n", F.when(F.col("k").isin("figure", "caption"), F.element_at(F.split(named, "/"), -1)))
    return j.join(bad.withColumnRenamed("doc", "__d"), (F.col("doc") == F.col("__d")) & (F.col("__n") == F.col("__f")), "left_anti").drop("__n")


def override_uncertain(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Roles of uncertain lines (doc, pos, text, role, uncertain) from answers (doc, text, role): an equal text first, then one that contains the other."""
    c = candidates.withColumn("__k", tx.chrome_key(F.col("text")))
    a = answers.select(F.col("doc").alias("__doc"), tx.chrome_key(F.col("text")).alias("__a"), F.col("role").alias("__role"))
    met = c.filter("uncertain").join(a, (F.col("doc") == F.col("__doc")) & (F.length("__a") > 0) & (F.col("__k").contains(F.col("__a")) | F.col("__a").contains(F.col("__k"))))
    best = met.groupBy("doc", "pos").agg(F.min_by("__role", F.struct((F.col("__k") != F.col("__a")).alias("far"), "__a", "__role")).alias("answer"))
    j = candidates.join(best, ["doc", "pos"], "left")
    return j.withColumn("role", F.coalesce("answer", "role")).drop("answer")


def materialise(lines: DataFrame, pages: DataFrame, raw_titles: DataFrame | None = None) -> DataFrame:
    """Blocks (doc, page, seq, k, lvl, ordered, t, items) of lines with roles (doc, page, pos, text, role, level), below the headings that a change of a page's section (pages: doc, page, section) brings.

    A heading that stands on the page anyway isn't brought in. Runs of list
    lines of one role are one list; chrome goes. ``raw_titles`` (doc, key, raw)
    gives numbered titles back where the document keeps its numbers.
    """
    from quarry.operators.pages import path_headings

    w = Window.partitionBy("doc", "page").orderBy("pos")
    kept = lines.filter("role <> 'chrome'")
    listed = F.col("role").isin("ol_item", "ul_item")
    new = ~listed | ~F.col("role").eqNullSafe(F.lag("role").over(w))
    rows = kept.withColumn("new", new).withColumn("block", F.sum(F.col("new").cast("long")).over(w))
    t = tx.trim(F.col("text"))
    # A list line loses its marker, an ordered one the number behind it too.
    bare = tx.without_marker(t)
    line = F.when(F.col("role") == "ol_item", tx.trim(F.regexp_replace(bare, r"^[0-9]{1,3}[.)]\s+", ""))).when(F.col("role") == "ul_item", bare).when(F.col("role") == "heading", tx.trim(F.regexp_replace("text", ":$", ""))).otherwise(t)
    by = rows.groupBy("doc", "page", "block").agg(F.min("pos").alias("pos"), F.first("role").alias("role"), F.first("level").alias("level"), F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("x")))), lambda x: x["x"]).alias("items"))
    is_list = F.col("role").isin("ol_item", "ul_item")
    kind = F.when(is_list, "list").when(F.col("role") == "heading", "heading").otherwise("paragraph")
    none = F.array().cast("array<string>")
    blocks = by.select("doc", "page", F.col("pos").alias("at"), kind.alias("k"), F.when(F.col("role") == "heading", F.coalesce("level", F.lit(2))).cast("long").alias("lvl"), F.when(is_list, F.col("role") == "ol_item").alias("ordered"), F.array_join("items", "\n").alias("t"), F.when(is_list, F.col("items")).otherwise(none).alias("items"))
    heads = kept.filter("role = 'heading'").select("doc", "page", tx.section_key(F.col("text")).alias("key")).distinct()
    brought = path_headings(pages).withColumn("key", tx.section_key(F.col("title"))).join(heads, ["doc", "page", "key"], "left_anti")
    brought = brought.select("doc", "page", (F.col("level") - 100).alias("at"), F.lit("heading").alias("k"), F.col("level").alias("lvl"), F.lit(None).cast("boolean").alias("ordered"), F.col("title").alias("t"), none.alias("items"))
    out = brought.unionByName(blocks)
    if raw_titles is not None:
        raw = raw_titles.filter(F.col("raw").rlike(r"^\s*[0-9]{1,3}[.)]\s")).select(F.col("doc").alias("__d"), F.col("key").alias("__k"), tx.trim(F.col("raw")).alias("__raw"))
        plain = (F.col("k") == "heading") & ~F.col("t").rlike(r"^[0-9]{1,3}[.)]\s")
        out = out.join(raw, plain & (F.col("doc") == F.col("__d")) & (tx.section_key(F.col("t")) == F.col("__k")), "left").withColumn("t", F.coalesce("__raw", "t")).drop("__d", "__k", "__raw")
    return out.withColumn("seq", F.row_number().over(Window.partitionBy("doc", "page").orderBy("at")).cast("long")).drop("at").select("doc", "page", "seq", "k", "lvl", "ordered", "t", "items")


def merge_figures(old: DataFrame, new: DataFrame) -> DataFrame:
    """New figures (doc, page, pos, id, t, caption, z, edge, y) of a page in the places of its old ones, one by one: they keep the old id, and text, caption, zone and edge where the new one has none. Cropped images are made anew. Pages without new figures keep theirs."""
    from quarry.operators.pages import figure_height

    w = Window.partitionBy("doc", "page").orderBy("pos")
    n, o = (df.withColumn("n", F.row_number().over(w)) for df in (new, old))
    was = o.select("doc", "page", "n", *[F.col(c).alias(f"old_{c}") for c in ("id", "t", "caption", "z", "edge")])
    j = n.join(was, ["doc", "page", "n"], "left")
    filled = lambda c: F.when(c != "", c)
    y = figure_height(F.col("y"), F.col("z"))
    z = F.coalesce("z", "old_z", F.when(y > 0.65, "bottom").when(y < 0.35, "top").otherwise("body"))
    merged = j.select("doc", "page", "pos", F.coalesce(filled(F.col("old_id")), "id").alias("id"), F.coalesce(filled(F.col("t")), filled(F.col("old_t")), filled(F.col("caption")), F.lit("Figure")).alias("t"), F.coalesce("caption", "old_caption").alias("caption"), z.alias("z"), F.coalesce("edge", F.when(z == "bottom", "bottom").otherwise(F.col("old_edge"))).alias("edge"), "y")
    kept = old.join(new.select("doc", "page").distinct(), ["doc", "page"], "left_anti").select(*merged.columns)
    return merged.unionByName(kept)


#: Fixed value: words that speak of figures.
FIGURE_WORDS = r"(?i)figure|image|photo|diagram|screenshot|illustration|artwork|crop|bbox|artifact|\bimg\b"


def figure_note(label: Column, tags: Column, comments: Column, recrop: Column) -> Column:
    """What a review says of a figure, as one line; null if it says nothing."""
    parts = F.array_compact(F.array(F.when(F.size(tags) > 0, F.concat(F.lit("tags="), F.array_join(tags, ","))), F.when(F.size(comments) > 0, F.nullif(F.array_join(comments, "; "), F.lit("")))))
    said = F.array_join(parts, " · ")
    return F.when(recrop | (said != ""), tx.trim(F.concat(F.lit("figure "), label, F.lit(": "), said)))


def page_notes(page_comments: Column, figure_notes: Column, document_comments: Column, prompt: Column) -> Column:
    """All notes of a page in order, joined: its comments, its figures', the document's, and the prompt."""
    given = F.when(tx.trim(prompt) != "", F.array(tx.trim(prompt))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(page_comments, figure_notes, document_comments, given), " · ")


#: Heads of list items that are numbered, or prompts (``To ...:``).
NUMBERED, PROMPT = r"^[0-9]+[.)]\s+\S", r"(?i)^To\s+\S.+:$"


def _is_head(line: Column) -> Column:
    t = tx.trim(line)
    return t.rlike(NUMBERED) | t.rlike(PROMPT)


def _unmarked(line: Column) -> Column:
    return F.regexp_replace(line, r"^[-*•]\s+", "")


def _tail(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def is_prompt_list(items: Column) -> Column:
    """Whether a list is one prompt or numbered head with plain items under it."""
    heads = F.transform(items, lambda x: tx.trim(embedded_lines(F.coalesce(x, F.lit("")))[0]))
    prompt = lambda h: _is_head(h[0]) & ~F.exists(_tail(h), lambda x: x.rlike(NUMBERED))
    return F.coalesce(F.when(F.size(items) >= 2, let(heads, prompt)), F.lit(False))


def prompt_markdown(items: Column, number: Column) -> Column:
    """Such a list as Markdown: its head under ``number``, all else below it."""

    def of(parts: Column) -> Column:
        below = F.concat(_tail(parts[0]), F.flatten(F.transform(_tail(parts), lambda p: F.concat(F.array(_unmarked(p[0])), _tail(p)))))
        head = tx.trim_end(F.concat(number.cast("string"), F.lit(". "), tx.without_number(parts[0][0])))
        lines = F.transform(F.filter(F.transform(below, tx.trim), lambda x: x != ""), lambda x: F.concat(F.lit("   - "), x))
        return F.array_join(F.concat(F.array(head), lines), "\n")

    return let(F.transform(items, lambda x: embedded_lines(F.coalesce(x, F.lit("")))), of)


def grouped_markdown(items: Column) -> Column:
    """A list of several heads with items under them as Markdown, heads numbered anew; null for other lists: with items before the first head, fewer than two heads, or nothing under any."""
    start = F.struct(F.lit(0).alias("heads"), F.lit(0).alias("under"), F.lit(False).alias("stray"), F.array().cast("array<string>").alias("lines"))

    def step(acc: Column, item: Column) -> Column:
        def of(p: Column) -> Column:
            blank, head = (p[0] == "") & (F.size(p) == 1), _is_head(p[0])
            under = F.filter(F.concat(F.when(head, F.array().cast("array<string>")).otherwise(F.array(_unmarked(p[0]))), _tail(p)), lambda x: tx.trim(x) != "")
            n = acc["heads"] + head.cast("int")
            first = F.when(head, F.array(tx.trim_end(F.concat(n.cast("string"), F.lit(". "), tx.without_number(p[0]))))).otherwise(F.array().cast("array<string>"))
            lines = F.concat(acc["lines"], first, F.transform(under, lambda x: F.concat(F.lit("   - "), tx.trim(x))))
            more = F.size(p) - head.cast("int")
            return F.when(blank, acc).otherwise(F.struct(n.alias("heads"), (acc["under"] + more).alias("under"), (acc["stray"] | (n == 0)).alias("stray"), lines.alias("lines")))

        return let(embedded_lines(F.coalesce(item, F.lit(""))), of)

    whole = lambda acc: F.when(~acc["stray"] & (acc["heads"] >= 2) & (acc["under"] > 0), F.array_join(acc["lines"], "\n"))
    return F.aggregate(items, start, step, whole)


def list_block_markdown(items: Column, ordered: Column) -> Column:
    """A list block as Markdown: groups of heads, a lone prompt under its own number, or a plain list."""
    own = F.regexp_extract(tx.trim(F.coalesce(F.get(items, F.lit(0)), F.lit(""))), r"^([0-9]+)", 1)
    number = F.coalesce(F.nullif(F.when(own != "", own.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")), F.lit(1).cast("decimal(38,0)"))
    grouped = let(F.struct(grouped_markdown(items).alias("x")), lambda g: F.coalesce(g["x"], F.when(is_prompt_list(items), prompt_markdown(items, number)).otherwise(list_markdown(items, ordered))))
    return F.when(F.size(items) > 0, grouped).otherwise(F.lit(""))


def list_markdown(items: Column, ordered: Column) -> Column:
    """A list's items as Markdown, what an item holds below its first line indented under it; a list most of whose items are numbered is ordered."""
    numbered = F.size(F.filter(items, lambda x: tx.trim(x).rlike(NUMBERED)))
    as_numbers = F.coalesce(ordered, F.lit(False)) | ((F.size(items) >= 2) & (numbered >= F.ceil(F.size(items) * 0.6)))

    def listed(n: Column) -> Column:
        def lines(item: Column, i: Column) -> Column:
            def of(parts: Column) -> Column:
                head = F.when(n, F.concat((i + 1).cast("string"), F.lit(". "), tx.without_number(parts[0]))).otherwise(F.concat(F.lit("- "), _unmarked(parts[0])))
                below = F.transform(_tail(parts), lambda x: F.concat(F.when(n, "   - ").otherwise("  - "), x))
                return F.when((F.size(parts) == 1) & (parts[0] == ""), F.array().cast("array<string>")).otherwise(F.concat(F.array(tx.trim_end(head)), below))

            return let(embedded_lines(item), of)

        return F.array_join(F.flatten(F.transform(items, lines)), "\n")

    return let(as_numbers, listed)


def keep_markdown() -> Column:
    """Markdown of a block (k, t, lvl, tone, ordered, items, headers, rows, caption, artifact, src, display, lang)."""
    from quarry.operators.pages import block_markdown, table_markdown

    t, has = tx.trim(F.col("t")), lambda c: tx.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    alt = tx.trim(F.coalesce("caption", "t"))
    alt = F.when(alt == "", "Figure").otherwise(alt)
    shown = F.when(has("artifact"), F.concat(F.lit("!["), alt, F.lit("]("), tx.trim(F.col("artifact")), F.lit(")"))).otherwise(F.concat(F.lit("*[Missing figure: "), alt, F.lit("]*")))
    below = F.when(has("caption"), tx.trim(F.col("caption"))).when((t != "") & has("artifact"), t)
    figure = F.concat_ws("\n\n", shown, F.concat(F.lit("*"), below, F.lit("*")))
    k = F.col("k")
    return (
        F.when((k == "list") & (F.size("items") > 0), list_markdown(F.col("items"), F.col("ordered")))
        .when((k == "table") & (F.size("headers") > 0) & F.col("rows").isNotNull(), table_markdown(F.col("headers"), F.col("rows")))
        .when(k == "figure", figure)
        .when(k == "mermaid", F.concat(F.lit("```mermaid\n"), tx.trim(F.col("src")), F.lit("\n```")))
        .when((k == "math") & F.coalesce("display", F.lit(False)), F.concat(F.lit("$$\n"), t, F.lit("\n$$")))
        .when(k == "code", F.concat(F.lit("```"), F.coalesce("lang", F.lit("")), F.lit("\n"), tx.trim_end(F.col("t")), F.lit("\n```")))
        .otherwise(block_markdown(k, F.col("t"), F.col("lvl"), F.col("tone")))
    )
