"""Text functions as column expressions: transforms, cleaning, tokens, page assessment, titles, line roles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.binding import let

#: Fixed value: the characters that count as white space, as a regular-expression class.
WHITE = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"
#: The white space of pages' texts, without brackets: no control characters above U+000D, but the byte-order mark.
_S = r"\t\n\x0B\f\r \xA0  -     　﻿"
#: Fixed value: private-use characters.
PRIVATE = r"[-\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{WHITE}+", ""), f"{WHITE}+$", "")


#: The same characters one by one, and as a class that tells printable ASCII apart at once.
_TRIMMED = "".join(chr(n) for n in range(0x3001) if re.match(f"[{_S}]", chr(n))) + "\ufeff"
_WHITE = rf"[[^!-~]&&[{_S}]]"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_TRIMMED))


def trim_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(_TRIMMED))


def trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(_TRIMMED))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{_WHITE}+"), lambda w: w != "")


def token_text(c: Column) -> Column:
    """Lower-case words of letters a-z and digits, without fenced blocks, a blank apart."""
    low = F.lower(c)
    plain = F.when(low.contains("```"), F.regexp_replace(low, r"(?s)```.*?```", " ")).otherwise(low)
    return F.regexp_replace(plain, "[^a-z0-9]+", " ")


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(token_text(c), " "), "")


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def clean_page(c: Column) -> Column:
    """One kind of line end, words joined over hyphens, no icons, no trailing blanks, at most one empty line."""
    s = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    s = F.regexp_replace(s, r"([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2")
    s = F.regexp_replace(s, PRIVATE, "")
    s = F.array_join(F.transform(F.split(s, "\n"), trim_end), "\n")
    return trim(F.regexp_replace(s, r"\n{3,}", "\n\n"))


#: Words in -in that are whole, and ends of words that were cut.
WHOLE_IN = "within again begin domain certain mountain captain curtain protein margin origin cabin latin cousin raisin vitamin admin login violin penguin dolphin pumpkin".split()
CUT_ENDS = "tio sio cio atio mirrorin progres frictio investmen onboardin activatio retentio engagemen monetisatio optimisatio refinemen buildin shapin formatio feedbac alignmen personalisatio disclosur referra experienc curiosit commitmen bridg paywal shareabilit meaningfull inten".split()


def _is_cut(word: Column) -> Column:
    """Whether a word looks cut off: one of the known ends, or a consonant before a last ``in`` that isn't a whole word's."""
    by_size: dict[int, list[str]] = {}
    for end in CUT_ENDS:
        by_size.setdefault(len(end), []).append(end)

    def of(low: Column) -> Column:
        known = F.lit(False)
        for size, ends in by_size.items():
            known = known | F.right(low, F.lit(size)).isin(ends)
        ing = (F.length(low) >= 6) & low.endswith("in") & low.rlike("[b-df-hj-np-tv-z]in$") & ~low.isin(WHOLE_IN)
        return (F.length(low) >= 5) & (ing | known)

    return let(F.regexp_replace(F.lower(word), "['-]", ""), of)


def assess_page(c: Column) -> Column:
    """Why a page's extracted text can't be used (an empty array: it can)."""
    lines = F.filter(F.split(c, "\n"), lambda x: trim(x) != "")
    flat = trim(F.regexp_replace(c, f"{_WHITE}+", " "))
    alpha = F.regexp_extract_all(c, F.lit("[A-Za-z][A-Za-z'-]{2,}"), F.lit(0))
    printable = count(c, r"[\x20-\x7E\n\r\t\xA0-ɏ]")

    def of_words(flat_: Column) -> Column:
        return let(words(flat_), lambda w: F.struct(F.length(flat_).alias("chars"), F.size(w).alias("words"), F.size(F.filter(w, lambda x: F.length(x) == 1)).alias("single")))

    def of_lines(a: Column) -> Column:
        return F.struct(F.size(a).alias("lines"), F.size(F.filter(a, lambda x: x.rlike(rf"[^{_S}].{{0,48}}[{_S}]{{3,}}[^{_S}]"))).alias("columns"))

    def of_letters(a: Column) -> Column:
        return F.struct(F.size(a).alias("n"), F.when(F.size(a) >= 12, F.size(F.filter(a, _is_cut))).otherwise(F.lit(0)).alias("cut"))

    def reasons(m: Column) -> Column:
        w, k, a = m["w"], m["k"], m["a"]
        given = [
            (w["chars"] < 40, "too_short"),
            (w["words"] < 8, "too_few_words"),
            ((F.length(c) > 0) & (m["printable"] < 0.55 * F.length(c)), "low_printable_ratio"),
            ((w["words"] >= 5) & (w["single"] > 0.45 * w["words"]), "fragmented"),
            ((k["lines"] >= 4) & (k["columns"] >= 0.22 * k["lines"]), "columnar_layout"),
            ((a["n"] >= 12) & (a["cut"] >= 0.06 * a["n"]), "truncated_words"),
            (count(c, PRIVATE) >= 2, "private_use_glyphs"),
        ]
        return F.array_compact(F.array(*[F.when(when, F.lit(why)) for when, why in given]))

    return let(F.struct(let(flat, of_words).alias("w"), let(lines, of_lines).alias("k"), let(alpha, of_letters).alias("a"), printable.alias("printable")), reasons)


def chrome_key(c: Column) -> Column:
    """Text of page furniture for comparison: lower case, single blanks, letters, digits and ``./-`` only."""
    return trim(F.regexp_replace(F.regexp_replace(F.lower(c), f"{_WHITE}+", " "), rf"[^\p{{L}}\p{{N}}{_S}./-]+", ""))


def without_number(c: Column) -> Column:
    return trim(F.regexp_replace(c, rf"^[0-9]{{1,3}}[.)][{_S}]+", ""))


def section_key(c: Column) -> Column:
    return chrome_key(without_number(c))


def breadcrumb(c: Column) -> Column:
    """Segments of ``a > b > c``, without numbers; no segments where there is no ``>``."""
    t = trim(c)
    parts = F.filter(F.transform(F.split(t, f"[{_S}]*>[{_S}]*"), lambda x: without_number(trim(x))), lambda x: x != "")
    return F.when(t.contains(">"), parts).otherwise(F.array().cast("array<string>"))


#: Labels of repeated sections.
SECTION_LABELS = ["what it is", "why it works", "when to use it", "make it yours", "pair with", "behind the data", "how it works", "examples?", "notes?", "do", "don'?t", "founder tip", "supporting plays", r"insights\s*&\s*metrics"]


#: Labels that share one heading level, labels of large sections, and the names of both slots.
PEER_LABELS = ["what it is", "why it works", "when to use it", "do", "don'?t", "founder tip"]
BLOCK_LABELS = ["make it yours", "pair with", "behind the data", "supporting plays", r"insights\s*&\s*metrics"]
PEER_SLOT, BLOCK_SLOT = "peer:card-slots", "block:make-section"


def slot_key(c: Column) -> Column:
    """The slot of a repeated section's label; other titles are their own."""
    one_of = lambda t, labels: t.rlike(f"(?i)^({'|'.join(labels)})[:.]?$")
    slot = lambda t: F.when(one_of(t, PEER_LABELS), PEER_SLOT).when(one_of(t, BLOCK_LABELS), BLOCK_SLOT).otherwise(chrome_key(t))
    return let(trim(F.regexp_replace(F.regexp_replace(c, r"[‘’ʼ]", "'"), ":$", "")), slot)


def _label(c: Column) -> Column:
    return c.rlike(f"(?i)^({'|'.join(SECTION_LABELS)})[:.]?$")


def is_section_label(c: Column) -> Column:
    return _label(trim(F.regexp_replace(F.regexp_replace(c, r"[‘’ʼ]", "'"), ":$", "")))


def page_number_like(c: Column) -> Column:
    return trim(c).rlike(rf"(?i)^(#{{1,6}}[{_S}]*)?(page[{_S}]*[0-9]+([{_S}]*(of|/)[{_S}]*[0-9]+)?|[0-9]+[{_S}]*/[{_S}]*[0-9]+|[0-9]{{1,4}})$")


def validate_markdown(c: Column) -> Column:
    """Why a page's Markdown is refused (an empty array: it isn't)."""
    t = trim(c)
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: trim(x)), lambda x: x != "")
    chrome = F.forall(lines, lambda x: x.rlike(rf"(?i)^(#{{1,6}}[{_S}]*)?(page[{_S}]*[0-9]+([{_S}]*(of|/)[{_S}]*[0-9]+)?|[0-9]+[{_S}]*/[{_S}]*[0-9]+|-+)$"))
    more = F.array_compact(F.array(F.when(F.length(t) < 24, F.lit("too_short")), F.when(count(t, "```") % 2 != 0, F.lit("unbalanced_fences")), F.when(chrome, F.lit("chrome_only"))))
    return F.when(t == "", F.array(F.lit("empty"))).otherwise(more)


def structure_score(c: Column) -> Column:
    """Half or whole marks for a top heading and, if there are diagrams, a diagram keyword in each."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?s)```mermaid\n(.*?)```"), F.lit(1))
    kinds = r"\b(graph|flowchart|sequenceDiagram|classDiagram|stateDiagram|erDiagram|journey|gantt|pie|mindmap)\b"
    head = F.when(c.rlike(rf"(?m)^#[{_S}]+"), 1).otherwise(0)
    valid = F.when(F.forall(blocks, lambda b: b.rlike(kinds)), 1).otherwise(0)
    return F.when(F.size(blocks) > 0, (head + valid) / F.lit(2.0)).otherwise(head.cast("double"))


MARK, LETTER, NUMBER, PAREN = rf"^[-*\u2022][{_S}]+(.+)$", rf"(?i)^([a-z])[.)][{_S}]+(.+)$", rf"^([0-9]{{1,3}})[.)][{_S}]+(.+)$", rf"(?i)^\(([0-9]{{1,3}}|[a-z])\)[{_S}]+(.+)$"


#: Any of the four; they differ in their first characters.
MARKER = rf"^(?:[-*\u2022]|[A-Za-z][.)]|[0-9]{{1,3}}[.)]|\((?:[0-9]{{1,3}}|[A-Za-z])\))[{_S}]+(.+)$"


def without_marker(t: Column) -> Column:
    bare = lambda x: let(F.regexp_extract(x, MARKER, 1), lambda body: F.when(body != "", trim(body)).otherwise(x))
    return let(t, bare)


def title_share(t: Column) -> Column:
    """The share of words that begin with a capital or a digit."""
    return let(words(t), lambda w: F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: x.rlike(r"^[\p{Lu}0-9]"))) / F.size(w)).otherwise(F.lit(0.0)))


def line_roles(c: Column) -> Column:
    """Proposals (role, level, score) for a line, best cue first."""

    def p(role: str, score: float | Column, level: int | None = None) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(level).cast("int").alias("level"), (score if isinstance(score, Column) else F.lit(score)).cast("double").alias("score"))

    maybe = lambda when, x: F.when(when, F.array(x)).otherwise(F.array().cast("array<struct<role:string,level:int,score:double>>"))

    def of(t: Column) -> Column:
        def letter(body: Column) -> Column:
            short = maybe(F.when(F.length(body) <= 60, title_share(body) >= 0.5).otherwise(F.lit(False)), p("heading", 0.35, 3))
            return F.concat(F.array(p("ol_item", F.when(F.length(body) <= 80, 0.92).otherwise(0.55))), short, F.array(p("paragraph", 0.15)))

        def number(body: Column) -> Column:
            short = maybe(F.when(F.length(body) <= 50, title_share(body) >= 0.6).otherwise(F.lit(False)), p("heading", 0.45, 2))
            return F.concat(F.array(p("ol_item", 0.75)), short, F.array(p("paragraph", 0.2)))

        def plain(n: Column) -> Column:
            titled = lambda share: F.when(share >= 0.6, F.array(p("heading", 0.55 + share * 0.2, 2), p("paragraph", 0.35))).otherwise(F.array(p("paragraph", 0.6), p("heading", 0.25, 2)))
            brief = (F.length(t) >= 2) & (F.length(t) <= 90) & (n <= 8)
            return F.when(n >= 12, F.array(p("paragraph", 0.8), p("heading", 0.15, 2))).when(brief, let(title_share(t), titled)).otherwise(F.array(p("paragraph", 0.6), p("heading", 0.25, 2)))

        return (
            F.when(t == "", F.array(p("paragraph", 0.1)))
            .when(t.rlike(MARK), F.array(p("ul_item", 0.95), p("paragraph", 0.1)))
            .when(t.rlike(LETTER) | t.rlike(PAREN), let(without_marker(t), letter))
            .when(t.rlike(NUMBER), F.when(F.length(t) > 90, F.array(p("paragraph", 0.7), p("ol_item", 0.35))).otherwise(let(without_marker(t), number)))
            .when(_label(F.regexp_replace(t, ":$", "")), F.array(p("heading", 0.9, 3), p("paragraph", 0.1)))
            .when((F.length(t) > 48) & t.rlike(rf"\.[{_S}]*$"), F.array(p("paragraph", 0.85), p("heading", 0.1, 2)))
            .otherwise(let(F.size(F.split(t, f"{_WHITE}+")), plain))
        )

    return let(trim(c), of)


def best_role(proposals: Column) -> Column:
    """The proposal of highest score, the first of equals."""
    best = lambda p: F.aggregate(p, p[0], lambda acc, x: F.when(x["score"] > acc["score"], x).otherwise(acc))
    return let(proposals, best)


def uncertain(proposals: Column) -> Column:
    """Whether the best role hardly leads the next one, which is another, or hardly convinces."""
    order = F.array_sort(F.transform(proposals, lambda x, i: F.struct((-x["score"]).alias("s"), i.alias("i"), x["role"].alias("role"))))
    best, second = order[0], F.get(order, F.lit(1))
    close = F.coalesce((second["s"] - best["s"] < 0.12) & (second["role"] != best["role"]), F.lit(False))
    return close | (-best["s"] < 0.5)


def html_escape(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def page_file(n: Column) -> Column:
    return F.concat(F.lit("page-"), F.when(F.length(n.cast("string")) < 3, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")), F.lit(".md"))


def without_fence(c: Column) -> Column:
    """The text inside a fence that holds the whole document."""
    t = trim(c)
    end = F.regexp_replace(t, r"\n?```$", "")
    return trim(F.when(t.startswith("```markdown"), F.regexp_replace(end, r"^```markdown\n?", "")).when(t.startswith("```") & t.endswith("```"), F.regexp_replace(end, r"^```\n?", "")).otherwise(t))


#: Fixed value: what messages of a rate limit hold.
RATE_LIMIT = r"(?i)429|rate.?limit|too many requests|quota|resource.?exhausted|throttl"


def rate_limited(status: Column, message: Column) -> Column:
    return F.coalesce(status == 429, F.lit(False)) | F.coalesce(message.rlike(RATE_LIMIT), F.lit(False))


def prompt_heading(c: Column) -> Column:
    t = trim(c)
    return t.rlike(rf"(?i)^[0-9]+[.)][{_S}]+To[{_S}]+") | (t.rlike(rf"^[0-9]+[.)][{_S}]+.{{10,}}") & t.endswith(":"))


def backoff_ms(attempt: Column, base: int, most: int) -> Column:
    """The part of an exponential pause that isn't random."""
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt - 1)).cast("long")
