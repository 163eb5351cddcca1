"""Quality rules: base measures of a text, and lines too common across documents.

``base_measures`` works within a row. ``judge_lines`` hashes the normalised
lines of every document (lower case, runs of white space as one space), counts
the distinct documents of each host that hold a line, and calls a line common
if more than ``min_docs`` documents and more than ``max_fraction`` of the
host's documents hold it: a share, so that the rule reads alike at every size,
and a small one, so that boilerplate counts in a very large host too. Common
lines are removed (``remove_common_lines``), and documents depleted below
``min_kept`` of their words are rejected. All of it is DataFrame functions.

A document counts once for a line, however many rows it has; which documents
hold a line is settled by line and document, then counts combine before the
shuffle, so a very common line is one row a task. The counted lines and the
documents' lines meet in an ordinary join, which splits a skewed key. Null
texts have no lines and no words; a null host is a host of its own; rows
without a key are documents by their texts; rows that repeat whole are judged
alike. A text is one value in memory, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import pick
from quarry.operators.graph import checkpointed

#: A line is common in a host if more than so many documents hold it, and more than this share of the host's; a document keeps at least this share of its words.
MIN_DOCS, MAX_FRACTION, MIN_KEPT = 20, 0.01, 0.3
SPACE = " \t\n\x0b\f\r"
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def _let(value: Column | str, fn) -> Column:
    """``fn`` of a value that the plan states once: else each step below would double the expression if the optimiser inlines it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _next(array: Column, n: int = 1) -> Column:
    """The array from its element ``n`` places on."""
    return F.slice(array, n + 1, F.greatest(F.size(array) - n, F.lit(0)))


def _doubled(n: int):
    """Hashes of windows twice as wide as those of ``n`` words in a column."""
    return lambda h: F.slice(F.zip_with(h, _next(h, n), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(h) - n, F.lit(0)))


def _window_hashes(df: DataFrame, seed: str, out: str) -> DataFrame:
    """Hashes of all windows of 8 words, by doubling: words, then windows of 2, 4 and 8."""
    df = df.withColumn(out, F.transform("w", lambda x: F.xxhash64(F.lit(seed), x)))
    for n in (1, 2, 4):
        df = df.withColumn(out, _let(out, _doubled(n)))
    return df


def base_measures(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text column.

    n_repeat_words: words in windows of 8 words that occur twice or more in the
    text. One hash finds the texts with a repeat; only there are windows sorted
    and compared, by two 64-bit hashes of their words.
    """
    names = df.columns
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("w", F.filter(F.split(F.translate(t, SPACE[1:], "     "), " "), lambda x: x != ""))
    df = df.withColumn("lines", F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != ""))
    df = df.withColumns({
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    })
    df = _window_hashes(df, "a", "h")
    df = df.withColumn("w", F.when(_let("h", lambda h: F.size(F.array_distinct(h)) < F.size(h)), F.col("w")).otherwise(F.array().cast("array<string>")))
    df = _window_hashes(df, "b", "g")
    df = df.withColumn("z", F.array_sort(F.when(F.size("g") > 0, F.transform(F.arrays_zip("h", "g"), lambda x, i: F.struct(x["h"].alias("h"), x["g"].alias("g"), i.alias("i"))))))
    twice = _let("z", lambda z: F.zip_with(z, _next(z), lambda a, b: F.when((a["h"] == b["h"]) & (a["g"] == b["g"]), F.array(a["i"], b["i"]))))
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, i: F.struct((i + 8).alias("end"), (acc["n"] + 8 - F.greatest(F.lit(0), acc["end"] - i)).alias("n")), lambda acc: acc["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _lined(df: DataFrame, key: str, text: str, host: str, carry: list[str]) -> DataFrame:
    """One pass over the texts: u (a number of the row), k, s, doc, the measures, and the normalised lines' places, hashes and numbers of words; cut off by a checkpoint, so that numbers hold and texts are read once."""
    names = [f"c{i}" for i in range(len(carry))]
    keyed = pick(df, [key, text, host, *carry]).toDF("k", "t", "s", *names)
    # Rows without a key are told apart by their texts.
    keyed = keyed.withColumn("doc", F.struct("k", F.when(F.col("k").isNull(), F.xxhash64("t")).alias("h")))
    even = F.regexp_replace(F.lower(F.translate(F.coalesce("t", F.lit("")), "\t\x0b\f\r", "    ")), "  +", " ")
    clean = F.transform(F.split(even, "\n"), lambda x, i: F.struct(F.trim(x).alias("x"), i.alias("i")))
    counted = F.transform(F.filter(clean, lambda x: x["x"] != ""), lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["x"]).alias("h"), (F.length(x["x"]) - F.length(F.translate(x["x"], " ", "")) + 1).alias("n")))
    made = base_measures(keyed.withColumn("lines_", counted), "t").drop("t")
    parts = max(keyed.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
    return checkpointed(made.withColumn("u", F.monotonically_increasing_id()).withColumnRenamed("lines_", "lines"), parts)


def _lost(lined: DataFrame, min_docs: int, max_fraction: float) -> DataFrame:
    """u, lost (words in common lines) and gone (places of the common lines) of the rows that have any."""
    once = lined.select("s", "doc", F.explode(F.array_distinct(F.col("lines.h"))).alias("h")).distinct()
    holders = once.groupBy("s", "h").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > min_docs)
    hosts = lined.select(F.col("s").alias("o"), "doc").distinct().groupBy("o").agg(F.count(F.lit(1)).alias("all_docs"))
    common = holders.join(hosts, F.col("s").eqNullSafe(F.col("o"))).filter(F.col("docs") > F.col("all_docs") * max_fraction).select(F.col("s").alias("cs"), F.col("h").alias("ch"))
    every = lined.select("u", "s", F.explode("lines").alias("x")).select("u", "s", F.col("x.i").alias("i"), F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    found = every.join(common, F.col("s").eqNullSafe(F.col("cs")) & (F.col("h") == F.col("ch")), "left_semi")
    return found.groupBy(F.col("u").alias("gu")).agg(F.sum("n").alias("lost"), F.collect_list("i").alias("gone"))


def _judged(lined: DataFrame, min_docs: int, max_fraction: float, min_kept: float) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    lost = F.coalesce("lost", F.lit(0)).cast("long")
    kept = ~failed & (F.col("n_words") - lost >= min_kept * F.col("n_words"))
    found = lined.drop("lines").join(_lost(lined, min_docs, max_fraction), F.col("u") == F.col("gu"), "left")
    return found.withColumns({"base_failed": failed, "kept": kept, "common_words": lost})


def judge_lines(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_fraction: float = MAX_FRACTION, min_kept: float = MIN_KEPT) -> DataFrame:
    """key, the base measures, base_failed, kept, and common_words (words in common lines).

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows.
    kept: not base_failed, and at least ``min_kept`` of the words remain.
    """
    judged = _judged(_lined(df, key, text, host, []), min_docs, max_fraction, min_kept)
    return judged.select(F.col("k").alias(key), *MEASURES, "base_failed", "kept", "common_words")


def remove_common_lines(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_fraction: float = MAX_FRACTION, min_kept: float = MIN_KEPT) -> DataFrame:
    """The rows of ``df`` that are kept, their texts without the common lines."""
    lined = _lined(df, key, text, host, df.columns)
    left = F.filter(F.split("t_", "\n"), lambda x, i: ~F.array_contains("gone", i))
    names = [f"c{i}" for i in range(len(df.columns))]
    at = names[df.columns.index(text)]
    rows = _judged(lined, min_docs, max_fraction, min_kept).filter("kept").withColumn("t_", F.col(at))
    return rows.withColumn(at, F.when(F.col("gone").isNull(), F.col("t_")).otherwise(F.array_join(left, "\n"))).select(*names).toDF(*df.columns)
