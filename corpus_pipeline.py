"""A training-data pipeline over ``documents``: each stage keeps what the next one reads.

1. language ID: drops documents whose language can't be told (null texts and
   texts without letters) and those that no learned language explains: the
   likelihood of their trigrams is less than half as far above that of
   trigrams by chance as it is for held-out rows of the leading language
   (models and thresholds come from all rows with a language);
2. MinHash near-dedup: keeps one row of each group, that of the least id
   (five-word shingles, similarity 0.8);
3. suffix-array dedup: cuts passages of 50 bytes and more that a document of
   smaller id has too;
4. benchmark decontamination: cuts the spans that contain 10-word windows of
   the benchmark;
5. byte-level BPE: encodes what is left and proves that it decodes to the text.

A document that a stage leaves without a word goes with that stage. Texts are
changed by stages 3 and 4, ``n_chars`` along with them. Stages pass on the
columns of ``documents`` and no others. Documents without an id go last in
stage 2 and keep their texts in stage 3.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, langid, neardup, repeats, tokens
from quarry.llm.common import pick, remove_folder, stage_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Determinised states and pre-tokens that a worker of the last stage keeps: after four other stages the heaps of executors are full.
STATES, WORDS = 120_000, 100_000
#: Proportion of the leading language under which a document is rejected.
LEAST_SHARE = 0.3


def _with_text(df: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """The columns of ``documents`` with ``text`` for the text; rows without anything but white space go."""
    out = df.filter(F.length(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")) > 0)
    return out.select(*[F.col(text).alias("text") if c == "text" else F.length(text).cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in kept])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = pick(docs, COLUMNS)
    held_out = F.pmod(F.xxhash64(F.lit("held out"), "doc_id", "text"), F.lit(5)) == 0
    model = langid.fit(docs, ~held_out, sample_per_language=None)
    if not model[0]:  # nothing was learned: only texts without letters go
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    least = langid.least_gains(docs, held_out, model)
    found = langid.predict(docs, model, keep=docs.columns, gains=True)
    fits = F.col("gain") >= F.element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("lang_pred"))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE) & fits).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = pick(docs, COLUMNS)
    return neardup.keep_first(docs, one_row=True)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = pick(docs, COLUMNS)
    left = repeats.remove_repeats(docs, keep=[c for c in docs.columns if c != "text"], as_text=True)
    return _with_text(left, "kept", docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = pick(docs, COLUMNS)
    left = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=[c for c in docs.columns if c != "text"])
    return _with_text(left, "cleaned", docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = pick(docs, COLUMNS)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = tokens.round_trip(docs, path, public_tokenizers.PATTERN, keep=docs.columns, states=STATES, words=WORDS)
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("bpe", encoded),
]
#: Language ID and BPE can't be said in SQL: tests/llm/test_pipeline.py holds the stages and the whole run against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for ``documents``; each stage is written to the shared folder and read again.

    A stage's folder goes when the next stage is written; the last one's stays,
    for the result reads it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = stage_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_folder(spark, before)
        before = path
    return docs
