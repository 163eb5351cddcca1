"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontaminate, langid, neardup, quality, repeats, rules, sharding, tokens, urls

LONG = "several ordinary words make a sentence here and there " * 4000
ROWS = [(None, "no id at all here"), (None, None), (1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "same row twice " * 10), (5, "same row twice " * 10), (6, "same row twice " * 10), (7, "nul \0 and \U0001f600 中文 ñ <|endoftext|>"), (-1, "minus one"), (8, "x" * 70_000)]
EXTRA = {"k": "'k'", "t": "1", "d": "2.0D", "s": "cast(null as string)", "DOC_ID": "'clash'", "Text": "'clash'", "a.b": "'dot'", "score": "'old'", "n_words": "'old'", "m": "3"}
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module", params=["odd", "empty"])
def docs(request, spark):
    base = spark.createDataFrame(ROWS if request.param == "odd" else [], "doc_id long, text string")
    base = base.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.when(F.col("doc_id") % 2 == 0, "src").alias("source"), F.length("text").cast("long").alias("n_chars"))
    names = [*base.columns, *EXTRA]
    return base.select("*", *[F.expr(v).alias(f"x{i}") for i, v in enumerate(EXTRA.values())]).toDF(*names)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("b1", "same row twice same row twice same row twice same"), ("b2", None), (None, "nul and"), ("b3", ""), ("b4", "ordinary")], "item_id string, text string")


def key(docs):
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select("c0")


@pytest.mark.parametrize("name", ["encode", "both", "count", "decontaminate", "blocks", "shard", "quality", "repeats", "language", "rules", "neardup", "first", "urls"])
def test_rows_are_kept(spark, docs, benchmark, name):
    none = F.lit(False)
    made = {
        "encode": lambda: tokens.decode(tokens.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS),
        "both": lambda: tokens.round_trip(docs, RANKS, public_tokenizers.PATTERN),
        "count": lambda: tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN),
        "decontaminate": lambda: decontaminate.decontaminate(docs, benchmark),
        "blocks": lambda: decontaminate.decontaminate(docs, benchmark, block_bytes=1),
        "shard": lambda: sharding.shard(docs),
        "quality": lambda: quality.score(docs, None),
        "repeats": lambda: repeats.remove_repeats(docs),
        "language": lambda: langid.predict(docs, langid.fit(docs, none)),
        "rules": lambda: rules.judge_lines(docs),
        "neardup": lambda: neardup.near_duplicates(docs),
        "first": lambda: neardup.keep_first(docs),
        "urls": lambda: urls.judge(docs, url="text"),
    }[name]()
    rows = made.toDF(*[f"c{i}" for i in range(len(made.columns))]).collect()
    n = key(docs).count()
    assert len(rows) == (n if name != "first" else n and 11)  # of 5, 5 and 6 the first id stays, twice


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, docs, tmp_path, benchmark, stage):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage[1](spark, docs, str(tmp_path))
    out.collect()
    if stage is not corpus_pipeline.STAGES[-1]:
        assert out.columns == corpus_pipeline.COLUMNS


def test_one_row_of_each_group(spark):
    """Rows are judged by id and text: an id's clean text stays beside its near copy, and whole repeats and null ids leave one row."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c), (3, c), (None, d), (None, d), (None, a), (4, ""), (4, "")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, a), (2, b), (3, c), (None, d), (4, ""), (4, "")], key=str)
    assert neardup.keep_first(df).count() == 9  # here rows that repeat whole stay


def test_neardup_ids(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert got[(6, 3)] == 5 and got[(2, 0)] == 2 and got[(1, 0)] == 1 and got[(4, 9)] == 4


def test_benchmark_blocks_agree(spark, benchmark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").filter("doc_id is not null").dropDuplicates(["doc_id"])
    one, many = ({r["doc_id"]: (r["n_words"], r["spans"], r["items"], r["cleaned"]) for r in decontaminate.decontaminate(df, benchmark, block_bytes=b).collect()} for b in (1, 1 << 20))
    assert one == many
    assert one[5][2] == ["b1"] and one[7][2] == [""]


def pairs(df, *columns):
    """The values of the first column and of ``columns`` (by place), as sorted text."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at = [0, *(df.columns.index(c) for c in columns)]
    return sorted(str(tuple(r)) for r in df.toDF(*names).select(*[names[i] for i in at]).collect())


def test_values_on_odd_input(spark):
    """What null ids and texts, empty and long texts and repeated rows come to, beside columns with clashing names."""
    import zlib

    from tokenizers import Tokenizer

    base = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    docs = base.select("*", *[F.expr(v).alias(f"x{i}") for i, v in enumerate(EXTRA.values())]).toDF(*base.columns, *EXTRA)
    texts = [(k, t or "") for k, t in ROWS]
    want = lambda fn: sorted(str((k, *fn(t))) for k, t in texts)
    both = tokens.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    assert pairs(both, "decoded") == want(lambda t: (t,))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counted = tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert pairs(counted, "n_tokens") == want(lambda t: (len(lib.encode(t, add_special_tokens=False).ids),))
    dealt = sharding.shard(docs)
    assert pairs(dealt, "size", "text_crc32") == want(lambda t: (len(t.encode()) + 8, zlib.crc32(t.encode())))
    assert pairs(urls.judge(docs, url="text", keep=["doc_id"]), "host", "path", "rule", "verdict") == want(lambda t: ("", "", None, "allow"))
    measured = rules.judge_lines(docs)
    assert pairs(measured, "n_words", "n_dup_lines") == want(lambda t: (len(t.split()), 0))
    assert pairs(quality.score(docs, None), "score") == want(lambda t: (0.5,))
    assert pairs(langid.predict(docs, ([], None)), "lang_pred", "score") == want(lambda t: ("und", 0.0))
    # Of the equal texts 5, 5, 6 only 6 goes; the long text repeats itself, which alone removes nothing.
    left = repeats.remove_repeats(docs)
    assert pairs(left, "n_removed") == sorted(str((k, len(t) if k == 6 else 0)) for k, t in texts)


def test_models_from_odd_labels(spark):
    """Null ids, null and foreign labels, two labels for one id, labels without a document and clashing columns teach what clean labels teach."""
    good, bad = "A plain sentence stands here.\nAnd another one, quite calm.", "!!! $$$ ### ||||\n@@@ 0000 %%%%"
    rows = [(i, (good if i % 2 else bad) + f"\nline {i}") for i in range(20)]
    docs = spark.createDataFrame([*rows, rows[3], (None, good), (50, None)], "doc_id long, text string").select("*", F.lit("clash").alias("x")).toDF("doc_id", "text", "TEXT")
    clean = spark.createDataFrame([(i, i % 2) for i in range(18)], "doc_id long, quality int")
    labels = spark.createDataFrame([*[(i, i % 2) for i in range(18)], (4, 1), (None, 1), (18, None), (19, 7), (99, 1)], "doc_id long, quality int")
    odd = labels.select("*", F.lit(0).alias("x"), F.lit(1).alias("k")).toDF("doc_id", "quality", "Quality", "k")
    everything = F.lit(True)
    one, two = quality.fit(docs, clean, everything), quality.fit(docs, odd, everything)
    assert all(abs(a - b).max() < 1e-6 for a, b in zip(one[:2], two[:2], strict=True)) and abs(one[2] - two[2]) < 1e-6
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, two, keep=["doc_id"]).collect()}
    assert scores[19] > 0.5 > scores[18] and 0 <= scores[50] <= 1
    assert quality.fit(docs, labels.filter("quality = 1"), everything) is None and quality.fit(docs, odd.filter("doc_id < 0"), everything) is None
    assert quality.fit(docs, clean, everything, max_lines=3) is None  # one document of three lines has labels of one kind


def test_benchmark_with_odd_columns(spark, benchmark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    plain = decontaminate.decontaminate(df, benchmark, keep=["doc_id"])
    twice = benchmark.unionByName(benchmark)
    clashing = twice.select(F.lit("x").alias("a"), "text", F.lit("y").alias("b"), "item_id", F.lit(1).alias("c")).toDF("ITEM_ID", "text", "Text", "item_id", "a.b")
    assert pairs(decontaminate.decontaminate(df, clashing, keep=["doc_id"]), "n_words", "spans", "items", "cleaned") == pairs(plain, "n_words", "spans", "items", "cleaned")
    none = decontaminate.decontaminate(df, benchmark.limit(0), keep=["doc_id"])
    assert none.filter("size(spans) > 0").isEmpty() and none.count() == len(ROWS)
