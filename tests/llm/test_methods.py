"""Operators that SQL can't express, against the public libraries, brute force, exact round trips and held-out rows."""

import base64
import bisect
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, langid, neardup, quality, queries, repeats, rules, sharding, tokens, urls

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
ODD = ["", " ", "a", "\n\n\n", "don't  stop\t\tnow", "<|endoftext|>x<|endoftext|>", "中文字符測試", "\U0001f600\U0001f601", "é" * 300, "a" * 5000, "ab" * 3000, "x\x00y", "0123456789" * 50, "    indented\n\tcode {}"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]


def test_encoding_equals_the_library(encoder, library, texts):
    for t in [*ODD, *texts]:
        assert encoder.encode(t) == library.encode_ordinary(t)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_of_any_text(encoder, library, t):
    assert encoder.encode(t) == library.encode_ordinary(t)


@pytest.mark.parametrize("most", [2, 3, 50])
def test_determinised_states_stay_bounded(monkeypatch, library, most):
    monkeypatch.setattr(bpe, "MAX_STATES", most)
    small = bpe.Transducer(RANKS)
    for t in ["internationalization", "antidisestablishmentarianism", "zzzzqqqq" * 9, "q", "é" * 20]:
        assert list(small.encode(t.encode())) == library.encode_ordinary(t)
        assert len(small.states) <= max(most, 2)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40), st.integers(1, 7))
def test_streaming_decode(library, t, chunk):
    table = [b""] * (max(RANKS.values()) + 1)
    for b, r in RANKS.items():
        table[r] = b
    ids = library.encode_ordinary(t)
    assert "".join(bpe.StreamDecoder(table).pieces(ids, chunk)) == t
    broken = ids[1:]
    assert "".join(bpe.StreamDecoder(table).pieces(broken, chunk)) == library.decode_bytes(broken).decode("utf-8", "replace")


def test_encoding_query(spark, library):
    """Every row of op1 against the library."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op1_bpe(spark, DATA).collect()
    assert len(rows) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(docs[r["doc_id"]]))


def test_counting_query(spark):
    """Every row of op6 against the library."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op6_token_counts(spark, DATA).collect():
        n = len(lib.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(docs[r["doc_id"]].encode()), n > 512)


def test_tokens_leave_early():
    """A long pre-token's first tokens are emitted after a few bytes, long before its end."""
    machine = bpe.Transducer(RANKS)
    state, first = 0, None
    for at, byte in enumerate(b"internationalization" * 40):
        state, out = machine.step(state, byte)
        state = ~state if out else state
        if out and first is None:
            first = at
    assert first is not None and first < 64
    assert all(len(out) < 64 for _, _, outs in machine.states for out in outs)


def test_counts_equal_the_library(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    counter = tokens.Counter(tokens.Merges(open(path, "rb").read()), public_tokenizers.PATTERN)
    for t in [*ODD, *texts]:
        assert counter.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t[:40]


def test_sharding_laws(spark):
    rows = queries.op3_sharding(spark, DATA).collect()
    docs = {r["doc_id"]: len(r["text"].encode()) + 8 for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == docs
    by: dict[int, list[int]] = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_sharding_equals_a_plain_ring(spark):
    """Shards and slots against rows put on the ring one by one, with hot, missing and repeated keys."""
    rows = [(i % 50 if i % 3 else 7, f"text {i % 40}") for i in range(300)] + [(None, f"t{i}") for i in range(100)] + [(None, None), (1, ""), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in sharding.shard(df, n_shards=5, virtual_nodes=3, cells=2).collect())
    assert sorted(r[:4] for r in got) == sorted((k is None, k or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for k, t in rows)
    points = sharding.ring(spark, 5, 3)
    at = [p[0] for p in points]
    crc, size = F.crc32(F.coalesce("text", F.lit("")).cast("binary")), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long")
    keyed = df.select("doc_id", crc.alias("crc"), size.alias("size")).select("*", F.xxhash64(F.lit("key"), "doc_id", "crc", "size").alias("h"), F.pmod(F.xxhash64(F.lit("cell"), "doc_id", "crc", "size"), F.lit(2)).alias("cell")).collect()
    arcs = [[] for _ in points]
    for r in sorted(keyed, key=lambda r: (r["cell"], r["h"], r["doc_id"] is not None, r["doc_id"] or 0, r["crc"], r["size"])):
        arcs[bisect.bisect_left(at, r["h"]) % len(points)].append(r)
    room = [len(rows) // 5 + (s < len(rows) % 5) for s in range(5)]
    of = {}
    for (_, s), arc in zip(points, arcs, strict=True):  # each shard fills from its own arcs
        take, room[s] = arc[: room[s]], room[s] - min(room[s], len(arc))
        for r in take:
            of.setdefault(tuple(r)[:3], []).append(s)
        del arc[: len(take)]
    waiting = []
    for turn in range(2 * len(points)):  # then the overflow goes on clockwise
        i, s = turn % len(points), points[turn % len(points)][1]
        waiting += arcs[i] if turn < len(points) else []
        while waiting and room[s]:
            of.setdefault(tuple(waiting.pop(0))[:3], []).append(s)
            room[s] -= 1
    want = sorted((k is None, k or 0, c, z, s) for (k, c, z), shards in of.items() for s in shards)
    assert sorted(r[:5] for r in got) == want
    for s in range(5):
        assert sorted(r[5] for r in got if r[4] == s) == list(range(sum(r[4] == s for r in got)))


def test_sharding_moves_little(spark):
    """With slack, one more shard moves about its own share of the rows."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard(df, n_shards=n, slack=0.25).collect()} for n in (10, 11))
    assert sum(a[k] != b[k] for k in a) < 4000 * 0.25


def test_ring_order():
    points = [(-5, 0), (3, 1), (10, 2)]
    assert [sharding.owner(points, h) for h in (-9, -5, 4, 11)] == [0, 0, 2, 0]
    assert sharding.place([5, 0, 1], [0, 1, 2], [2, 2, 2]) == [[(0, 2), (1, 2), (2, 1)], [], [(2, 1)]]


def brute_repeats(rows, length):
    first = {}
    for d, t in rows:
        for i in range(len(t) - length + 1):
            first[t[i : i + length]] = min(d, first.get(t[i : i + length], d))
    out = {}
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = True
        out[d] = bytes(np.frombuffer(t, np.uint8)[~gone])
    return out


@pytest.mark.parametrize("options", [{}, {"group": 2}, {"length": 24}, {"length": 70, "group": 3}])
def test_repeats_equal_brute_force(spark, options):
    rnd = random.Random(len(options))
    words = ["alpha", "beta", "gamma", "é", "中文", "z"]
    passages = [" ".join(rnd.choice(words) for _ in range(30)) for _ in range(5)]

    def piece():
        p = rnd.choice(passages)
        at = rnd.randrange(60)
        return rnd.choice([p[at : at + rnd.randint(10, 110)], "a" * rnd.randint(1, 130), "ab" * rnd.randint(1, 70), "".join(rnd.choice("abcdef ") for _ in range(rnd.randint(1, 90)))])

    rows = [(i - 50, "".join(piece() for _ in range(rnd.randint(0, 6)))) for i in range(200)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"], **options).collect()
    want = brute_repeats([(d, t.encode()) for d, t in rows], options.get("length", 50))
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == want
    assert all(r["n_bytes"] - r["n_removed"] == len(r["kept"]) and sum(b - a for a, b in r["spans"]) == r["n_removed"] for r in got)


@pytest.mark.parametrize("size", [1, 2, 3, 9])
def test_large_groups_that_begin_with_one_document(size):
    """Segments of the first document stay candidates when their group passes the bound before a second one is seen."""
    rows = pa.RecordBatch.from_pydict({"m": [x << repeats.SIDES for x in (5, *[7] * 6, 9)], "s": list(range(1, 9)), "d": [1, 1, 1, 1, 1, 2, 3, 1]})
    marks = [r for b in repeats._decide(2)(rows.slice(i, size) for i in range(0, 8, size)) for r in b.to_pylist()]
    assert sorted((r["d"], r["s"], r["kind"]) for r in marks) == [(d, s, repeats.HOT) for d, s in [(1, 2), (1, 3), (1, 4), (1, 5), (2, 6), (3, 7)]]


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 100)
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcd ") for _ in range(2000))
    rows = [(1, long.encode()), (2, (long[300:900] + "q" + long[100:160]).encode()), (3, b"")]
    of = [list(repeats.chunks([t], 50)) for _, t in rows]
    assert sum(int(s.windows.sum()) for s in of[0]) == 1951 and not of[2]
    want = {int(h) for s in repeats.chunks([long[300:900].encode()], 50) for h in s.hash}
    assert len(want & {int(h) for s in of[0] for h in s.hash}) > len(want) * 0.6


def test_collisions_are_caught(monkeypatch):
    """With a hash that says everything is equal, the order comes from the bytes."""
    monkeypatch.setattr(repeats.Prefixes, "of", lambda self, a, b: np.zeros(len(np.broadcast_arrays(a, b)[0]), np.uint64))
    data = np.frombuffer(b"bananas", np.uint8)
    order, ext = repeats.suffix_order(data, np.array([1, 3, 5, 0]), np.array([6, 4, 2, 7]), np.zeros(4, np.int64))
    assert order.tolist() == [0, 1, 2, 3] and ext.tolist() == [-1, 3, 1, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=9))
def test_suffix_order(parts):
    data = np.frombuffer("".join(parts).encode() + b"!", np.uint8)
    size = np.array([len(p) for p in parts])
    start = np.cumsum(size) - size
    order, ext = repeats.suffix_order(data, start, size, np.zeros(len(parts), np.int64))
    assert [parts[i] for i in order] == sorted(parts)
    assert ext[0] == -1
    for a, b, n in zip(order, order[1:], ext[1:], strict=False):
        assert parts[a][:n] == parts[b][:n] and (n == min(size[a], size[b]) or parts[a][n] != parts[b][n])


def test_posterior_bounds():
    limits = neardup.least_matches(0.8, 1e-6)
    assert limits == sorted(limits) and len(limits) == neardup.COMPARED // neardup.STEP
    rnd = np.random.default_rng(0)
    seen = np.cumsum(rnd.random((20000, neardup.COMPARED)) < 0.8, axis=1)[:, neardup.STEP - 1 :: neardup.STEP]
    assert ((seen < np.array(limits)).any(axis=1)).mean() < 1e-3


@pytest.mark.parametrize("bits", [0, 2])
def test_names_that_clash_are_told_apart(spark, bits):
    """With names of no or two bits every document clashes with others; the groups are those of brute force."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a + " end"), (3, b), (4, c), (5, c.upper()), (6, ""), (7, b + " x"), (8, "other words altogether here now")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), name_bits=bits).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 3, 8: 8}


def test_links_are_verified_on_words(monkeypatch):
    """Where all words hash alike, signatures agree, and the sets of words still tell two documents apart."""
    one, two = b"a b c d e f", b"u v w x y z"
    batch = pa.RecordBatch.from_pydict({"a": [1, 1], "b": [2, 3], "va": [one, one], "vb": [two, one]})
    assert [(r["a"], r["b"]) for out in neardup._exact(80, 5)([batch]) for r in out.to_pylist()] == [(1, 3)]
    monkeypatch.setattr(neardup.xxhash, "xxh3_64_intdigest", lambda w: 7)
    assert (neardup.signature(neardup.shingles("a b c d e", 5, neardup.Hashes())) == neardup.signature(neardup.shingles("u v w x y", 5, neardup.Hashes()))).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-4, 4), min_size=1, max_size=6), st.lists(st.floats(-3, 3), min_size=4, max_size=4))
def test_marginals_equal_enumeration(unary, ties):
    unary, ties = np.array(unary), np.array(ties).reshape(2, 2)
    total, good = 0.0, np.zeros(len(unary))
    for labels in itertools.product((0, 1), repeat=len(unary)):
        y = np.array(labels)
        p = np.exp(unary @ y + sum(ties[i, j] for i, j in itertools.pairwise(labels)))
        total, good = total + p, good + p * y
    assert np.allclose(quality.marginals(unary, ties), good / total)


def test_line_labels_are_learned():
    """Documents of good and bad lines: both labels occur within one, the document's own is the larger part, and neighbours' ties are learned."""
    rnd = np.random.default_rng(1)
    docs, lines, y = [], [], []
    for i in range(60):
        label = i % 2
        n_own = 12 + i % 5
        truth = np.r_[np.full(n_own, label), np.full(5, 1 - label)]
        docs.append(np.c_[np.ones(len(truth)), truth + rnd.normal(0, 0.2, len(truth))])
        lines.append(truth)
        y.append(label)
    y, weight, sizes = np.array(y), np.full(60, 1 / 60), [np.ones(len(t)) for t in lines]
    found = [np.full(len(t), v) for t, v in zip(lines, y, strict=True)]
    for i in range(3):
        w, ties = quality.fit_chain(docs, found, weight, tied=i > 0)
        found = [quality.relabel(quality.marginals(d @ w, ties), n, int(v)) for d, n, v in zip(docs, sizes, y, strict=True)]
    assert np.mean(np.concatenate(found) == np.concatenate(lines)) > 0.97
    assert ties[0, 0] + ties[1, 1] > ties[0, 1] + ties[1, 0]
    assert all((f == v).sum() * 2 >= len(f) for f, v in zip(found, y, strict=True))


def test_relabel():
    assert quality.relabel(np.array([0.9, 0.8, 0.1]), np.array([1.0, 1.0, 9.0]), 1).tolist() == [1, 1, 1]
    assert quality.relabel(np.array([0.9, 0.2, 0.1]), np.array([1.0, 1.0, 1.0]), 0).tolist() == [1, 0, 0]


def test_mixture_equals_plain_em():
    rnd = random.Random(4)
    p = [[rnd.random() for _ in range(3)] for _ in range(20)]
    n = [rnd.randint(1, 5) for _ in range(20)]
    share = [1 / 3] * 3
    for _ in range(12):
        new = [0.0] * 3
        for row, k in zip(p, n, strict=True):
            mixed = sum(a * b for a, b in zip(row, share, strict=True))
            for j in range(3):
                new[j] += k * row[j] * share[j] / mixed / sum(n)
        moved, share = max(abs(a - b) for a, b in zip(new, share, strict=True)), new
        if moved < 1e-4:
            break
    got, fit = langid.mixture(np.array(p), np.array(n, float))
    assert np.allclose(got, share)
    assert np.isclose(fit, sum(k * np.log(sum(a * b for a, b in zip(row, share, strict=True))) for row, k in zip(p, n, strict=True)))


def test_every_language_is_learned(spark):
    """300 languages of one document each; labels that repeat, are null or have null texts."""
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} {chr(0x4E00 + i)}", f"l{i}") for i in range(300)] + [(1000, None, "none"), (1001, "text", None), (5, "same", "l5"), (5, "same", "l5"), (None, "no id", "l7")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, table = langid.fit(df, F.lit(True))
    assert names == sorted(f"l{i}" for i in range(300)) and table.shape == (langid.BINS, 300)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df.filter("doc_id < 300").dropDuplicates(["doc_id"]), (names, table)).collect()}
    assert sum(got[i] == f"l{i}" for i in range(300)) >= 295


def test_samples_of_very_large_languages(spark):
    """Shares of counts beyond 10 ** 9 aren't rounded to nothing; rows of one id are drawn apart, whole repeats once."""
    rows = spark.range(4000).select(F.lit(1).alias("k"), (F.col("id") % 2000).cast("string").alias("t"), F.lit("en").alias("l"))
    assert 850 < langid.draw(rows, {"en": 2_000_000_000}, 1_000_000_000, "fit").count() < 1150
    assert langid.draw(rows, {"en": 4000}, 4000, "fit").count() == 2000


def test_documents_not_rows_make_a_line_common(spark):
    common, text = "this line stands everywhere", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty {}\n"
    one = [(1, text.format(1) + common, "h")] * 30
    many = [(i, text.format(i) + "  This  LINE stands everywhere ", None) for i in range(100, 130)]
    only = [(i, common + "\n" + common, "g") for i in range(200, 230)]
    rows = [*one, *many, *only, (None, common, "h"), (300, None, "h"), (301, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["doc_id"], r["common_words"], r["kept"], r["n_dup_lines"]) for r in rules.judge_lines(df).collect()}
    assert got == {(1, 0, True, 0), (None, 0, False, 0), (300, 0, False, 0), (301, 0, False, 0)} | {(i, 4, True, 0) for i in range(100, 130)} | {(i, 8, False, 1) for i in range(200, 230)}
    left = rules.remove_common_lines(df.withColumn("DOC", F.lit(1)))
    assert left.columns == ["doc_id", "text", "source", "DOC"]
    assert sorted({r["text"] for r in left.filter("doc_id >= 100").collect()}) == sorted(text.format(i).strip() for i in range(100, 130))
    assert left.filter("doc_id = 1").count() == 30 and left.filter("doc_id >= 200 or doc_id is null").isEmpty()


def test_automaton():
    terms = ["he", "she", "his", "hers", "s", "ushe"]
    machine = urls.Automaton(terms)
    for text in ["ushers", "shehishe", "", "xyz", "hhsshe"]:
        want = sorted((i + len(t), t) for t in terms for i in range(len(text)) if text.startswith(t, i))
        assert sorted(machine.find(text)) == want
    weights = {"bad": 2, "odd": 1, "off": 1}
    machine = urls.Automaton(weights)
    assert urls.weigh(machine, weights, "a-BAD/odd.odd") == (3, ["bad"], ["odd"])
    assert urls.weigh(machine, weights, "badly.odd1off") == (2, [], ["odd", "off"])


def test_windows_with_many_items():
    """Windows that several items share, items shorter than a window, and words that no item has."""
    items = [("a", "x y z w"), ("b", "q x y z"), ("c", "x y"), ("d", ""), ("e", "x y z w"), ("f", "m")]
    w = decontaminate.Windows(items, 3)
    assert w.find(b"k x y z w k m".split()) == ([(1, 5), (6, 7)], {"a", "b", "c", "e", "f"})
    assert w.find(b"y z w".split()) == ([(0, 3)], {"a", "e"})
    assert w.find([]) == ([], set()) and decontaminate.Windows([], 3).find([b"x"]) == ([], set())


def held_out(spark, query, truth, name):
    rows = query(spark, "/root/testdata/sf0.01").join(truth, "doc_id").filter("held_out")
    return rows.select(name, "truth", "score").collect()


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    rows = held_out(spark, queries.op7_language_id, docs, "lang_pred")
    assert np.mean([r["lang_pred"] == r["truth"] for r in rows]) > 0.95


def test_quality_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("truth"))
    rows = held_out(spark, queries.op4_quality, labels, "predicted")
    good, bad = ([r["score"] for r in rows if r["truth"] == v] for v in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.85


def test_texts_that_no_language_explains_go(spark):
    """Of planted texts, letter noise and those in a language that wasn't learned go; without labels all texts with letters stay."""
    import corpus_pipeline

    rnd = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    learned = docs.filter("lang <> 'de'")
    noise = [(10**9 + i, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(300)), None, "s", 300) for i in range(20)]
    planted = spark.createDataFrame([*noise, (10**9 + 20, "1234 !!", None, "s", 7)], learned.schema)
    foreign = docs.filter("lang = 'de'").withColumn("lang", F.lit(None).cast("string"))
    mixed = learned.unionByName(planted).unionByName(foreign)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, mixed, "").select("doc_id").collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert not kept & ids(planted)
    assert len(kept & ids(foreign)) <= 0.02 * foreign.count()
    assert len(kept & ids(learned)) >= 0.99 * learned.filter(F.col("text").rlike("[a-z]")).count()
    bare = planted.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, bare, "").count() == 20


def test_letters():
    """A text is undetermined just if no character of it is a letter."""
    for code in [*range(0x300), 0x3B1, 0x4E2D, 0x2028, 0x1F600, 0x10400]:
        low = chr(code).lower()
        assert (len(langid.trigrams(chr(code))[0]) > 0) == any(c.isalpha() for c in low), hex(code)


def test_mixtures_name_both_languages():
    table = np.full((langid.BINS, 2), 1e-4)
    table[:50, 0], table[50:100, 1] = 0.02, 0.02
    on, share = langid.infer(np.arange(100), np.full(100, 5), table / table.sum(axis=0))
    assert sorted(on.tolist()) == [0, 1] and abs(share[0] - 0.5) < 0.05
    on, _ = langid.infer(np.arange(50), np.full(50, 5), table / table.sum(axis=0))
    assert on.tolist() == [0]


@pytest.mark.parametrize("size", [4, 5])
def test_near_copies_equal_brute_force(spark, size):
    """Copies of a template with more and less edits, of which many pairs stand near the threshold."""
    rnd = random.Random(size)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(150)]
    texts = []
    for _ in range(90):
        words = [f"x{rnd.randrange(40)}" if rnd.random() < rnd.choice([0.0, 0.02, 0.03, 0.05]) else w for w in base]
        texts.append(" ".join(words[rnd.choice([0, 0, 10]) : rnd.choice([150, 150, 140])]))
    texts += ["", "one", "One", texts[0].upper()]
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    least = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(a & sets[j])
                if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                    least[i] = least[j] = min(least[i], least[j])
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=size).collect()}
    assert got == dict(enumerate(least)) and len(set(least)) > 3
