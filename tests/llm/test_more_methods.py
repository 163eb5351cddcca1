"""Vector codes, substring dedup and importance resampling: methods against brute force, odd input and hot keys."""

import hashlib
import math
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import resample, substrings, vectors

LONG = "several ordinary words make a sentence here and there " * 4000
ROWS = [(None, "no id at all here " * 9), (None, None), (1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "same row twice " * 10), (5, "same row twice " * 10), (6, "same row twice " * 10), (7, "nul \0 and \U0001f600 中文 ñ"), (-1, "minus one"), (8, "x" * 70_000), (9, "y" * 300 + " z " * 30)]
EXTRA = {"k": "'k'", "t": "1", "d": "2.0D", "s": "cast(null as string)", "u": "5", "DOC_ID": "'clash'", "Text": "'clash'", "a.b": "'dot'", "score": "'old'", "rank": "'old'", "code": "'old'", "error": "'old'", "kept": "'old'", "n_words": "'old'"}


def with_clashes(df):
    return df.select("*", *[F.expr(v).alias(f"x{i}") for i, v in enumerate(EXTRA.values())]).toDF(*df.columns, *EXTRA)


def by_place(df, *columns):
    """Rows of the named columns, names taken exactly."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return [tuple(r) for r in df.toDF(*names).select(*[names[df.columns.index(c)] for c in columns]).collect()]


# --- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(key, vector) -> codes, errors and final entries, every distance computed."""
    kept = [(k, [math.floor(4096 * x) for x in v]) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v in kept), default=0) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (gap(books[p][e], x), e))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(p, c[p]) for c in cut]
            books[p] = [[sum(c[p][i] for c, o in zip(cut, of, strict=True) if o == e) // of.count(e) for i in range(width)] if e in of else books[p][e] for e in range(len(books[p]))]
    out = []
    for (k, _), c in zip(kept, cut, strict=True):
        of = [near(p, c[p]) for p in range(parts)]
        out.append((k, "".join(f"{o:02x}" for o in of), sum(gap(books[p][o], c[p]) for p, o in enumerate(of))))
    return sorted(out, key=repr), books


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_against_all_distances(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([-0.5, 0.25, rnd.gauss(0, 1)]) for _ in range(24)]) for i in range(120)]
    rows += [(3, [0.1] * 24), (3, [0.1] * 24), (None, [0.3] * 24), (200, None), (201, [None] * 24), (202, [float("nan")] * 24), (203, [float("inf")] + [0.0] * 23), (204, [1.0, -1.0]), (205, [])]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    books = vectors.fit(df)
    got = sorted(by_place(vectors.encode(df, books), "vec_id", "code", "error"), key=repr)
    want, entries = plain_codes(rows)
    assert got == want
    assert books.entries.tolist() == entries
    assert books.sha256() == hashlib.sha256(",".join(str(x) for b in entries for e in b for x in e).encode()).hexdigest()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    entries, queries = rng.integers(-5000, 5000, (16, 8)), rng.integers(-6000, 6000, (500, 8))
    cells = vectors.Cells(entries)
    low, high = cells.bounds(queries)
    exact = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all()
    index, least, refined = cells.nearest(queries)
    assert (index == exact.argmin(axis=1)).all() and (least == exact.min(axis=1)).all()
    assert refined < 500 * 16 / 2  # most entries are never refined


def test_codes_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(1, [1.0] * 8), (2, [2.0] * 8)], "vec_id long, embedding array<float>")
    books = vectors.fit(few)
    assert books.size == 2 and by_place(vectors.encode(few, books), "code", "error") == [("00" * 8, 0), ("01" * 8, 0)]
    none = few.filter("vec_id > 5")
    assert vectors.encode(none, vectors.fit(none)).count() == 0
    huge = spark.createDataFrame([(1, [1e300] * 8), (2, [-1e300] * 8)], "vec_id long, embedding array<double>")
    most = vectors.limit(8)
    assert sorted(by_place(vectors.encode(huge, books), "code", "error")) == [("00" * 8, 8 * (most + 4096) ** 2), ("01" * 8, 8 * (most - 8192) ** 2)]
    assert vectors.encode(huge, vectors.fit(huge)).count() == 2


def test_group_errors(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, None, 7), (4, None, 1), (5, "b", 2)], "vec_id long, label string, error long")
    want = [(1, 11), (2, 11), (3, 8), (4, 8), (5, 2)]
    assert sorted(by_place(vectors.add_group_error(df), "vec_id", "group_error")) == want
    monkeypatch.setattr(vectors, "MOST_GROUPS", 1)
    assert sorted(by_place(vectors.add_group_error(df), "vec_id", "group_error")) == want


# --- substring dedup


def plain_repeats(rows, length=20):
    """(key, text) -> what is left of each, in any order; rows that share a key don't remove each other's words."""
    seen: dict[tuple, int] = {}
    split = [(k, (t or "").split()) for k, t in rows]
    for k, w in split:
        for i in range(len(w) - length + 1):
            if k is not None:
                x = tuple(w[i : i + length])
                seen[x] = min(seen.get(x, k), k)
    out = []
    for k, w in split:
        own, gone = set(), set()
        for i in range(len(w) - length + 1):
            x = tuple(w[i : i + length])
            if x in own or k is not None and seen[x] < k:
                gone.update(range(i, i + length))
            own.add(x)
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((k, len(w), len(gone), " ".join(left)))
    return sorted(out, key=repr)


def removed(df, **options):
    return sorted(by_place(substrings.remove_repeats(df, **options), "doc_id", "n_words", "n_removed", "kept"), key=repr)


def corpus(seed, docs=60, words=12):
    """Texts of few words, with shared passages at odd places, copies and repeats within a text."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    shared = [say(n) for n in (19, 20, 21, 25, 40, 90)]
    rows = []
    for i in range(docs):
        parts = [say(rnd.randrange(40))]
        for _ in range(rnd.randrange(4)):
            parts += [rnd.choice(shared), say(rnd.randrange(30))]
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(parts)))
    return [*rows, (docs, rows[3][1]), (docs + 1, rows[3][1] + " tail"), (docs + 2, "loop " * 70), (docs + 3, rows[5][1] + " " + rows[5][1])]


@pytest.mark.parametrize(("seed", "words", "group"), [(1, 12, 20_000), (2, 2000, 20_000), (3, 3, 20_000), (4, 12, 2), (5, 2000, 2), (6, 40, 1)])
def test_repeats_against_all_windows(spark, seed, words, group):
    """Also with groups so small that prefixes grow to 12 and then to all 20 words."""
    rows = corpus(seed, words=words)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert removed(df, group=group) == plain_repeats(rows)


def test_pieces_of_long_texts(monkeypatch):
    """Texts that are cut into pieces and chunks have the same windows, and the same repeats within them."""
    texts = [t.encode().split() for _, t in corpus(7, docs=25)]
    texts.append([w for t in texts[:9] for w in t])

    def windows():
        return sorted((int(s.row[i]), int(s.at[i]) + k) for s in substrings.chunks(texts, 20) for i in range(len(s.row)) for k in range(int(s.windows[i])))

    whole, repeats = windows(), substrings.again(texts, 20)
    assert whole == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 19)]
    for name, n in (("PIECE", 50), ("CHUNK", 130)):
        monkeypatch.setattr(substrings, name, n)
    assert len(list(substrings.chunks(texts, 20))) > 10 and windows() == whole
    assert [*map(sorted, substrings.again(texts, 20))] == [*map(sorted, repeats)] and repeats[-1]


def test_repeats_on_odd_rows(spark):
    df = with_clashes(spark.createDataFrame(ROWS, "doc_id long, text string"))
    assert removed(df) == plain_repeats(ROWS)
    assert removed(df.limit(0)) == []


def test_repeats_with_hot_keys(spark):
    """A third of the rows share an id, a passage or a whole text; results are those of all windows."""
    rnd = random.Random(9)
    say = lambda n: " ".join(f"v{rnd.randrange(5000)}" for _ in range(n))
    passage, text = say(30), say(50)
    rows = [(7, say(25) + " " + passage) for _ in range(60)] + [(100 + i, say(9) + " " + passage + " " + say(9)) for i in range(60)] + [(200 + i, text) for i in range(60)] + [(50, text)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert removed(df) == removed(df, group=3) == plain_repeats(rows)


def test_subtree_orders_and_branches():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, 400)
    start = np.arange(0, 380)
    order, branch = substrings.subtree(words, start, 20)
    keys = [tuple(words[i : i + 20].tolist()) for i in start[order]]
    names = {v: i for i, v in enumerate(sorted(set(words.tolist())))}
    assert keys == sorted(keys, key=lambda k: ([names[x] for x in k[:16]], [names[x] for x in k[4:]]))
    for i in range(1, len(keys)):
        assert branch[i] == next((j for j in range(20) if keys[i][j] != keys[i - 1][j]), 20)
    node = substrings.deep_nodes(branch, 20)
    assert len(set(zip(node.tolist(), keys, strict=True))) == len(set(keys)) == node[-1] + 1


# --- importance resampling


def plain_scores(rows, target, percent=25, min_words=20, buckets=10_000, longest=2):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if c >= "\x80" or c.isalnum() else " " for c in low).split(" ")

    def features(t):
        w = [x for x in words(t) if x]
        return [crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    s, t = [0] * buckets, [0] * buckets
    made = [(k, *features(x)) for k, x in rows]
    for _, f, _ in made:
        for b in f:
            s[b] += 1
    for x in target:
        for b in features(x)[0]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(t) * 0 + sum(s) + float(buckets)) / ((s[b] + 1.0) * (sum(t) + float(buckets))))) for b in range(buckets)]
    out = []
    for k, f, n in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[: len(able) * percent // 100], len(able)


def check_draw(spark, rows, target, **options):
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = by_place(resample.resample(df, goal, **options), "doc_id", "n_words", "n_features", "weight", "score", "rank")
    plain, drawn, _ = plain_scores(rows, target, **{k: v for k, v in options.items() if k in ("percent", "longest")})
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted((tuple(r) for r in plain), key=repr)
    ranked = sorted((r for r in got if r[5] is not None), key=lambda r: r[5])
    assert [r[5] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r[4], r[0]) for r in ranked] == [(r[4], r[0]) for r in drawn]


@pytest.mark.parametrize(("options", "range_rows"), [({}, 100_000), ({"percent": 100}, 7), ({"percent": 60, "longest": 3}, 3), ({"percent": 0}, 5)])
def test_draw_against_sorting(spark, monkeypatch, options, range_rows):
    """Also with ranges of few rows, so that ranks go on from range to range."""
    monkeypatch.setattr(resample.draw, "__defaults__", (*resample.draw.__defaults__[:-1], range_rows))
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["Alpha", "beta", "Gamma-ray", "ünï", "x1"]) for _ in range(rnd.randrange(15, 40)))) for i in range(90)]
    check_draw(spark, [*rows, *ROWS, *rows[:3]], ["alpha beta " * 9, "", None, "x1"], **options)


def test_draw_with_hot_scores(spark, monkeypatch):
    """Rows that repeat whole share score and key: they are dealt to many ranges, and drawn up to the exact count."""
    monkeypatch.setattr(resample.draw, "__defaults__", (*resample.draw.__defaults__[:-1], 4))
    text = "one and the same text of more than twenty words " * 3
    rows = [(5, text)] * 60 + [(i, text + f" no {i}") for i in range(100, 130)] + [(None, text)] * 20
    check_draw(spark, rows, ["same text"], percent=70)


def test_draw_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a few words")], "doc_id long, text string")
    assert by_place(resample.resample(one, none), "doc_id", "n_features", "rank") == [(1, 5, None)]


def test_tournament_merges_runs():
    rnd = random.Random(6)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((rnd.randrange(50), i) for _ in range(rnd.randrange(9))) for i in range(k)]
        assert list(resample.Tournament(runs)) == sorted(x for r in runs for x in r)
