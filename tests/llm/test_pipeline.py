"""The pipeline's stages, one by one and all together, against brute-force versions on a small corpus."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from test_methods import RANKS, brute_repeats

import corpus_pipeline as cp

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return "".join(c.lower() if c < "\x80" else c for c in text)


def near(rows):
    """The row of the least id of each group of five-word shingle sets alike by 0.8."""
    sets = []
    for _, t in rows:
        w = low(t).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(a & sets[j])
                if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                    group[i] = group[j] = min(group[i], group[j])
    best = {}
    for g, r in zip(group, rows, strict=True):
        best[g] = min(r, best.get(g, r))
    return sorted(best.values())


def passages(rows):
    left = {d: t.decode("utf-8", "ignore") for d, t in brute_repeats([(d, t.encode()) for d, t in rows], 50).items()}
    return [(d, left[d]) for d, _ in rows if left[d].strip(" \t\n\x0b\f\r")]


def clean(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for t in items:
        w = word.findall(low(t))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    out = []
    for d, t in rows:
        found = list(word.finditer(low(t)))
        hit = np.zeros(len(found) + 1, bool)
        for n in {len(w) for w in windows}:
            for i in range(len(found) - n + 1):
                if tuple(m[0] for m in found[i : i + n]) in windows:
                    hit[i : i + n] = True
        kept, at, i = "", 0, 0
        while i < len(found):
            if hit[i]:
                j = i
                while hit[j]:
                    j += 1
                kept, at, i = kept + t[at : found[i].start()], found[j - 1].end(), j
            else:
                i += 1
        kept += t[at:]
        if kept.strip(" \t\n\x0b\f\r"):
            out.append((d, kept))
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, items = [text(20) for _ in range(3)], [text(14), text(4), "", text(30)]
    rows = []
    for _ in range(40):
        parts = [text(rnd.randint(5, 40)), rnd.choice(shared), rnd.choice(items), text(10)]
        rows.append("\n".join(rnd.sample(parts, rnd.randint(1, 4))))
    rows += [rows[3], "".join(c.upper() if c < "\x80" else c for c in rows[5]), rows[7] + " one", " ".join(rows[9].split()[:-1]), items[0], items[3], "", " \n", "123 456", shared[0]]
    folder = str(tmp_path_factory.mktemp("corpus"))
    df = spark.createDataFrame([(i, t, None, f"s{i % 3}", len(t)) for i, t in enumerate(rows)] + [(99, None, None, None, None)], COLUMNS)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, list(enumerate(rows)), items


def of(df):
    return sorted((r["doc_id"], r["text"], r["n_chars"]) for r in df.collect())


def sized(rows):
    return sorted((d, t, len(t)) for d, t in rows)


def test_each_stage(spark, corpus):
    folder, rows, items = corpus
    frame = lambda rows: spark.createDataFrame([(d, t, None, "s", len(t)) for d, t in rows], COLUMNS)
    assert of(cp.near_duplicates(spark, frame(rows), folder).filter("text rlike '[^ \n]'")) == sized(r for r in near(rows) if r[1].split())
    assert of(cp.repeated_passages(spark, frame(rows), folder)) == sized(passages(rows))
    assert of(cp.benchmark_passages(spark, frame(rows), folder)) == sized(clean(rows, items))


def test_whole_run(spark, corpus):
    """No row has a language, so only texts without letters go first; the rest passes all stages as by brute force."""
    import tiktoken

    folder, rows, items = corpus
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    want = clean(passages(near([r for r in rows if any(c.isalpha() for c in r[1])])), items)
    got = cp.run(spark, folder).collect()
    assert sorted((r["doc_id"], tuple(r["ids"]), r["n_tokens"]) for r in got) == sorted((d, tuple(lib.encode_ordinary(t)), len(lib.encode_ordinary(t))) for d, t in want)
    assert all(r["round_trip"] for r in got) and len(want) < len(rows) - 8


def test_model_and_thresholds_from_all_rows(spark, monkeypatch):
    """More rows of a language than any sample had: every one counts, and the thresholds are halves of the medians."""
    from pyspark.sql import functions as F

    from quarry.llm import langid

    monkeypatch.setattr(langid, "draw", None)
    rnd = random.Random(3)
    word = lambda abc: "".join(rnd.choice(abc) for _ in range(rnd.randint(2, 7)))
    rows = [(i, " ".join(word("abcdef" if i % 3 else "uvwxyz") for _ in range(12)), "a" if i % 3 else "u") for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = F.col("doc_id") % 2 == 0
    names, table = model = langid.fit(df, ~out, sample_per_language=None)
    for j, name in enumerate(names):
        counts = np.full(langid.BINS, 0.1)
        for i, t, lang in rows:
            if i % 2 and lang == name:
                bins, n = langid.trigrams(t)
                counts[bins] += n
        assert np.allclose(table[:, j], counts / counts.sum())
    least = langid.least_gains(df, out, model)
    for name in names:
        gains = []
        for i, t, lang in rows:
            if i % 2 == 0 and lang == name:
                bins, n = langid.trigrams(t)
                gains.append(langid.gain(bins, n, table, *langid.infer(bins, n, table)))
        mid = sorted(gains)[(len(gains) - 1) // 2]
        assert mid / 2 - 1 / langid.STEPS < least[name] <= mid / 2


def test_small_caches_give_the_same_ids():
    from quarry.llm import bpe

    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choice("abcdefghé ") for _ in range(rnd.randint(1, 14))) for _ in range(40)) for _ in range(30)]
    one, two = bpe.Encoder(RANKS, public_tokenizers.PATTERN), bpe.Encoder(RANKS, public_tokenizers.PATTERN, states=40, words=20)
    assert list(one.encode_all(texts)) == [b for t in texts for b in two.encode_all([t])]
    assert len(two.machine.states) <= 41 and two.most == 20
