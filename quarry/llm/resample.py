"""Importance resampling towards a target distribution, drawn without replacement.

Features are runs of up to ``longest`` consecutive words, hashed by crc32 into
``buckets``. Counts of all documents and of all target texts give each bucket
a gain (in thousandths of a natural logarithm), a document's weight is the
floored mean of its features' gains, looked up in one array, and its score
adds Gumbel noise that only its key and a seed decide; the highest scores are
a weighted sample without replacement.

Scores are integers in a range that 64-bit counts bound (about 205 000 values),
so their histogram is exact and small. It gives the score at which the draw
ends; only documents from there on are sorted. Every partition's eligible rows
are one sorted run. The runs are cut into ranges of scores that fit in memory,
and each range's pieces of runs are merged by a tournament tree of losers; a
range's ranks follow those of the ranges before it, and end at the exact
number of draws. A score or key that a third of the rows share is cut too, by
the rows' places in their runs.

Null texts have no words; texts without words have weight 0. Documents with a
null key use the empty text for their noise and go last among ties. Rows that
repeat whole are drawn like others, in any order among themselves. Without
target texts every target count is 0. A text is one value in memory, whatever
its length. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import map_batches, pick, stage_folder

#: Lower case for A-Z, a space for what isn't part of a word.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Rows of a range of scores that is merged at once.
RANGE_ROWS = 100_000
#: ``monotonically_increasing_id``: partition above, place in the partition below.
PLACE_BITS = 33


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(LETTERS).split() if text else []


def hashed(words: list[bytes], longest: int) -> Iterator[np.ndarray]:
    """crc32 of the runs of 1, 2, ... words that end at each word, one array a length; the first ``n - 1`` of the n-th are of no use."""
    ends = list(map(crc32, words))
    yield np.array(ends, np.int64)
    for _ in range(1, longest):
        # crc32 goes on from a prefix: the run that ended one word before, then a space, then this word.
        spaced = list(map(crc32, repeat(b" "), ends))
        ends = [0, *map(crc32, words[1:], spaced)]
        yield np.array(ends, np.int64)


class Features:
    """The features of some texts side by side."""

    def __init__(self, texts: list[str | None], longest: int, buckets: int):
        split = [words_of(t) for t in texts]
        self.words = np.array([len(w) for w in split], np.int64)
        self.first = np.cumsum(self.words) - self.words
        flat = [w for s in split for w in s]
        place = np.arange(len(flat)) - np.repeat(self.first, self.words)
        #: Buckets of the runs of each length, and which of them lie within a text.
        self.runs = [(h % buckets, place >= n) for n, h in enumerate(hashed(flat, longest))] if flat else []
        self.count = sum((np.maximum(self.words - n, 0) for n in range(longest)), np.zeros(len(split), np.int64))

    def bucket_counts(self, buckets: int) -> np.ndarray:
        return sum((np.bincount(b[ok], minlength=buckets) for b, ok in self.runs), np.zeros(buckets, np.int64))

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """For each text, the sum of its features' gains."""
        out = np.zeros(len(self.words), np.int64)
        if self.runs:
            total = sum(np.where(ok, gains[b], 0) for b, ok in self.runs)
            some = np.flatnonzero(self.words)
            out[some] = np.add.reduceat(total, self.first[some])
        return out


def count_buckets(df: DataFrame, text: str = "text", longest: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks count first, so ``buckets`` rows reach the driver."""

    def fn(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += Features(b.column(0).to_pylist(), longest, buckets).bucket_counts(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    found = map_batches(pick(df, [text]).toDF("t"), fn, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["b"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's floor(1000 ln of the ratio of its smoothed shares), in doubles."""
    n = len(raw)
    s_all, t_all = float(int(raw.sum()) + n), float(int(target.sum()) + n)
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, key: str) -> int:
    """Gumbel noise in thousandths, from a hash of seed and key."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(df: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = 2, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all), then n_words, n_features, weight and score; kept columns of those names are replaced."""
    new = ["n_words", "n_features", "weight", "score"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    names = [f"k{i}" for i in range(len(keep))]
    taken = pick(df, [*keep, key, text]).toDF(*names, "id", "t").withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("")))
    sent = df.sparkSession.sparkContext.broadcast(table)

    def fn(batches):
        known = sent.value
        for b in batches:
            f = Features(b.column(len(keep) + 1).to_pylist(), longest, len(known))
            weight = f.sums(known) // np.maximum(f.count, 1)
            scores = weight + np.array([noise(seed, k) for k in b.column(len(keep)).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(x, pa.int64()) for x in (f.words, f.count, weight, scores)], names=[*names, *new])

    schema = StructType([taken.schema[n] for n in names] + list(StructType.fromDDL("n_words long, n_features long, weight long, score long").fields))
    return map_batches(taken, fn, schema).toDF(*keep, *new)


class Tournament:
    """A tree of losers over sorted runs: each match's loser stays at its node, the winner goes up, so the next row costs one match a level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, k = runs, len(runs)
        self.place = [0] * k
        self.losers = [-1] * k
        self.winner = self._play(1) if k else -1

    def _play(self, node: int) -> int:
        """The winner of the matches below a node; nodes from k on are the runs."""
        k = len(self.runs)
        if node >= k:
            return node - k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def _before(self, a: int, b: int) -> bool:
        x, y = self.place[a], self.place[b]
        if y == len(self.runs[b]):
            return True
        return x < len(self.runs[a]) and self.runs[a][x] < self.runs[b][y]

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while self.winner >= 0 and self.place[self.winner] < len(self.runs[self.winner]):
            won = self.winner
            yield self.runs[won][self.place[won]]
            self.place[won] += 1
            node = (won + k) // 2
            while node:
                if self._before(self.losers[node], won):
                    self.losers[node], won = won, self.losers[node]
                node //= 2
            self.winner = won


def _merge(names: list[str]):
    """A range's rows (columns, then key, score and place) -> the columns, the range's number and each row's rank in it."""

    def fn(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        places, scores, keys = t.column("at").to_numpy(), t.column("score").to_pylist(), t.column("id").to_pylist()
        runs, of = [], None
        # Rows come as pieces of runs, in any order: put in order of run and place they are sorted runs.
        for i in np.argsort(places, kind="stable").tolist():
            if places[i] >> PLACE_BITS != of:
                of = places[i] >> PLACE_BITS
                runs.append([])
            runs[-1].append((-scores[i], keys[i] is None, keys[i] if keys[i] is not None else 0, int(places[i]), i))
        order = pa.array([row[-1] for row in Tournament(runs)], pa.int64())
        n, at = t.num_rows, TaskContext.get().partitionId()
        made = [t.column(c).take(order).combine_chunks() for c in names]
        yield pa.RecordBatch.from_arrays([*made, pa.array(np.full(n, at), pa.int64()), pa.array(np.arange(1, n + 1))], names=[*names, "range", "within"])

    return fn


def draw(scored: DataFrame, key: str = "doc_id", percent: int = 25, min_words: int = 20, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of ``scored`` with their ``rank``: of the N with at least ``min_words`` words the floor(percent * N / 100) of highest score, ties to the smaller key, are 1, 2, 3, ...; the others null.

    ``scored`` is read several times: give it written, not as a plan over texts.
    """
    spark = scored.sparkSession
    columns = [c for c in scored.columns if c != "rank"]
    names = [f"k{i}" for i in range(len(columns))]
    rows = pick(scored, columns).toDF(*names)
    s, w, k = (F.col(names[columns.index(c)]) for c in ("score", "n_words", key))
    eligible = w >= min_words
    histogram = sorted(((r["s"], r["n"]) for r in rows.filter(eligible).groupBy(s.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted = sum(n for _, n in histogram) * percent // 100
    no_rank = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.select(*names, no_rank).toDF(*columns, "rank")
    taken, cut = 0, 0
    for cut, n in histogram:
        taken += n
        if taken >= wanted:
            break
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    runs = rows.filter(eligible & (s >= cut)).select(*names, k.alias("id"), s.alias("score")).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranges = runs.repartitionByRange(-(-taken // range_rows), *order, "at")
    schema = StructType([rows.schema[n] for n in names] + list(StructType.fromDDL("range long, within long").fields))
    at = stage_folder(spark, "resample-merged")
    map_batches(ranges, _merge(names), schema).write.parquet(at)
    merged = spark.read.schema(schema).parquet(at)
    before, offsets = 0, []
    for r, n in sorted((r["range"], r["n"]) for r in merged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r, before))
        before += n
    place = F.col("within") + F.col("before")
    ranked = merged.join(spark.createDataFrame(offsets, "r long, before long"), F.col("range") == F.col("r")).select(*names, F.when(place <= wanted, place).alias("rank"))
    rest = rows.filter(~(eligible & (s >= cut))).select(*names, no_rank)
    return ranked.unionByName(rest).toDF(*columns, "rank")


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 25, min_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all), n_words, n_features, weight, score and rank (null: not drawn) of every row.

    Texts are read twice, once to count buckets and once to score; scores are
    written to the shared folder.
    """
    spark = df.sparkSession
    keep = df.columns if keep is None else keep
    if key not in keep:
        raise ValueError(f"keep has to hold {key}")
    table = gains(count_buckets(df, text, longest, buckets), count_buckets(target, target_text, longest, buckets))
    scored = score(df, table, key, text, longest, seed, keep)
    at = stage_folder(spark, "resample-scored")
    # Written under plain names: files can't hold names that differ in case only.
    plain = scored.toDF(*[f"c{i}" for i in range(len(scored.columns))])
    plain.write.parquet(at)
    return draw(spark.read.schema(plain.schema).parquet(at).toDF(*scored.columns), key, percent, min_words)
