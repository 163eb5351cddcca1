"""Language identification as a mixture over languages.

A model holds, for each language, smoothed probabilities of hashed letter
trigrams. A document is a bag of trigrams from an unknown mixture of languages:
expectation-maximisation estimates the proportions, and languages leave the
set, least first, as long as the likelihood less ``penalty * log(n) / 2`` for
each language doesn't fall. The prediction is the largest proportion in the
set that is left, the score that proportion.

Learning reads the labelled rows that the caller admits: all of them, or about
``sample_per_language`` of each language by a hash of id and text (all rows of
a language that has no more), of which those that repeat whole count once. It
counts trigrams with ordinary aggregations; only the counts (languages times
``BINS``) reach the driver. Every value of ``lang`` is learned; labels so many
that the model would pass ``MAX_MODEL_BYTES`` aren't languages and are
refused. Texts that are null or hold no letter are ``und`` with
score 0, as is every text if nothing was learned. Texts of any length are
counted whole, one at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import add_by_text, map_batches, pick

BINS = 1 << 15
#: Languages whose counts a task holds at once, and steps of a gain's histogram to 1.
HELD, STEPS = 64, 1 << 14
#: Size of the largest model that is broadcast (128 KB a language).
MAX_MODEL_BYTES = 256 << 20
UNKNOWN = "und"


def letters(text: str) -> np.ndarray:
    """Lower-case code points, runs of anything but letters as one zero, with zeros around."""
    a = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    ok = (a >= 97) & (a <= 122) | (a >= 0xC0) & (a != 0xD7) & (a != 0xF7) | np.isin(a, (0xAA, 0xB5, 0xBA))
    high = a >= 0x250  # beyond the Latin blocks, ask Python which ones are letters
    if high.any():
        values, back = np.unique(a[high], return_inverse=True)
        ok[high] = np.array([chr(v).isalpha() for v in values.tolist()], bool)[back]
    a = np.where(ok, a, np.uint32(0))
    a = np.concatenate((np.zeros(1, np.uint32), a, np.zeros(1, np.uint32)))
    return a[np.concatenate(([True], (a[1:] != 0) | (a[:-1] != 0)))]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the letter trigrams and how often each occurs."""
    a = letters(text)
    if len(a) < 3 or not a.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = a[:-2] * np.uint32(0x9E3779B1) ^ (a[1:-1] * np.uint32(0x85EBCA77) << np.uint32(3)) ^ a[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F)
    counts = np.bincount(h >> np.uint32(17), minlength=BINS)
    bins = np.flatnonzero(counts)
    return bins, counts[bins]


def draw(rows: DataFrame, sizes: dict[str, int], each: int, seed: str) -> DataFrame:
    """l and t of about ``each`` of the ``sizes[l]`` rows (k, t, l) of a language l, each different row once."""
    share = F.element_at(F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, each / n))]), F.col("l"))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "k", "t"), F.lit(1 << 40)) < share * (1 << 40))
    return drawn.dropDuplicates(["k", "t", "l"]).select("l", "t")


def fit(docs: DataFrame, admitted: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_per_language: int | None = 1000, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """The languages and a float32 table (``BINS`` x languages) of probabilities; ``sample_per_language`` None: from all admitted rows."""
    taken = docs.filter(admitted)
    taken = pick(taken, [key, text, lang]).toDF("k", "t", "l").filter("l is not null and t is not null")
    most = MAX_MODEL_BYTES // (4 * BINS)
    sizes = {r["l"]: r["n"] for r in taken.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages: a model of over {MAX_MODEL_BYTES} bytes isn't broadcast")
    if not sizes:
        return [], np.zeros((BINS, 0), np.float32)
    rows = taken.select("l", "t") if sample_per_language is None else draw(taken, sizes, sample_per_language, "fit")

    def count(batches):
        totals: dict[str, np.ndarray] = {}

        def counted():
            for name, n in totals.items():
                bins = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(n[bins], pa.int64())], names=["l", "bin", "n"])

        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bins, n = trigrams(t)
                if len(totals) >= HELD and name not in totals:
                    yield from counted()
                    totals.clear()
                totals.setdefault(name, np.zeros(BINS, np.int64))[bins] += n
        yield from counted()

    rows = map_batches(rows, count, "l string, bin int, n bigint").groupBy("l", "bin").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("l").to_pylist()))
    counts = np.full((BINS, len(names)), smoothing)
    column = np.array([names.index(x) for x in rows.column("l").to_pylist()], np.int64)
    np.add.at(counts, (rows.column("bin").to_numpy(), column), rows.column("n").to_numpy())
    return names, (counts / counts.sum(axis=0)).astype(np.float32)


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation for bins of probabilities ``p`` seen ``n`` times, and the log-likelihood."""
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        mixed = p @ share
        new = share * ((n / mixed) @ p) / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def infer(bins: np.ndarray, n: np.ndarray, table: np.ndarray, penalty: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """The columns of the languages that are left, and their proportions."""
    p, n = table[bins].astype(np.float64), n.astype(np.float64)
    on = np.arange(table.shape[1])
    share, fit_now = mixture(p, n)
    cost = penalty * np.log(n.sum() + 1) / 2
    while len(on) > 1:
        rest = np.delete(on, share.argmin())
        if len(rest) > 8:  # far from the end: drop all that have next to nothing at once
            rest = on[share > 1e-3] if (share > 1e-3).sum() < len(rest) else rest
        new, fit_new = mixture(p[:, rest], n) if len(rest) > 1 else (np.ones(1), float(n @ np.log(p[:, rest[0]])))
        if fit_new + cost * (len(on) - len(rest)) < fit_now:
            break
        on, share, fit_now = rest, new, fit_new
    return on, share


def gain(bins: np.ndarray, n: np.ndarray, table: np.ndarray, on: np.ndarray, share: np.ndarray) -> float:
    """How much better than all bins alike the mixture explains a trigram on average: the difference of log-likelihoods."""
    return float(n @ np.log(table[np.ix_(bins, on)].astype(np.float64) @ share) / n.sum() + np.log(BINS))


def least_gains(docs: DataFrame, held_out: Column, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, float]:
    """For each language the gain under which a text isn't explained by it: half the median of all rows in it that the model hasn't learned from, not under 0; 0 without such rows.

    The median is the lower one, down to the next of ``STEPS`` steps to 1: it is
    read from a histogram, whose size doesn't depend on the number of rows.
    """
    least = dict.fromkeys(model[0], 0.0)
    if not least:
        return least
    taken = pick(docs.filter(held_out), [key, text, lang]).toDF("k", "t", "l").filter(F.col("l").isin(*least) & F.col("t").isNotNull())
    scored = predict(taken, model, "t", ["l"], gains=True).filter("gain is not null")
    counted = scored.groupBy("l", F.floor(F.col("gain") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("l")
    upto = counted.select("l", "step", F.sum("n").over(w.orderBy("step")).alias("upto"), F.sum("n").over(w).alias("all"))
    for r in upto.filter("2 * upto >= all").groupBy("l").agg(F.min("step").alias("mid")).collect():
        least[r["l"]] = max(0.0, r["mid"] / STEPS / 2)
    return least


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None, gains: bool = False) -> DataFrame:
    """``keep`` columns, then lang_pred, score and languages (all of the set, largest proportion first), with ``gains`` also the gain (null for ``und``)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        names, table = sent.value

        def of(texts: list[str]) -> list:
            best, scores, sets, gained = [], [], [], []
            for t in texts:
                bins, n = trigrams(t) if names else ((), ())
                if len(bins) == 0:
                    best.append(UNKNOWN), scores.append(0.0), sets.append([]), gained.append(None)
                    continue
                on, share = infer(bins, n, table)
                order = np.lexsort((on, -share))
                best.append(names[on[order[0]]]), scores.append(min(1.0, float(share[order[0]])))
                sets.append([names[i] for i in on[order]])
                gained.append(gain(bins, n, table, on, share) if gains else None)
            return [best, scores, sets, gained] if gains else [best, scores, sets]

        return of

    return add_by_text(docs, make, "lang_pred string, score double, languages array<string>" + ", gain double" * gains, text, keep)
