"""Benchmark decontamination by a broadcast hash set of test n-grams.

Benchmark items become windows of ``n`` consecutive normalised words (an item
of fewer words is one window of all of them). Documents are scanned word by
word: runs of benchmark words long enough for a window are hashed window by
window, looked up in the set, and hits are verified word by word. Output: the
words hit as spans, the items found, and the text without the spans.

The set is broadcast in blocks of at most ``MAX_BLOCK_BYTES`` of benchmark
text; a larger benchmark is scanned for block after block, the findings of
each pass checkpointed with the row, so that the driver and each task hold one
block at a time. Null texts have no words. Texts of any length are scanned
whole; rows that repeat are judged alike; items that repeat count once by id.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, once, pick
from quarry.operators.graph import checkpointed

MAX_BLOCK_BYTES = 16 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: The same on UTF-8 bytes: letters a-z, digits and all bytes of other characters make words, the rest is white space.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(BYTES).split()


class Windows:
    """The windows of some items: for each length their sorted hashes and where they begin among all words of the items."""

    P = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.words: dict[bytes, int] = {}
        ids = [np.array([self.words.setdefault(w, len(self.words)) for w in normal_words(text)], np.int32) for _, text in items]
        self.flat = np.concatenate([np.zeros(0, np.int32), *ids])
        counts = np.array([len(x) for x in ids], np.int64)
        self.first = np.cumsum(counts) - counts
        self.names = [name for name, _ in items]
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.minimum(counts[counts > 0], n)).tolist():
            starts = np.concatenate([f + np.arange(c - size + 1) for f, c in zip(self.first.tolist(), counts.tolist(), strict=True) if min(c, n) == size])
            h = self.hashed(self.flat, size)[starts]
            order = np.argsort(h, kind="stable")
            self.tables[size] = h[order], starts[order]
        self.least = min(self.tables, default=1)

    def hashed(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A polynomial hash of each window of ``size`` ids."""
        a = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
        a ^= a >> np.uint64(32)
        out = np.zeros(len(a) - size + 1, np.uint64)
        for i in range(size):
            out = out * self.P + a[i : len(a) - size + 1 + i]
        return out

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [from, to) of words hit, merged, and the items found."""
        if len(words) < self.least or not self.tables:
            return [], set()
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans, found = [], set()
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            run = ids[a:b]
            for size, (hashes, starts) in self.tables.items():
                if b - a < size:
                    continue
                h = self.hashed(run, size)
                low = np.searchsorted(hashes, h)
                for i in np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == h).tolist():
                    at = starts[low[i] : np.searchsorted(hashes, h[i], "right")]
                    at = at[(self.flat[at[:, None] + np.arange(size)] == run[i : i + size]).all(axis=1)]
                    if len(at):
                        spans.append((a + i, a + i + size))
                        found.update((np.searchsorted(self.first, at, "right") - 1).tolist())
        return merge(spans), {self.names[i] for i in found}


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join(out) + text[at:]


def _blocks(benchmark: DataFrame, item: str, text: str, most: int):
    """Lists of (item, text) of at most ``most`` bytes of text, read from the driver one block at a time."""
    rows, size = [], 0
    taken = pick(benchmark, [item, text]).toDF("i", "t").filter("t is not null").select(F.col("i").cast("string").alias("i"), "t")
    for r in taken.toLocalIterator():
        n = len(r["t"].encode("utf-8"))
        if rows and size + n > most:
            yield rows
            rows, size = [], 0
        rows.append((r["i"] or "", r["t"]))
        size += n
    yield rows


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 10, keep: list[str] | None = None, cleaned: bool = True, block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``keep`` columns, then n_words, spans (word positions [from, to) hit), items (sorted as strings), and ``cleaned`` text."""
    new = ["n_words", "spans", "items", "cleaned"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    names = [f"k{i}" for i in range(len(keep))]
    spark = df.sparkSession
    none = F.array().cast("array<array<int>>"), F.array().cast("array<string>")
    out = pick(df, [*keep, text]).toDF(*names, "t").withColumns({"n_words": F.lit(0).cast("long"), "spans": none[0], "items": none[1], "cleaned": F.lit(None).cast("string")})
    for i, rows in enumerate(_blocks(benchmark, item, item_text, block_bytes)):
        out = checkpointed(out) if i else out
        sent, block = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def fn(batches, sent=sent, block=block):
            windows = once(("windows", block), lambda: Windows(sent.value, n))
            for b in batches:
                col = {name: b.column(j) for j, name in enumerate(b.schema.names)}
                counts, spans, items, clean = [], [], [], []
                for t, had, has in zip(col["t"].to_pylist(), col["spans"].to_pylist(), col["items"].to_pylist(), strict=True):
                    w = normal_words(t or "")
                    s, x = windows.find(w)
                    s = merge([*map(tuple, had), *s]) if had else s
                    counts.append(len(w))
                    spans.append([list(p) for p in s])
                    items.append(sorted(x | set(has)))
                    clean.append(cut(t, s) if cleaned and t is not None else None)
                made = {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, b.schema.field("spans").type), "items": pa.array(items, b.schema.field("items").type), "cleaned": pa.array(clean, pa.string())}
                yield pa.RecordBatch.from_arrays([made.get(c, col[c]) for c in b.schema.names], names=b.schema.names)

        out = map_batches(out, fn, out.schema, keeps=True)
    return out.select(*[F.col(a).alias(c) for a, c in zip(names, keep, strict=True)], *new)
