"""Vector compression by product codebooks, their entries searched as a VA-file.

Components become integers (``floor(scale * x)``), vectors are cut into
``parts`` equal consecutive parts, and every part position has a codebook of
``entries`` integer vectors, improved by ``rounds`` of assignment and floored
means. Nearest entries are found by filtering: each coordinate of an entry is
quantised to a few bits, the number of its cell; a query's table holds, for
each dimension and cell, the least and the greatest squared distance; summed
over an entry's cells they bound its distance from below and above. Only
entries whose lower bound doesn't exceed the least upper bound are refined by
their integer distance, so the nearest entry is exact, ties by lower index.

A round is one pass over the vectors: tasks add up the parts of each entry,
Spark adds up the tasks' sums, and ``parts * entries`` small sums, a number
set by the parameters, reach the driver. Vectors are never shuffled, so
neither a vector nor a label that many rows share makes a task larger.

Rows whose vector is null, or holds a null or a component that isn't finite,
are dropped. Vectors shorter than the longest kept one count as ending in
zeros, as does a length that ``parts`` doesn't divide. Components beyond
``limit(size)`` after scaling count as that limit, so that distances fit in
64 bits. A null key goes last among the first entries, rows that repeat a key
are ordered by their vectors. With fewer kept rows than ``entries`` the
codebooks are that much smaller; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import map_batches, pick

#: Bits of a coordinate's cell; entries a codebook at most, as indexes are two hexadecimal digits.
BITS, MOST_ENTRIES = 3, 256
#: Totals by group beyond this number are joined without a broadcast.
MOST_GROUPS = 10_000


def limit(size: int) -> int:
    """The greatest magnitude of a component for which a squared distance over ``size`` dimensions is at most 2**62."""
    return isqrt((1 << 62) // max(1, size)) // 2


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows are kept (places in the column), and their floored components, all lengths as they are."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    end = np.cumsum(sizes)
    kept = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[end - sizes]))
    with np.errstate(over="ignore"):
        whole = np.floor(np.where(np.isfinite(flat), flat, 0) * float(scale))
    whole = np.clip(whole, -float(1 << 60), float(1 << 60)).astype(np.int64)
    return kept, [whole[end[i] - sizes[i] : end[i]] for i in kept.tolist()]


def matrix(rows: list[np.ndarray], width: int, parts: int) -> np.ndarray:
    """The vectors as (row, part, dimension), ends filled with zeros."""
    size = width * parts
    most = limit(size)
    if all(len(r) == size for r in rows):
        out = np.array(rows, np.int64).reshape(len(rows), parts, width)
    else:
        out = np.zeros((len(rows), size), np.int64)
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        out = out.reshape(len(rows), parts, width)
    return np.clip(out, -most, most)


class Cells:
    """The entries of one codebook as a VA-file: a cell of few bits for each coordinate."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, cells = entries, 1 << bits
        low, high = entries.min(axis=0), entries.max(axis=0)
        # edges[c] <= coordinate <= edges[c + 1] in cell c, for each dimension.
        self.edges = low + (high - low) * np.arange(cells + 1)[:, None] // cells
        self.cell = np.minimum((entries[None] >= self.edges[:-1, None]).sum(axis=0) - 1, cells - 1)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each query to each entry, from the queries' tables."""
        below, above = self.edges[:-1, None] - queries, queries - self.edges[1:, None]  # (cell, query, dimension)
        low = np.maximum(np.maximum(below, above), 0) ** 2
        high = np.maximum(np.abs(below), np.abs(above)) ** 2
        dims = np.arange(queries.shape[1])
        by_cell = lambda t: t[self.cell, :, dims].sum(axis=1).T
        return by_cell(low), by_cell(high)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each query's nearest entry (ties: the lower index), its squared distance, and how many entries were refined."""
        if not len(queries):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        low, high = self.bounds(queries)
        q, e = np.nonzero(low <= high.min(axis=1)[:, None])
        exact = ((queries[q] - self.entries[e]) ** 2).sum(axis=1)
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        least = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == least[q])
        _, one = np.unique(q[hit], return_index=True)
        return e[hit[one]], least, len(q)


class Codebooks:
    """The entries of all part positions, (part, entry, dimension)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.parts, self.size, self.width = entries.shape

    def sha256(self) -> str:
        """Of the decimal components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (row, part) of the nearest entries and the squared distances summed over the parts."""
        index, error = np.zeros(vectors.shape[:2], np.int64), np.zeros(len(vectors), np.int64)
        for p in range(self.parts):
            index[:, p], least, _ = Cells(self.entries[p]).nearest(vectors[:, p])
            error += least
        return index, error


def _wide(df: DataFrame, vector: str, scale: int) -> int:
    """The length of the longest kept vector."""

    def fn(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max((len(r) for b in batches for r in integers(b.column(0), scale)[1]), default=0)], pa.int64())], names=["n"])

    return map_batches(pick(df, [vector]).toDF("v"), fn, "n long").agg(F.max("n")).first()[0] or 0


def _first_entries(df: DataFrame, key: str, vector: str, scale: int, entries: int, width: int, parts: int) -> np.ndarray:
    """The kept vectors of the least keys, as (part, entry, dimension)."""
    taken = pick(df, [key, vector]).toDF("k", "v")

    def fn(batches):
        for b in batches:
            kept, rows = integers(b.column(1), scale)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), pa.array(rows, pa.list_(pa.int64()))], names=["k", "v"])

    schema = StructType([taken.schema["k"], *StructType.fromDDL("v array<long>").fields])
    least = map_batches(taken, fn, schema).orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()
    return matrix([np.array(r["v"], np.int64) for r in least], width, parts).transpose(1, 0, 2)


def _sums(df: DataFrame, vector: str, scale: int, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each (part, entry): how many parts are nearest to it, and their sums."""

    def fn(batches):
        n, total = np.zeros((books.parts, books.size), np.int64), np.zeros(books.entries.shape, np.int64)
        for b in batches:
            vectors = matrix(integers(b.column(0), scale)[1], books.width, books.parts)
            index, _ = books.assign(vectors)
            for p in range(books.parts):
                chosen = (index[:, p, None] == np.arange(books.size)).astype(np.int64)
                n[p] += chosen.sum(axis=0)
                total[p] += chosen.T @ vectors[:, p]
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["p", "e", "n", "v"])

    found = map_batches(pick(df, [vector]).toDF("v"), fn, "p int, e int, n long, v array<long>")
    summed = found.select("p", "e", "n", F.posexplode("v").alias("i", "x")).groupBy("p", "e", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in summed.collect():
        out.setdefault((r["p"], r["e"]), (r["n"], [0] * books.width))[1][r["i"]] = int(r["x"])
    return out


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks that start from the parts of the ``entries`` least keys and are improved ``rounds`` times; entries that nothing is nearest to stay."""
    if not 0 < entries <= MOST_ENTRIES:
        raise ValueError(f"entries: 1 to {MOST_ENTRIES}")
    width = -(-_wide(df, vector, scale) // parts)
    books = Codebooks(_first_entries(df, key, vector, scale, entries, width, parts))
    for _ in range(rounds if books.size and books.width else 0):
        better = books.entries.copy()
        for (p, e), (n, total) in _sums(df, vector, scale, books).items():
            better[p, e] = [x // n for x in total]
        if (better == books.entries).all():
            break  # further rounds would change nothing
        books = Codebooks(better)
    return books


def encode(df: DataFrame, books: Codebooks, vector: str = "embedding", scale: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of the kept rows, then ``code`` (two hex digits a part) and ``error`` (squared distances summed); kept columns of those names are replaced."""
    new = ["code", "error"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    names = [f"k{i}" for i in range(len(keep))]
    taken = pick(df, [*keep, vector]).toDF(*names, "v")
    digits = np.array([f"{i:02x}" for i in range(MOST_ENTRIES)])

    def fn(batches):
        for b in batches:
            kept, rows = integers(b.column(len(keep)), scale)
            if not len(kept):
                continue
            index, error = books.assign(matrix(rows, books.width, books.parts))
            codes = ["".join(x) for x in digits[index].tolist()]
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([b.column(i).take(at) for i in range(len(keep))] + [pa.array(codes), pa.array(error)], names=[*names, *new])

    schema = StructType([taken.schema[n] for n in names] + list(StructType.fromDDL("code string, error long").fields))
    return map_batches(taken, fn, schema).toDF(*keep, *new)


def add_group_error(df: DataFrame, group: str = "label", error: str = "error", new: str = "group_error") -> DataFrame:
    """``df`` with the sum of ``error`` over the rows of equal ``group`` (nulls together; null if it doesn't fit in 64 bits).

    Sums combine before the exchange. Up to ``MOST_GROUPS`` of them are sent to
    the rows; more are joined, where Spark splits a group that many rows share.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    g, e = names[df.columns.index(group)], names[df.columns.index(error)]
    rows = df.toDF(*names)
    totals = rows.groupBy(F.col(g).alias("g")).agg(F.sum(F.col(e).cast("decimal(38,0)")).alias("x")).select("g", F.expr("try_cast(x as bigint)").alias("x"))
    few = totals.limit(MOST_GROUPS + 1).collect()
    if len(few) <= MOST_GROUPS and sum(len(str(r["g"])) for r in few) <= 64 * MOST_GROUPS:
        totals = F.broadcast(df.sparkSession.createDataFrame(few, totals.schema))
    return rows.join(totals, F.col(g).eqNullSafe(F.col("g")), "left").select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True) if c != new], F.col("x").alias(new))
