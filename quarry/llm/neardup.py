"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct word shingles, as 64-bit hashes up to the last
step. Documents of equal word sequences are one node: nodes are named by 64
bits of a cryptographic digest of the sequence, and should two sequences ever
get one name, the rest of the digest tells them apart (``_apart``). Banded
MinHash signatures bring nodes together in buckets; pairs of a bucket are
compared batch by batch of their signatures and dropped as soon as the
posterior probability of a similarity at or above the threshold falls under
``miss``; survivors are verified on the full sets of shingles, word by word.
Components of the verified links are the groups.

Buckets never emit all their pairs. First each bucket's members are compared
with its leader, the member that shares most buckets (a hub of its group), and
links are closed to components. Only buckets that still hold several
components are looked at again: there pairs of different components, not
compared before, are compared if they share a shingle early enough in rarity
order to reach the threshold. So work follows the links, while no link between
components of a bucket is left out.

Null texts and texts without a word have an empty set and no links. Rows that
repeat an id keep their own sets; a component's id is its least document id.
Texts of any length are taken whole, one at a time.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, pick
from quarry.operators.graph import checkpointed, components

BANDS, ROWS = 48, 7
#: Signature bytes that take part in the sequential comparison, and the size of a batch of them.
COMPARED, STEP = 192, 32
MAX_WORDS = 300_000
_P = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingles(text: str, size: int, hashes: Hashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; A-Z count as a-z, words end at ASCII white space."""
    return shingle_hashes(words_of(text), size, hashes)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def shingle_hashes(words: list[bytes], size: int, hashes: Hashes) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed(h * _P + w[i : n - k + 1 + i])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, ((x[i : i + 2048, None] ^ _B) * _A).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = mixed(h * _P + rows[:, i])
    return h.view(np.int64)


def digest(words: list[bytes]) -> bytes:
    return blake2b(b" ".join(words), digest_size=16).digest()


def name_of(g: bytes, bits: int = 64) -> int:
    """The name of a node: the first half of its digest (of that, the last ``bits``)."""
    return int.from_bytes(g[:8], "little", signed=True) & (1 << bits) - 1 if bits < 64 else int.from_bytes(g[:8], "little", signed=True)


def _describe(size: int, bits: int):
    def fn(batches):
        hashes = Hashes()
        for b in batches:
            n, d, g, sig, keys = [], [], [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                words = words_of(t or "")
                s = shingle_hashes(words, size, hashes)
                n.append(len(s))
                g.append(digest(words) if words else None)
                d.append(name_of(g[-1], bits) if words else None)
                full = signature(s) if words else None
                sig.append((full[:COMPARED] & np.uint32(255)).astype(np.uint8).tobytes() if words else None)
                keys.append(band_keys(full) if words else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(g, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["k", "th", "n", "d", "g", "sig", "keys"])

    return fn


def _normal(batches):
    """(d, digest, text) -> (d, words) of the texts that have the digest, for rows are found by hashes of their ids and texts."""
    for b in batches:
        d, words = [], []
        for name, g, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            w = words_of(t or "")
            if digest(w) == g:
                d.append(name)
                words.append(b" ".join(w))
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(words, pa.binary())], names=["d", "w"])


def least_matches(threshold: float, miss: float) -> list[int]:
    """For 32, 64, ... compared places the fewest matches at which the similarity may still reach the threshold.

    With a uniform prior the posterior after m of n matches is Beta(m + 1,
    n - m + 1); its mass above the threshold is the binomial probability of at
    most m successes in n + 1 trials at the threshold.
    """
    out = []
    for n in range(STEP, COMPARED + 1, STEP):
        mass, m = 0.0, -1
        while mass < miss and m < n:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _prune(limits: list[int]):
    def fn(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, COMPARED) for i in (2, 3))
            alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for i, least in enumerate(limits):
                at = slice(i * STEP, (i + 1) * STEP)
                matches[alive] += (x[alive, at] == y[alive, at]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(alive)) for i in (0, 1)], names=["a", "b"])

    return fn


def shingle_set(words: bytes, size: int) -> set[tuple[bytes, ...]]:
    w = words.split(b" ")
    k = min(size, len(w))
    return set(zip(*(w[i : len(w) - k + 1 + i] for i in range(k)), strict=True))


def _exact(percent: int, size: int):
    def fn(batches):
        before, x = None, set()
        for b in batches:
            keep = []
            for i, (one, two) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if one != before:  # pairs of a hub come one after another
                    before, x = one, shingle_set(one, size)
                y = shingle_set(two, size)
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["a", "b"])

    return fn


def _with_both(pairs: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """a, b and the nodes' values of both ends."""
    one = nodes.select(F.col("d").alias("a"), F.col(value).alias("va"))
    two = nodes.select(F.col("d").alias("b"), F.col(value).alias("vb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "va", "vb")


def _links(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int, size: int, miss: float) -> DataFrame:
    limits = least_matches(percent / 100, miss)
    survivors = map_batches(_with_both(pairs, sigs, "sig"), _prune(limits), "a bigint, b bigint")
    return map_batches(_with_both(survivors, texts, "w"), _exact(percent, size), "a bigint, b bigint")


def _apart(base: DataFrame, parts: int) -> DataFrame:
    """Nodes that share a name but not a digest get names of the whole digest, until none do."""
    seed = 0
    while True:
        clashes = checkpointed(base.filter("d is not null").groupBy("d").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select(F.col("d").alias("of")), 1)
        if clashes.isEmpty():
            return base
        seed += 1
        renamed = F.when(F.col("of").isNotNull(), F.xxhash64(F.lit(seed), "g")).otherwise(F.col("d"))
        base = checkpointed(base.join(clashes, F.col("d") == F.col("of"), "left").withColumn("d", renamed).drop("of"), parts)


def _several(entries: DataFrame, label: str) -> DataFrame:
    """Entries of the buckets that hold more than one value of ``label``."""
    ends = entries.groupBy("key").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo <> hi").select("key")
    return entries.join(ends, "key")


def _parts(rows: DataFrame) -> int:
    """How many files a table on the way has at most: as many as the input has splits, or the cluster cores."""
    return max(rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism)


def _labelled(df: DataFrame, key: str, text: str, shingle: int = 5, percent: int = 80, miss: float = 1e-6, name_bits: int = 64) -> tuple[DataFrame, int]:
    """k, the text's hash th, n, d and the component c (null without words) of every row, and the number of files for tables on the way."""
    rows = pick(df, [key, text]).toDF("k", "t").withColumn("th", F.xxhash64("t"))
    parts = _parts(rows)
    base = checkpointed(map_batches(rows.select("k", "th", "t"), _describe(shingle, name_bits), "k long, th long, n long, d long, g binary, sig binary, keys array<long>"), parts)
    base = _apart(base, parts)
    keys = base.select("d", F.explode("keys").alias("key"))
    crowded = keys.groupBy("key").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo <> hi").select("key")
    entries = checkpointed(keys.join(crowded, "key").select("key", "d").distinct(), parts)
    named = entries.select("d").distinct()
    known = checkpointed(base.select("k", "th", "d", "g", "n", "sig").join(named, "d", "left_semi").groupBy("d").agg(F.min(F.struct("k", "th")).alias("row"), F.min("n").alias("n"), F.max("sig").alias("sig"), F.min("g").alias("g")), parts)
    wanted = known.select(F.col("row.k").alias("wk"), F.col("row.th").alias("wth"), "d", "g")
    found = rows.join(wanted, F.col("k").eqNullSafe(F.col("wk")) & (F.col("th") == F.col("wth"))).select("d", "g", "t")
    texts = checkpointed(map_batches(found, _normal, "d long, w binary").dropDuplicates(["d"]), parts)

    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    rank = entries.join(sizes, "key").groupBy("d").agg(F.sum("size").alias("rank"))
    leaders = entries.join(rank, "d").groupBy("key").agg(F.max(F.struct("rank", "d")).alias("m")).select("key", F.col("m.d").alias("lead"))
    stars = checkpointed(entries.join(leaders, "key").filter("lead <> d").select(F.least("d", "lead").alias("a"), F.greatest("d", "lead").alias("b")).distinct(), parts)
    links = checkpointed(_links(stars, known, texts, percent, shingle, miss), parts)
    groups = components(links)

    labelled = entries.join(groups, F.col("d") == F.col("node"), "left").select("key", "d", F.coalesce("component", "d").alias("c"))
    open_ = checkpointed(_several(labelled, "c"), parts)
    more = _rest(open_, texts, known.select("d", "n"), stars, percent, shingle, parts)
    found = checkpointed(_links(more, known, texts, percent, shingle, miss), parts)
    if not found.isEmpty():
        groups = components(links.unionByName(found))
    labelled = base.select("k", "th", "n", "d").join(groups, F.col("d") == F.col("node"), "left")
    return labelled.select("k", "th", "n", "d", F.coalesce("component", "d").alias("c")), parts


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_shingles, component_id and the digest ``set_id`` of every row; one row for each row of the table."""
    rows, parts = _labelled(df, key, text, **options)
    firsts = rows.filter("c is not null").groupBy(F.col("c").alias("of")).agg(F.min("k").alias("first"))
    out = rows.join(firsts, F.col("c") == F.col("of"), "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("first", "k").alias("component_id"), F.col("d").alias("set_id")).coalesce(parts)


def _rest(entries: DataFrame, texts: DataFrame, sizes: DataFrame, done: DataFrame, percent: int, size: int, parts: int) -> DataFrame:
    """Pairs of different components that may still be links, among the documents of open buckets.

    Sets of n and m shingles are linked if they share at least
    o = p / (100 + p) (n + m). With each set in order of how many sets hold a
    shingle, rarest first, a link's first common shingle stands at most at
    n - o + 1 in the one and m - o + 1 in the other; so only these prefixes
    are joined, with the places as a condition. Shingles of one set alone come
    first and never meet. Within a shingle, members of its most frequent
    component meet only those of others.
    """
    share = percent / (100 + percent)
    here = entries.select("d", "c").distinct()

    def explode(batches):
        hashes = Hashes()
        for b in batches:
            d, w = b.column(0).to_numpy(), b.column(1).to_pylist()
            for i in range(0, len(w), 256):
                part = [shingle_hashes(x.split(b" "), size, hashes).view(np.int64) for x in w[i : i + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(d[i : i + 256], [len(x) for x in part])), pa.array(np.concatenate(part))], names=["d", "g"])

    grams = map_batches(texts.join(here, "d", "left_semi").select("d", "w"), explode, "d long, g long")
    met = grams.groupBy("g").agg(F.count(F.lit(1)).alias("of")).filter("of > 1")
    ordered = grams.join(met, "g").groupBy("d").agg(F.sort_array(F.collect_list(F.struct("of", "g"))).alias("gs"))
    sized = ordered.join(sizes, "d").join(here, "d")
    # A partner has at least p % of the shingles, so a prefix ends at n - p % n + 1; alone stand the n - m first.
    alone = F.col("n") - F.size("gs")
    length = F.greatest(F.floor(F.col("n") * (100 - percent) / 100).cast("long") + 1 - alone, F.lit(0).cast("long"))
    rows = sized.withColumn("alone", alone).select("d", "c", "n", "alone", F.posexplode(F.slice("gs", F.lit(1), length.cast("int"))).alias("i", "x"))
    prefix = rows.select(F.col("x.g").alias("g"), "d", "c", "n", (F.col("alone") + F.col("i") + 1).alias("at"))
    main = prefix.groupBy("g", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("g").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count(F.lit(1)).alias("cs")).filter("cs > 1").select("g", "main")
    met_here = checkpointed(prefix.join(main, "g"), parts)
    x = met_here.filter("c <> main").select("g", F.col("d").alias("xd"), F.col("c").alias("xc"), F.col("n").alias("xn"), F.col("at").alias("xat"))
    y = met_here.select("g", F.col("d").alias("yd"), F.col("c").alias("yc"), F.col("n").alias("yn"), F.col("at").alias("yat"), "main")
    need = share * (F.col("xn") + F.col("yn"))
    slack = 1 + 1e-6  # for the rounding of the shares
    possible = (F.col("xc") != F.col("yc")) & ((F.col("yc") == F.col("main")) | (F.col("xd") < F.col("yd"))) & (F.col("xat") + need <= F.col("xn") + slack) & (F.col("yat") + need <= F.col("yn") + slack)
    pairs = x.join(y, "g").filter(possible).select(F.least("xd", "yd").alias("a"), F.greatest("xd", "yd").alias("b")).distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", one_row: bool = False, **options) -> DataFrame:
    """The rows of ``df``, one of each group of near-duplicates: that of the least id, null ids last, then of the least hash of the text (rows without words stay).

    Rows are told apart by id and text. Those that are equal in both stay
    together, or with ``one_row`` any one of them stays.
    """
    labelled, parts = _labelled(df, key, text, **options)
    alike = labelled.filter("c is not null").groupBy("k", "th", "c").agg(F.count(F.lit(1)).alias("copies"))
    firsts = alike.groupBy(F.col("c").alias("of")).agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "th")).alias("row"))
    judged = alike.join(firsts, F.col("c") == F.col("of")).withColumn("first", F.col("k").eqNullSafe(F.col("row.k")) & (F.col("th") == F.col("row.th")))
    apart = checkpointed(judged.filter(~F.col("first") | ((F.col("copies") > 1) & F.lit(one_row))).select("k", "th", "first"), parts)
    names = [f"c{i}" for i in range(len(df.columns))]
    at, t = (names[df.columns.index(c)] for c in (key, text))
    rows = df.toDF(*names).withColumn("h", F.xxhash64(t))
    same = F.col(at).eqNullSafe(F.col("k")) & (F.col("h") == F.col("th"))
    out = rows.join(apart, same, "left_anti")
    repeated = apart.filter("first")
    if one_row and not repeated.isEmpty():  # dropDuplicates leaves a row a task before its shuffle
        out = out.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates([at, "h"]))
    return out.drop("h").toDF(*df.columns)
