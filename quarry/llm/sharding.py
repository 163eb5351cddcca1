"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``virtual_nodes`` points on a ring of 64-bit hashes; a row
belongs to the arc before the next point clockwise. A shard takes at most its
capacity; keys that find it full continue clockwise to the next point whose
shard has room. With ``slack`` 0 capacities are the floor or ceiling of the
mean, so row counts differ by one at most (law ``rows``); with more slack fewer
keys move when the number of shards changes.

Only numbers of rows by arc (``n_shards * virtual_nodes``, a parameter) reach
the driver; they fix how many rows of each arc stay and where the rest go. A
row's rank within its arc then gives both its shard and its slot, so no shard
is ever one task: the only shuffle is by arc, of keys without texts. An arc is
split into ``cells`` by the low bits of the hash, and a row that repeats
(equal key and text) is spread by a hash of both, so ranks are counted in
small groups; ranks among fully equal rows are interchangeable.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import pick

#: Hashes are looked up by their top ``64 - BITS`` bits.
BITS = 53


def ring(spark: SparkSession, n_shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """The points in order, each with its shard; positions come from the same hash as the keys'."""
    points = spark.range(n_shards * virtual_nodes).select((F.col("id") % n_shards).cast("int").alias("shard"), F.floor(F.col("id") / n_shards).alias("node"))
    rows = points.select(F.xxhash64(F.lit("point"), "shard", "node").alias("at"), "shard").collect()
    return sorted((r["at"], r["shard"]) for r in rows)


def _starts(spark: SparkSession, at: list[int]) -> DataFrame:
    """For each value of the top bits of a hash: the points before it, and the points with the same top bits (``1 << 64 - BITS`` rows)."""
    tops = range(-(1 << (63 - BITS)), 1 << (63 - BITS))
    rows = [(t, bisect_left(at, t << BITS), at[bisect_left(at, t << BITS) : bisect_left(at, (t + 1) << BITS)]) for t in tops]
    return spark.createDataFrame(rows, "top bigint, first int, points array<bigint>")


def place(arcs: list[int], owners: list[int], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc, in ring order, the runs (shard, rows) that its rows are dealt to.

    First every shard takes from its own arcs, in ring order, what it has room
    for; then the overflow goes round clockwise, first come first served.
    """
    room = list(capacity)
    runs: list[list[tuple[int, int]]] = [[] for _ in arcs]
    over: list[tuple[int, int]] = []
    for i, (n, s) in enumerate(zip(arcs, owners, strict=True)):
        own = min(n, room[s])
        room[s] -= own
        if own:
            runs[i].append((s, own))
        arcs[i] = n - own
    for turn in range(2 * len(arcs)):
        i = turn % len(arcs)
        if turn < len(arcs) and arcs[i]:
            over.append((i, arcs[i]))
        s = owners[i]
        while over and room[s]:
            frm, n = over[0]
            take = min(n, room[s])
            room[s] -= take
            runs[frm].append((s, take))
            over[0] = (frm, n - take)
            if take == n:
                over.pop(0)
    if over:
        raise ValueError("the shards' capacities don't hold all rows")
    return runs


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 24, virtual_nodes: int = 64, slack: float = 0.0, cells: int = 4) -> DataFrame:
    """key, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row.

    Size: UTF-8 bytes of the text plus 8. A row's place on the ring comes from
    its key and its text's size and crc32, so rows that share a key, or have
    none, are spread; rows that repeat whole share a place. Null texts have no
    bytes and the crc32 of the empty text. An empty table gives no rows.
    """
    spark = df.sparkSession
    points = ring(spark, n_shards, virtual_nodes)
    at = [p[0] for p in points]
    taken = pick(df, [key, text]).toDF("k", "t")
    hashed = taken.select("k", (F.octet_length(F.coalesce("t", F.lit(""))) + 8).cast("long").alias("size"), F.crc32(F.coalesce("t", F.lit("")).cast("binary")).alias("crc")).withColumn("h", F.xxhash64(F.lit("key"), "k", "crc", "size"))
    # The first point at or after the hash: points of the same top bits are few, so those buckets are joined and searched.
    hashed = hashed.join(F.broadcast(_starts(spark, at)), F.shiftright("h", BITS) == F.col("top")).withColumn("lo", F.col("first") + F.size(F.filter("points", lambda x: x < F.col("h"))))
    spread = F.pmod(F.xxhash64(F.lit("cell"), "k", "crc", "size"), F.lit(cells)).cast("int")
    dealt = hashed.select("k", "size", "crc", "h", (F.col("lo") % len(at)).cast("int").alias("arc"), spread.alias("cell"))
    counts = {(r["arc"], r["cell"]): r["n"] for r in dealt.groupBy("arc", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    arcs = [sum(counts.get((i, c), 0) for c in range(cells)) for i in range(len(at))]
    rows = sum(arcs)
    if slack:
        capacity = [-int(-(1 + slack) * rows // n_shards)] * n_shards
    else:
        capacity = [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]
    runs = place(arcs, [p[1] for p in points], capacity)
    filled, pieces = [0] * n_shards, []
    for arc, dealt_runs in enumerate(runs):
        # Cells of an arc follow each other; a run of the arc is cut where a cell ends.
        cell, left, first = 0, counts.get((arc, 0), 0), 0
        for s, n in dealt_runs:
            while n:
                while not left:
                    cell, first = cell + 1, 0
                    left = counts.get((arc, cell), 0)
                take = min(n, left)
                pieces.append((arc, cell, first, first + take, s, filled[s] - first))
                filled[s] += take
                first, left, n = first + take, left - take, n - take
    schema = "arc int, cell int, lo long, hi long, shard int, shift long"
    # At most a piece for each arc's cell and each time a shard fills up: a bound set by the parameters.
    plan = F.broadcast(spark.createDataFrame(pieces, schema))
    order = Window.partitionBy("arc", "cell").orderBy("h", "k", "crc", "size")
    ranked = dealt.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    placed = ranked.join(plan, (ranked.arc == plan.arc) & (ranked.cell == plan.cell) & (ranked["rank"] >= plan.lo) & (ranked["rank"] < plan.hi))
    return placed.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("rank") + F.col("shift")).alias("slot"))


def owner(points: list[tuple[int, int]], h: int) -> int:
    """The shard whose point follows ``h`` clockwise (the unbounded ring; for tests)."""
    i = bisect_left([p[0] for p in points], h)
    return points[i % len(points)][1]
