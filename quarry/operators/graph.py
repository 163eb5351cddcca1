"""Connected components of an edge table.

Alternating large-star and small-star steps: each is one aggregation by node
and one ordinary join, so no component and no neighbourhood is ever collected;
a hub's edges are split like any skewed join key. Edges shrink to stars that
point to the least node in a logarithmic number of rounds.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(sc: SparkContext) -> str:
    """The folder that all executors share: that of ``spark.checkpoint.dir``, or on a local master one in the temporary folder."""
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "quarry-checkpoints")


def checkpointed(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder.

    ``spark.checkpoint.dir`` names that folder; where it is unset a local
    master gets one of our own, a cluster an error, for a machine's folder
    isn't shared. At most ``parts`` files are written.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(sc))
    return (df if parts is None else df.coalesce(parts)).checkpoint()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = down.join(least, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


#: Edges of one file of a round's edge table.
EDGES = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node) for every node of an edge; null ends and loops are no edges."""
    now = checkpointed(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b").distinct())
    mark = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    seen = mark(now)
    while seen["n"]:
        now = checkpointed(_small(_large(now)), seen["n"] // EDGES + 1)  # rounds don't add edges
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
