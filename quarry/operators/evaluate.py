"""Scores of predicted against expected documents."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.llm.common import map_batches

# Workers get this module's functions with their task: they needn't have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _shared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many tokens two texts share, repeats counted, and how many both have: f1, of batches of id and both texts."""
    for b in rows:
        f1 = []
        for p, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            p, e = p.split(), e.split()
            n = len(p) + len(e)
            # 2PR / (P + R) with P = both / p and R = both / e is 2 both / (p + e).
            f1.append(2 * (Counter(p) & Counter(e)).total() / n if n else 1.0)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f1, pa.float64())], names=["id", "f1"])


def token_f1(cases: DataFrame) -> DataFrame:
    """id and f1 of the token multisets of ``predicted`` and ``expected``; both empty: 1, one empty: 0. Both texts stand in one row, so nothing is exchanged."""
    side = lambda c: tx.token_text(F.coalesce(F.col(c), F.lit(""))).alias(c)
    rows = cases.select("id", side("predicted"), side("expected"))
    return map_batches(rows, _shared, f"id {rows.schema['id'].dataType.simpleString()}, f1 double", keeps=True).select("id", F.round("f1", 12).alias("f1"))


def averages(scores: DataFrame) -> DataFrame:
    """Mean scores over all cases: those without a prediction count as 0, no cases at all too."""
    mean = lambda c: F.coalesce(F.round(F.sum(F.coalesce(c, F.lit(0.0)).cast("decimal(20,10)")).cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0)), 9), F.lit(0.0))
    return scores.agg(F.count(F.lit(1)).alias("cases"), mean("structure").alias("structure"), mean("similarity").alias("similarity"))


def evaluation_run(fixtures: DataFrame, predictions: DataFrame) -> DataFrame:
    """Scores of fixtures (id, expected) by predictions (id, markdown, status): id, structure, similarity, note; what isn't completed scores 0."""
    done = predictions.filter("status = 'completed' and markdown is not null").select("id", F.col("markdown").alias("predicted"))
    failed = predictions.select(F.col("id").alias("__f"), F.col("status").alias("__status"))
    cases = fixtures.join(done, "id", "left").select("id", "expected", "predicted")
    scores = cases.join(token_f1(cases), "id").join(failed, F.col("id") == F.col("__f"), "left")
    ok = F.col("predicted").isNotNull()
    return scores.select("id", F.when(ok, tx.structure_score(F.col("predicted"))).otherwise(0.0).alias("structure"), F.when(ok, F.col("f1")).otherwise(0.0).alias("similarity"), F.when(~ok, F.coalesce("__status", F.lit("missing"))).alias("note"))
