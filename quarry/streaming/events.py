"""The event log as streams: the same operators over ``readStream`` frames.

Each function takes and returns DataFrames; sources, sinks, triggers and
checkpoint places belong to the caller. The log has no event time of its own:
watermarks here only bound the state that is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.events import KNOWN, TRANSITIONS

LOG = "operation_id long, event_id long, ts timestamp, event_type string"
STATE = "state string, applied long, refused long, last long"


def inbox(events: DataFrame, keep: str = "7 days") -> DataFrame:
    """Events once each within ``keep``, with what the inbox makes of them; unknown kinds are quarantined, not dropped."""
    once = events.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["event_id"])
    return once.withColumn("outcome", F.when(~F.coalesce(F.col("event_type").isin(*KNOWN), F.lit(False)), "quarantined").when(F.col("event_type") != "queued", "ignored").otherwise("applied"))


def checkpoints(outcomes: DataFrame) -> DataFrame:
    """The largest event of each operation so far (update or complete mode)."""
    return outcomes.filter("outcome <> 'quarantined'").groupBy("operation_id").agg(F.max("event_id").alias("event_id"))


def kind_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """An extension: counts by kind in windows of event time, late events up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def next_state(state: str, kind: str) -> str | None:
    sources, target = TRANSITIONS.get(kind, ((), ""))
    return target if state in sources else None


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    now, applied, refused, last = state.get if state.exists else ("new", 0, 0, -1)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    for event_id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
        to = next_state(now, kind)
        now, applied, refused, last = to or now, applied + (to is not None), refused + (to is None), max(last, int(event_id))
    state.update((now, applied, refused, last))
    yield pd.DataFrame({"operation_id": [key[0]], "state": [now], "applied": [applied], "refused": [refused]})


def fold_states(events: DataFrame) -> DataFrame:
    """Each operation's state after every batch (update mode): the automaton with its state kept by key.

    The state is four values a key, whatever the length of the log; within a
    batch events go in order of time and id.
    """
    return events.groupBy("operation_id").applyInPandasWithState(_fold, "operation_id long, state string, applied long, refused long", STATE, "update", "NoTimeout")


def _folder(spark, path: str):
    """The path and its file system, as the cluster's own classes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark, path: str) -> dict[int, list[int]]:
    """Of each bucket the versions there are, from the names of folders (``v=<batch>/b=<bucket>``)."""
    at, fs = _folder(spark, path)
    out: dict[int, list[int]] = {}
    for v in fs.listStatus(at) if fs.exists(at) else ():
        name = v.getPath().getName()
        if name.startswith("v="):
            for b in fs.listStatus(v.getPath()):
                if b.getPath().getName().startswith("b="):
                    out.setdefault(int(b.getPath().getName()[2:]), []).append(int(name[2:]))
    return {b: sorted(v) for b, v in out.items()}


def read_merged(spark, path: str, schema: str, below: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The table that ``merge_into`` keeps: of each bucket the latest version (before batch ``below``)."""
    latest = {b: [x for x in v if below is None or x < below] for b, v in _versions(spark, path).items() if buckets is None or b in buckets}
    paths = [f"{path}/v={v[-1]}/b={b}" for b, v in sorted(latest.items()) if v]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_into(path: str, key: str, order: str, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the last row of each key, by ``order``, in a table of buckets under ``path``.

    A batch is reduced to one row a key before anything is joined. Only the
    buckets that it touches are written, as ``v=<batch>/b=<bucket>``; a batch
    that is run again writes the same again, so delivery at least once has an
    effect once. A row of an older order than the one that is kept changes
    nothing. Of each bucket two versions stay. Rows with a null key are one key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, names = batch.sparkSession, batch.columns
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)

        def last(df: DataFrame) -> DataFrame:
            return df.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*names), F.col(order)).alias("x")).select("x.*")

        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        new = last(batch).withColumn("b", bucket).persist()
        try:
            touched = [r["b"] for r in new.select("b").distinct().collect()]  # at most ``buckets``
            if not touched:
                return
            old = read_merged(spark, path, schema, batch_id, touched)
            whole = last(old.unionByName(new.select(*names))).withColumn("b", bucket)
            whole.write.mode("overwrite").partitionBy("b").parquet(f"{path}/v={batch_id}")
        finally:
            new.unpersist()
        for b, versions in _versions(spark, path).items():
            for v in versions[:-2]:
                at, fs = _folder(spark, f"{path}/v={v}/b={b}")
                fs.delete(at, True)

    return write


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Job events appended to a table by run, all there are now; started again it goes on where it stopped. ``ordered_log`` reads them in order."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ordered_log(log: DataFrame) -> DataFrame:
    """Each operation's events with their number in order of time and id."""
    return log.withColumn("n", F.row_number().over(Window.partitionBy("operation_id").orderBy("ts", "event_id")).cast("long"))


def dispatch_into(path: str, current: DataFrame) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each batch of outbox events is claimed, put through the inbox and acknowledged, and its outcomes are written to ``path/batch=<n>``, once however often the batch is run."""

    def tick(batch: DataFrame, batch_id: int) -> None:
        seen = batch.dropDuplicates(["event_id"]).join(current.select("operation_id", F.col("epoch").alias("now_epoch")), "operation_id", "left")
        known = F.coalesce(F.col("event_type").isin(*KNOWN), F.lit(False)) & F.col("now_epoch").isNotNull()
        outcome = F.when(~known, "quarantined").when(F.col("event_type") != "queued", "ignored").when(F.col("epoch") != F.col("now_epoch"), "stale").otherwise("applied")
        seen.select("event_id", "operation_id", outcome.alias("outcome"), (outcome == "applied").alias("submitted")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return tick
