"""Tables that change by compare-and-swap, and membership edits that commit to one.

A version of a table is one small file that names, for each bucket of rows, the
folder that holds it. A commit writes the buckets that it changes to a new
folder and then creates the next version's file; creating a file that is there
fails (on file systems whose rename doesn't overwrite, such as a cluster's), so
of two commits from one version one alone gets through, and readers see a whole
version or the one before. Nothing is written over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.graph import checkpointed

MEMBERSHIP = "draft_id string, sample_id string, split string, valid_from long, valid_to long"


class Versioned:
    """A table of ``buckets`` by the hash of ``key`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.hadoop = spark._jvm.org.apache.hadoop

    def _at(self, name: str):
        path = self.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        path, fs = self._at("versions")
        return max((int(f.getPath().getName()) for f in fs.listStatus(path)), default=0) if fs.exists(path) else 0

    def folders(self, version: int) -> dict[int, str]:
        if version == 0:
            return {}
        text = self.spark.read.text(f"{self.path}/versions/{version}", wholetext=True).first()[0]
        return {int(b): f for b, f in json.loads(text).items()}

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (default: the latest), of some buckets or all."""
        folders = self.folders(self.version() if version is None else version)
        paths = [f"{self.path}/rows/{f}/b={b}" for b, f in sorted(folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def commit(self, version: int, rows: DataFrame, touched: list[int]) -> bool:
        """Make the version after ``version``, in which the buckets ``touched`` hold ``rows`` and the others what they held; False, with nothing changed, if there is one already."""
        folder = uuid.uuid4().hex
        rows.withColumn("b", self.bucket()).write.partitionBy("b").parquet(f"{self.path}/rows/{folder}")
        made, fs = self._at(f"rows/{folder}")
        there = {int(s.getPath().getName()[2:]) for s in fs.listStatus(made) if s.getPath().getName().startswith("b=")}
        folders = {b: f for b, f in self.folders(version).items() if b not in touched} | {b: folder for b in touched if b in there}
        path, fs = self._at(f"versions/{version + 1}")
        draft, _ = self._at(f"drafts/{folder}")
        # The file is whole before it gets its name: a rename that doesn't overwrite is the swap.
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        fs.mkdirs(path.getParent())
        if not fs.exists(path) and fs.rename(draft, path):
            return True
        fs.delete(draft, False)
        fs.delete(made, True)
        return False


def edit_outcomes(edits: DataFrame, drafts: DataFrame) -> DataFrame:
    """draft_id, revision and outcome of batches of edits (draft_id, expected_revision, sample_id, split), one batch a draft, against the drafts' revisions.

    ``repeated``: a sample stands twice in the batch, or the edits expect
    different revisions; ``stale``: the draft has another revision than the
    expected one (0: no draft yet); else ``applied``.
    """
    by = edits.groupBy("draft_id").agg(F.min("expected_revision").alias("expected"), F.max("expected_revision").alias("most"), (F.count(F.lit(1)) > F.count_distinct("sample_id")).alias("twice"))
    now = drafts.select(F.col("draft_id").alias("__d"), F.col("revision").alias("__r"))
    j = by.join(now, F.col("draft_id") == F.col("__d"), "left")
    current = F.coalesce("__r", F.lit(0).cast("long"))
    outcome = F.when(F.col("twice") | (F.col("expected") != F.col("most")), "repeated").when(F.coalesce(F.col("expected") != current, F.lit(True)), "stale").otherwise("applied")
    return j.select("draft_id", outcome.alias("outcome"), F.when(outcome == "applied", current + 1).otherwise(current).alias("revision"))


def edited(membership: DataFrame, edits: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The membership once the applied batches are in it: a member whose split changes, or that is removed (null split), has its open interval closed at the draft's new revision, and a new one opened there. What is so already, and removing what isn't a member, changes nothing."""
    ok = outcomes.filter("outcome = 'applied'").select("draft_id", F.col("revision").alias("__at"))
    e = edits.join(ok, "draft_id").select(F.col("draft_id").alias("__d"), F.col("sample_id").alias("__s"), F.col("split").alias("__split"), "__at")
    open_ = F.col("valid_to").isNull()
    j = membership.join(e, (F.col("draft_id") == F.col("__d")) & (F.col("sample_id") == F.col("__s")), "full")
    has = F.max(F.when(F.col("draft_id").isNotNull() & open_, F.struct("split"))).over(Window.partitionBy(F.coalesce("draft_id", "__d"), F.coalesce("sample_id", "__s")))
    rows = j.withColumn("__now", has["split"]).withColumn("__n", F.row_number().over(Window.partitionBy(F.coalesce("draft_id", "__d"), F.coalesce("sample_id", "__s")).orderBy(F.desc("valid_from"))))
    changes = F.col("__at").isNotNull() & ~F.col("__split").eqNullSafe(F.col("__now"))
    kept = F.when(F.col("draft_id").isNotNull(), F.array(F.struct("draft_id", "sample_id", "split", "valid_from", F.when(changes & open_, F.col("__at")).otherwise(F.col("valid_to")).alias("valid_to"))))
    new = F.when(changes & (F.col("__n") == 1) & F.col("__split").isNotNull(), F.array(F.struct(F.col("__d").alias("draft_id"), F.col("__s").alias("sample_id"), F.col("__split").alias("split"), F.col("__at").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))))
    none = F.array().cast(f"array<struct<{MEMBERSHIP.replace(' ', ':').replace(',:', ',')}>>")
    return rows.select(F.inline(F.concat(F.coalesce(kept, none), F.coalesce(new, none))))


def drafts_of(table: DataFrame) -> DataFrame:
    """draft_id and revision: the rows without a sample."""
    return table.filter("sample_id is null").select("draft_id", F.col("valid_from").alias("revision"))


def members_of(table: DataFrame) -> DataFrame:
    """The intervals of membership: the rows with a sample."""
    return table.filter("sample_id is not null")


def apply_edits(table: Versioned, edits: DataFrame) -> DataFrame:
    """Commit batches of edits to a table of ``MEMBERSHIP`` and return each draft's outcome and revision.

    Drafts' revisions and their members' intervals are rows of one table, so
    one swap changes both. If another commit gets in between, the batches that
    would have been applied are ``raced`` and nothing changes. Only the buckets
    of drafts with an applied batch are read and written.
    """
    at = table.version()
    edits = checkpointed(edits.filter("draft_id is not null and sample_id is not null"))
    outcomes = checkpointed(edit_outcomes(edits, drafts_of(table.read(at))))
    applied = outcomes.filter("outcome = 'applied'")
    touched = [r["b"] for r in applied.select(table.bucket().alias("b")).distinct().collect()]  # at most ``buckets``
    if not touched:
        return outcomes
    old = table.read(at, touched)
    others = drafts_of(old).join(applied.select("draft_id"), "draft_id", "left_anti")
    revisions = others.unionByName(applied.select("draft_id", "revision")).select("draft_id", F.lit(None).cast("string").alias("sample_id"), F.lit(None).cast("string").alias("split"), F.col("revision").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    if table.commit(at, edited(members_of(old), edits, outcomes).unionByName(revisions), touched):
        return outcomes
    return outcomes.withColumn("outcome", F.when(F.col("outcome") == "applied", "raced").otherwise(F.col("outcome")))
