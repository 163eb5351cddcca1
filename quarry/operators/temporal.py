"""Membership by revision intervals [valid_from, valid_to), open where valid_to is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds(revision: Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    return (F.col(valid_from) <= revision) & (F.col(valid_to).isNull() | (F.col(valid_to) > revision))


def as_of(membership: DataFrame, revision: int, draft: str | None = None) -> DataFrame:
    rows = membership if draft is None else membership.filter(F.col("draft_id") == draft)
    return rows.filter(holds(F.lit(revision)))


def as_of_many(membership: DataFrame, revisions: DataFrame) -> DataFrame:
    """Members at each (draft_id, revision): an equi-join by draft with the interval as its residual."""
    r = revisions.select(F.col("draft_id").alias("__d"), F.col("revision").alias("at_revision"))
    return membership.join(r, (F.col("draft_id") == F.col("__d")) & holds(F.col("at_revision"))).drop("__d")


def build_intervals(changes: DataFrame) -> DataFrame:
    """Intervals from a change log (draft_id, sample_id, revision, split; null split: removed).

    A change equal to the state before it is none; each interval ends where the next change begins.
    """
    w = Window.partitionBy("draft_id", "sample_id").orderBy("revision")
    real = changes.withColumn("before", F.lag("split").over(w)).filter(~F.col("split").eqNullSafe(F.col("before")))
    spans = real.withColumn("valid_to", F.lead("revision").over(w))
    return spans.filter(F.col("split").isNotNull()).select("draft_id", "sample_id", "split", F.col("revision").alias("valid_from"), "valid_to")


def interval_violations(membership: DataFrame) -> DataFrame:
    """Rows that overlap the next one of their key, or end before they begin."""
    w = Window.partitionBy("draft_id", "sample_id").orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    top = (1 << 63) - 1
    checked = membership.withColumn("next_from", F.lead("valid_from").over(w))
    overlaps = F.col("next_from") < F.coalesce("valid_to", F.lit(top))
    empty = F.col("valid_to") <= F.col("valid_from")
    return checked.select("draft_id", "sample_id", "valid_from", "valid_to", F.when(F.coalesce(empty, F.lit(False)), "empty").when(F.coalesce(overlaps, F.lit(False)), "overlap").alias("violation")).filter("violation is not null")


def page_numbers(rows: DataFrame, scope: str, key: str, size: int) -> DataFrame:
    """Rows with the number of the page they fall on when copied in order of ``key``."""
    w = Window.partitionBy(scope).orderBy(key)
    return rows.withColumn("page", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def availability_fold(commands: DataFrame) -> DataFrame:
    """States after each command (version, seq, action: archive, unarchive, deprecate, activate).

    Archiving remembers the state before it; while archived, deprecate and
    activate are refused. So the state under the archive is the last one set
    by a command that was not refused, and needs one window, no loop: the
    archive flag is that of the last archive or unarchive.
    """
    w = Window.partitionBy("version").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("version").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    flag = F.when(F.col("action") == "archive", True).when(F.col("action") == "unarchive", False)
    rows = commands.withColumn("archived", F.coalesce(F.last(flag, True).over(w), F.lit(False))).withColumn("was", F.coalesce(F.last(flag, True).over(before), F.lit(False)))
    sets = F.when(~F.col("was") & (F.col("action") == "deprecate"), "deprecated").when(~F.col("was") & (F.col("action") == "activate"), "active")
    rows = rows.withColumn("under", F.coalesce(F.last(sets, True).over(w), F.lit("active"))).withColumn("under_before", F.coalesce(F.last(sets, True).over(before), F.lit("active")))
    state = F.when(F.col("archived"), "archived").otherwise(F.col("under"))
    old = F.when(F.col("was"), "archived").otherwise(F.col("under_before"))
    refused = F.col("was") & F.col("action").isin("deprecate", "activate")
    rows = rows.withColumn("state", state).withColumn("changed", (state != old).cast("long"))
    return rows.select("version", "seq", "action", "state", refused.alias("refused"), F.sum("changed").over(w).alias("revision"))


def revision_outcomes(commands: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """Append of a next revision: the expected one must be the largest so far (0 if none)."""
    top = current.groupBy(*by).agg(F.max("revision").alias("__max"))
    out = commands.join(top, by, "left").withColumn("__max", F.coalesce("__max", F.lit(0).cast("long")))
    ok = F.col("expected_revision") == F.col("__max")
    return out.select(*commands.columns, F.when(ok, F.col("__max") + 1).alias("revision"), F.when(ok, "appended").otherwise("stale").alias("outcome"))


def carried_bindings(revisions: DataFrame) -> DataFrame:
    """Whether a revision's artifact binding is carried over: its content is that of the revision before."""
    w = Window.partitionBy("sample_id").orderBy("revision")
    same = (F.lag("sha256").over(w) == F.col("sha256")) & (F.lag("size_bytes").over(w) == F.col("size_bytes"))
    return revisions.select("sample_id", "revision", F.coalesce(same, F.lit(False)).alias("carried"))
