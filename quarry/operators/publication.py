"""Versions: members with their artifacts, readiness, lineage, manifests, collection of artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.canonical import canonical_object, digest

#: Fixed value: the format of manifests.
MANIFEST_FORMAT = "manifest.v1"


def version_members(members: DataFrame, revisions: DataFrame, samples: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Members with revision and sample, and their artifact if one is bound by digest."""
    m, r, s, a = members.alias("m"), revisions.alias("r"), samples.alias("s"), artifacts.alias("a")
    j = m.join(r, (F.col("m.sample_id") == F.col("r.sample_id")) & (F.col("m.revision") == F.col("r.revision"))).join(s, F.col("r.sample_id") == F.col("s.id")).join(a, F.col("r.sha256") == F.col("a.artifact_id"), "left")
    return j.select(F.col("m.sample_id"), F.col("r.id").alias("revision_id"), F.col("m.split"), F.col("s.source_key"), F.col("r.sha256"), F.col("r.size_bytes"), F.col("a.artifact_id"), F.col("a.verified"), F.col("a.collection_state"))


def readiness(members: DataFrame, expected: int) -> DataFrame:
    """One row: problems that keep a version from being published."""
    unready = F.col("artifact_id").isNull() | ~F.coalesce("verified", F.lit(False)) | (F.coalesce("collection_state", F.lit("")) != "active")
    return members.agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("artifact_id").isNull()).alias("unbound"), F.count_if(unready).alias("unready")).withColumn("ready", (F.col("members") == expected) & (F.col("unready") == 0))


def verification_work(members: DataFrame) -> DataFrame:
    """Each distinct artifact of the members once."""
    return members.filter("artifact_id is not null").select("artifact_id", "size_bytes").dropDuplicates(["artifact_id"])


#: The kinds of lineage entries, in order.
LINEAGE = ("sample", "revision", "content", "artifact", "split", "annotation", "transformation")


def lineage(members: DataFrame) -> DataFrame:
    """Seven entries for each member, present or absent."""
    ids = {"sample": "sample_id", "revision": "revision_id", "content": "sha256", "artifact": "artifact_id", "split": "split"}
    entry = lambda i, kind: F.struct(F.lit(i).cast("long").alias("position"), F.lit(kind).alias("kind"), (F.col(ids[kind]) if kind in ids else F.lit(None)).cast("string").alias("entry_id"))
    rows = members.select("sample_id", F.inline(F.array(*[entry(i, k) for i, k in enumerate(LINEAGE)])))
    return rows.withColumn("status", F.when(F.col("entry_id").isNull(), "absent").otherwise("present"))


def lineage_status(entries: DataFrame) -> DataFrame:
    return entries.groupBy("sample_id").agg(F.count_if(F.col("status") == "absent").alias("absent"), F.when(F.bool_or(F.col("status") == "absent"), "partial").otherwise("complete").alias("lineage"))


def manifest_members(members: DataFrame) -> DataFrame:
    """Each member's canonical JSON and its digest."""
    artifact = canonical_object({"id": F.col("artifact_id"), "size_bytes": F.col("size_bytes")})
    text = canonical_object({"artifact": artifact, "revision_id": F.col("revision_id"), "sample_id": F.col("sample_id"), "split": F.col("split")}, raw={"artifact"})
    return members.select("sample_id", text.alias("member")).withColumn("digest", digest(F.col("member")))


def manifest_lines(members: DataFrame, header: dict) -> DataFrame:
    """Lines of a manifest in order: the header, then the members by sample id, so that ``write.text`` keeps them.

    A global sort by range partitions; the header's key is before all ids.
    """
    import json

    head = json.dumps({**header, "format": MANIFEST_FORMAT}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    first = members.sparkSession.range(1).select(F.lit("").alias("sample_id"), F.lit(head).alias("value"))
    return first.unionByName(manifest_members(members).select("sample_id", F.col("member").alias("value"))).orderBy("sample_id")


def order_violations(members: DataFrame, scope: str, key: str = "sample_id", order: str = "position") -> DataFrame:
    """Rows of a listing whose key doesn't ascend strictly."""
    w = Window.partitionBy(scope).orderBy(order)
    return members.withColumn("before", F.lag(key).over(w)).filter(F.col("before") >= F.col(key))


def collectable(artifacts: DataFrame, retained: DataFrame, bound: DataFrame, ingesting: DataFrame, locations: DataFrame, most: int = 100) -> DataFrame:
    """Artifacts that nothing retains, binds or ingests, with a known and bounded number of placements."""
    free = artifacts
    for held in (retained, bound, ingesting):
        free = free.join(held.select("artifact_id"), "artifact_id", "left_anti")
    placed = locations.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("placements"))
    return free.join(placed, "artifact_id", "left").select("artifact_id", F.coalesce("placements", F.lit(0).cast("long")).alias("placements")).filter(F.col("placements") <= most)


def accepted_batch(batch: DataFrame, sealed: DataFrame) -> DataFrame:
    """Rows of a prepared batch that differ from the sealed ones, and sealed ones it lacks, repeats counted: none if it may be accepted.

    Counts of equal rows are joined. ``exceptAll`` unites both sides, and Spark 4.1
    takes the union of two merge joins as dealt by their keys without another
    exchange, so that equal rows of both sides may stand in different partitions.
    """
    columns = batch.columns
    counted = lambda df, n: df.groupBy(*columns).agg(F.count(F.lit(1)).alias(n))
    s = counted(sealed.select(*columns), "__sealed").withColumnsRenamed({c: f"__{c}" for c in columns})
    met = counted(batch, "__given").join(s, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]), "full")
    more = F.coalesce("__given", F.lit(0)) - F.coalesce("__sealed", F.lit(0))
    problem = F.when(more > 0, "not_sealed").otherwise("lacking")
    each = F.explode(F.array_repeat(problem, F.abs(more).cast("int"))).alias("problem")
    return met.filter(more != 0).select(*[F.coalesce(c, f"__{c}").alias(c) for c in columns], each)


def allocate(requests: DataFrame, groups: DataFrame) -> DataFrame:
    """Outcomes of manifest allocations (request_id, group_id, epoch, sha256, size_bytes) for groups (group_id, epoch, prepared, expected, manifest_sha256, manifest_size).

    All members must be prepared; a request of an old attempt is stale; of
    several for a group the first allocates, equal ones repeat it, others conflict.
    """
    j = requests.join(groups.select(F.col("group_id").alias("__g"), F.col("epoch").alias("__epoch"), "prepared", "expected", "manifest_sha256", "manifest_size"), F.col("group_id") == F.col("__g"), "left")
    why = F.when(F.col("__g").isNull(), "not_found").when(F.col("epoch") != F.col("__epoch"), "stale").when(F.col("prepared") != F.col("expected"), "incomplete")
    rows = j.withColumn("why", why)
    w = Window.partitionBy("group_id", F.col("why").isNull()).orderBy("request_id")
    rows = rows.withColumns({"sha": F.coalesce("manifest_sha256", F.first("sha256").over(w)), "size": F.coalesce("manifest_size", F.first("size_bytes").over(w)), "n": F.row_number().over(w)})
    same = (F.col("sha256") == F.col("sha")) & (F.col("size_bytes") == F.col("size"))
    first = F.col("manifest_sha256").isNull() & (F.col("n") == 1)
    return rows.select("request_id", "group_id", F.coalesce("why", F.when(first, "allocated").when(same, "repeated").otherwise("conflict")).alias("outcome"))


#: Fixed value: the most placements of an artifact that one deletion takes.
MOST_PLACEMENTS = 100


def deletions(artifacts: DataFrame, protections: list[DataFrame], locations: DataFrame, store: str) -> DataFrame:
    """artifact_id, placements, outcome and collection_state of deleting artifacts (artifact_id, collection_state) by a worker of one store.

    What a protection names (tables with artifact_id) stays. The worker has to
    be qualified for every placement (locations: artifact_id, id, store_id,
    outcome) and for at most ``MOST_PLACEMENTS``; else nothing is claimed. A
    claimed artifact is ``deleting`` until every placement has been seen to be
    missing, which may be asked again: deleting twice changes nothing.
    """
    held = reduce(DataFrame.unionByName, [p.select(F.col("artifact_id").alias("__held")) for p in protections]).distinct()
    by = locations.groupBy(F.col("artifact_id").alias("__a")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("store_id").eqNullSafe(F.lit(store))).alias("others"), F.count_if(F.col("outcome").eqNullSafe(F.lit("missing"))).alias("gone"))
    j = artifacts.join(held, F.col("artifact_id") == F.col("__held"), "left").join(by, F.col("artifact_id") == F.col("__a"), "left")
    n, others, gone = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "others", "gone"))
    outcome = (
        F.when(F.col("collection_state") == "deleted", "unchanged")
        .when(F.col("__held").isNotNull(), "protected")
        .when((n > MOST_PLACEMENTS) | (others > 0), "unqualified")
        .when(gone < n, "unconfirmed")
        .otherwise("deleted")
    )
    state = F.when(outcome == "unconfirmed", "deleting").when(outcome == "deleted", "deleted").otherwise(F.col("collection_state"))
    return j.select("artifact_id", n.alias("placements"), outcome.alias("outcome"), state.alias("collection_state"))
