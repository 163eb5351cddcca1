"""Leakage-safe truth partitions: grouping keys, connected components, validation split, leakage and reuse checks."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.canonical import quoted
from quarry.operators.graph import components


# Workers get this module's functions with their task: they needn't have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def group_key(group_id: Column, sample_id: Column) -> Column:
    """``group:`` and the group, or ``sample:`` and the id where there is none; blank or too long groups give null."""
    bad = (F.length(F.trim(group_id)) == 0) | (F.length(group_id) > 200)
    return F.when(group_id.isNull(), F.concat(F.lit("sample:"), sample_id)).when(~bad, F.concat(F.lit("group:"), group_id))


def leakage(members: DataFrame) -> DataFrame:
    """Groups and contents that stand in more than one partition."""
    keys = members.select("partition", F.inline(F.array(F.struct(F.lit("group").alias("kind"), F.col("group").alias("value")), F.struct(F.lit("content").alias("kind"), F.col("content_digest").alias("value")))))
    return keys.distinct().groupBy("kind", "value").agg(F.count(F.lit(1)).alias("partitions")).filter("partitions > 1")


def reused_test(current: DataFrame, history: DataFrame) -> DataFrame:
    """Members of train or validation whose content or group has ever been tested."""
    tested = history.filter(F.col("partition") == "test")
    learn = current.filter(F.col("partition").isin("train", "validation"))
    by = lambda c: learn.join(tested.select(c).distinct(), c, "left_semi").select(*current.columns)
    return by("content_digest").unionByName(by("group")).distinct()


def fresh_confirmation(current: DataFrame, history: DataFrame) -> DataFrame:
    """One row: whether the test part is not empty and shares no group or content with anything known."""
    test = current.filter(F.col("partition") == "test")
    known = test
    for c in ("content_digest", "group"):
        known = known.join(history.select(c).distinct(), c, "left_anti")
    n, fresh = test.agg(F.count(F.lit(1)).alias("tests")), known.agg(F.count(F.lit(1)).alias("fresh"))
    return n.select("tests", fresh.scalar().alias("fresh")).withColumn("confirmed", (F.col("tests") > 0) & (F.col("tests") == F.col("fresh")))


def train_components(members: DataFrame) -> DataFrame:
    """group, component of the train members: groups that share a content are one."""
    train = members.filter(F.col("partition") == "train").select("group", "content_digest").distinct()
    least = train.groupBy("content_digest").agg(F.min("group").alias("first"))
    edges = train.join(least, "content_digest").filter("group <> first").select(F.col("group").alias("a"), F.col("first").alias("b")).distinct()
    found = components(edges)
    groups = train.select("group").distinct()
    return groups.join(found, F.col("group") == F.col("node"), "left").select("group", F.coalesce("component", "group").alias("component"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, name), sorted -> (component, digest, names): the names' JSON array is hashed as it streams by."""
    going, sha, n = None, None, 0
    for b in batches:
        done: list[tuple] = []
        for component, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if sha is None or component != going:
                if sha is not None:
                    sha.update(b"]")
                    done.append((going, sha.hexdigest(), n))
                going, sha, n = component, hashlib.sha256(b"["), 0
            sha.update((b"," if n else b"") + name.encode())
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["component", "order", "groups"])
    if sha is not None:
        sha.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([going], pa.string()), pa.array([sha.hexdigest()], pa.string()), pa.array([n], pa.int64())], names=["component", "order", "groups"])


def component_digests(comp: DataFrame) -> DataFrame:
    """component, the SHA-256 of its groups' names as a sorted JSON array, and how many there are: one running hash, whatever a component's size."""
    rows = comp.select("component", quoted(F.col("group")).alias("name")).repartition("component").sortWithinPartitions("component", "name")
    return rows.mapInArrow(_digests, "component string, order string, groups long")


def validation_split(members: DataFrame) -> DataFrame:
    """group, component, status and new partition of each train group.

    Components go in order of the digest of their sorted names' JSON; the first
    fifth of them, one at least, becomes validation. Fewer than two groups or
    components is an error; where a validation part exists nothing changes.
    """
    comp = train_components(members)
    named = component_digests(comp)
    # Ranks of all components: counts by the first byte of the digest place each slice, windows rank within it.
    named = named.withColumn("slice", F.substring("order", 1, 3))
    sizes = named.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("slice", (F.sum("n").over(Window.orderBy("slice")) - F.col("n")).alias("before"))
    ranked = named.join(before, "slice").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("slice").orderBy("order", "component")))
    total = named.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.sum("groups"), F.lit(0)).alias("all_groups"))
    has = members.agg(F.count_if(F.col("partition") == "validation").alias("had"))
    facts = F.broadcast(total.select("components", "all_groups", has.scalar().alias("had")))
    out = comp.join(ranked.select("component", "rank"), "component").join(facts)
    status = F.when(F.col("had") > 0, "unchanged").when(F.col("all_groups") < 2, "too few groups").when(F.col("components") < 2, "too few components").otherwise("split")
    taken = (status == "split") & (F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("components") / 5)))
    return out.select("group", "component", status.alias("status"), F.when(taken, "validation").otherwise("train").alias("partition"))


def workspace(members: DataFrame, heads: DataFrame) -> DataFrame:
    """Members with the head of their canonical chain; labels of unresolved heads stay hidden."""
    h = heads.select(F.col("unit").alias("__u"), F.col("id").alias("canonical_id"), F.when(~F.col("unresolved"), F.col("label")).alias("label"), "unresolved")
    return members.join(h, members.unit == F.col("__u"), "left").drop("__u")
