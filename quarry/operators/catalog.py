"""Catalog reads and writes: access, search, keyset pages, current revisions, compare-and-set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx


def readable(rows: DataFrame, grants: DataFrame, principal: str, access: str = "read", namespace: str = "namespace") -> DataFrame:
    """Rows of the namespaces that the principal may use; write implies read, a disabled principal has nothing."""
    enough = ["write"] if access == "write" else ["read", "write"]
    mine = grants.filter((F.col("principal") == principal) & ~F.col("disabled") & F.col("access").isin(enough)).select("namespace")
    return rows.join(mine, rows[namespace] == mine.namespace, "left_semi")


def keyset_page(rows: DataFrame, key: str = "id", after=None, limit: int = 100) -> DataFrame:
    """The first ``limit`` rows after the cursor, and ``next_after``: the last key if more follow, else null.

    One top-k of limit + 1 rows; the cursor comes from those rows alone.
    """
    rest = rows if after is None else rows.filter(F.col(key) > F.lit(after))
    top = rest.orderBy(key).limit(limit + 1)
    keys = top.agg(F.sort_array(F.collect_list(key)).alias("keys")).select(F.when(F.size("keys") > limit, F.element_at("keys", limit)).alias("next_after"))
    return top.orderBy(key).limit(limit).withColumn("next_after", keys.scalar())


def search(catalog: DataFrame, text: str | None = None, modality: str | None = None, owner: str | None = None, archived: bool = False, after: str | None = None, limit: int = 100) -> DataFrame:
    """A page of the catalog with ``total``, which counts what the filters admit, whatever the cursor."""
    rows = catalog
    if text is not None:
        needle = F.lower(F.lit(text))
        rows = rows.filter(F.lower("name").contains(needle) | F.lower("slug").contains(needle))
    for column, value in (("modality", modality), ("owner", owner)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if not archived:
        rows = rows.filter(F.col("availability") != "archived")
    return keyset_page(rows, "id", after, limit).withColumn("total", rows.agg(F.count(F.lit(1))).scalar())


def current_revision(samples: DataFrame, revisions: DataFrame) -> DataFrame:
    """Each sample with its current revision; storage keys are never among the columns."""
    s, r = samples.alias("s"), revisions.alias("r")
    return s.join(r, (F.col("s.id") == F.col("r.sample_id")) & (F.col("s.revision") == F.col("r.revision"))).select(F.col("s.id").alias("sample_id"), F.col("s.source_key"), F.col("r.id").alias("revision_id"), F.col("r.revision"), F.col("r.sha256"), F.col("r.size_bytes"))


def latest_revision(revisions: DataFrame, by: list[str]) -> DataFrame:
    return revisions.groupBy(*by).agg(F.max("revision").alias("revision"), F.max_by("id", "revision").alias("revision_id"))


def scoped(rows: DataFrame, scope: dict, **key) -> DataFrame:
    """Point read within a scope: rows of other scopes aren't there."""
    for name, value in {**scope, **key}.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows


def admit_writes(commands: DataFrame, catalog: DataFrame) -> DataFrame:
    """Outcome of create and edit commands (slug, expected_revision or null) against the catalog (slug, revision, availability)."""
    c, k = commands.alias("c"), catalog.alias("k")
    joined = c.join(k, F.col("c.slug") == F.col("k.slug"), "left")
    outcome = (
        F.when(F.col("c.expected_revision").isNull() & F.col("k.slug").isNull(), "created")
        .when(F.col("c.expected_revision").isNull(), "conflict")
        .when(F.col("k.slug").isNull(), "not_found")
        .when(F.col("k.availability") == "archived", "archived")
        .when(F.col("k.revision") != F.col("c.expected_revision"), "stale")
        .otherwise("updated")
    )
    return joined.select("c.command_id", "c.slug", outcome.alias("outcome"))


def first_by(rows: DataFrame, by: str, order: str, count: int = 1) -> DataFrame:
    """The first ``count`` rows of each ``by`` in the order of a unique column."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= count)


#: Failed reads of placements by how much they tell.
SEVERITY = {"missing": 1, "unavailable": 2, "corrupt": 3}


def placement_fallback(locations: DataFrame, most: int = 4) -> DataFrame:
    """Of the first ``most`` placements of an artifact the first good one, or the worst of the errors."""
    few = first_by(locations, "artifact_id", "id", most)
    rank = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    good = F.col("outcome") == "good"
    out = few.groupBy("artifact_id").agg(F.min(F.when(good, F.col("id"))).alias("location_id"), F.max_by("outcome", F.coalesce(rank[F.col("outcome")], F.lit(0))).alias("worst"))
    return out.select("artifact_id", "location_id", F.when(F.col("location_id").isNull(), F.col("worst")).alias("error"))


def remaining(members: DataFrame, completed: DataFrame, key: str, after=None) -> DataFrame:
    left = members.join(completed.select(key), key, "left_anti")
    return left if after is None else left.filter(F.col(key) > F.lit(after))


def heads(chain: DataFrame, key: str = "id", prior: str = "prior_id") -> DataFrame:
    """Rows of a linked chain that no other row follows."""
    follows = chain.select(F.col(prior).alias("__p")).filter(F.col("__p").isNotNull())
    return chain.join(follows, chain[key] == F.col("__p"), "left_anti")


def unique_violations(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def retry_lineage(items: DataFrame) -> DataFrame:
    """Each item with the item that retries it, if any."""
    child = items.select(F.col("retry_of").alias("__of"), F.col("id").alias("retried_by")).filter(F.col("__of").isNotNull())
    return items.join(child, items.id == F.col("__of"), "left").drop("__of")


def set_difference_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one of two sets of equal columns: none if the sets are equal."""
    return a.subtract(b).withColumn("only_in", F.lit("left")).unionByName(b.subtract(a).withColumn("only_in", F.lit("right")))


def utf8_preview(content: Column, most: int) -> tuple[Column, Column, Column]:
    """kind, text and truncated of the first ``most`` bytes: an unfinished last character is dropped; NUL or bad UTF-8 is binary."""
    head = F.substring(content, 1, most)
    # The longest prefix that is valid UTF-8, of those shorter by at most the three bytes of an unfinished character.
    prefixes = [F.substring(content, 1, most - i) for i in range(4)]
    cut = F.octet_length(content) > most
    text = F.try_validate_utf8(head.cast("string"))
    shorter = F.coalesce(*[F.try_validate_utf8(p.cast("string")) for p in prefixes])
    text = F.when(cut, shorter).otherwise(text)
    text = F.when(F.instr(text, "\0") == 0, text)
    return F.when(text.isNull(), "binary").otherwise("text"), text, cut & text.isNotNull()


def containments(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left, right) of titles of which one, normalised, contains the other.

    A text contains another only if it holds its first three characters (or
    all, if it has fewer), so the containing side is joined by its pieces of up
    to three characters and the whole is checked afterwards.
    """
    sides = [df.toDF("title").distinct().withColumn("key", tx.section_key(F.col("title"))).filter("key <> ''") for df in (left, right)]

    def within(outer: DataFrame, inner: DataFrame) -> DataFrame:
        def pieces(n: int) -> Column:
            all_ = F.transform(F.sequence(F.lit(1), F.length("key") - n + 1), lambda i: F.substring("key", i, F.lit(n)))
            return F.when(F.length("key") >= n, all_).otherwise(F.array().cast("array<string>"))

        o = outer.select(F.col("title").alias("outer"), F.col("key").alias("whole"), F.explode(F.array_distinct(F.concat(*map(pieces, (1, 2, 3))))).alias("piece"))
        i = inner.select(F.col("title").alias("inner"), "key", F.substring("key", 1, 3).alias("piece"))
        return o.join(i, "piece").filter(F.col("whole").contains(F.col("key"))).select("outer", "inner")

    one = within(*sides).select(F.col("outer").alias("left"), F.col("inner").alias("right"))
    two = within(*reversed(sides)).select(F.col("inner").alias("left"), F.col("outer").alias("right"))
    return one.unionByName(two).distinct()
