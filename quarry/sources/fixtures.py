"""Logical dataset tables projected from the harness tables, and the same projections as SQL.

Every projection exists twice, as a DataFrame and as a common table expression
in ``CTE``, so that a query and its SQL twin start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pad(c: Column) -> Column:
    """Ids as text whose order is the numeric order."""
    return F.lpad(c.cast("string"), 12, "0")


def split_of(doc_id: Column) -> Column:
    return F.when(doc_id % 10 < 7, "train").when(doc_id % 10 < 9, "test").otherwise("production")


def samples(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.concat(F.lit("doc-"), pad(F.col("doc_id"))).alias("id"), "doc_id", F.lit("text").alias("modality"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_key"), F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1).cast("long").alias("revision"))


def sample_revisions(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.explode((F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).cast("array<bigint>")).alias("revision"))
    body = F.when(F.col("revision") == 2, F.concat("text", F.lit(" r2"))).otherwise(F.col("text"))
    sample = F.concat(F.lit("doc-"), pad(F.col("doc_id")))
    return docs.select(F.concat_ws("-", F.lit("rev"), pad(F.col("doc_id")), F.col("revision").cast("string")).alias("id"), sample.alias("sample_id"), "doc_id", "revision", F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("long").alias("size_bytes"), F.concat(F.lit("g"), F.floor(F.col("doc_id") / 4).cast("string")).alias("group_id"))


def memberships(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("draft_id"))
    first, doc = 1 + F.col("doc_id") % 5, F.col("doc_id")
    to = F.when(doc % 4 == 0, first + 1 + doc % 3)
    spans = F.array(F.struct(first.alias("valid_from"), to.alias("valid_to")), F.when(doc % 8 == 0, F.struct((to + 1).alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))))
    rows = docs.select("draft_id", "doc_id", F.explode(F.array_compact(spans)).alias("s"))
    return rows.select("draft_id", F.concat(F.lit("doc-"), pad(doc)).alias("sample_id"), "doc_id", split_of(doc).alias("split"), F.col("s.valid_from").alias("valid_from"), F.col("s.valid_to").alias("valid_to"))


def metadata(spark, d) -> DataFrame:
    """sample_id and a map of raw JSON values; documents without labels lack the keys, every eleventh has a JSON null."""
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    quality = F.when(F.col("doc_id") % 11 == 0, F.lit("null")).otherwise(F.col("quality").cast("string"))
    entries = F.when(F.col("quality").isNotNull(), F.map_from_arrays(F.array(F.lit("quality"), F.lit("toxic")), F.array(quality, F.col("toxic").cast("string"))))
    return docs.join(labels, "doc_id", "left").select(F.concat(F.lit("doc-"), pad(F.col("doc_id"))).alias("sample_id"), entries.alias("metadata"))


def catalog(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(pad(F.col("p_partkey")).alias("id"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_name").alias("name"), F.col("p_type").alias("modality"), F.col("p_brand").alias("owner"), F.when(F.col("p_partkey") % 9 == 0, "archived").otherwise("active").alias("availability"))


def grants(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("principal"), F.col("s_nationkey").cast("long").alias("namespace"), F.when(F.col("s_suppkey") % 2 == 0, "write").otherwise("read").alias("access"), (F.col("s_suppkey") % 5 == 0).alias("disabled"))


def artifacts(spark, d) -> DataFrame:
    """One row for each distinct text: digest, size, verified (the least document isn't a multiple of 3), documents."""
    docs = table(spark, d, "documents")
    by = docs.groupBy(F.sha2("text", 256).alias("artifact_id")).agg(F.max(F.octet_length("text")).cast("long").alias("size_bytes"), F.min("doc_id").alias("first_doc"))
    return by.select("artifact_id", "size_bytes", "first_doc", (F.col("first_doc") % 3 != 0).alias("verified"), F.when(F.col("first_doc") % 13 == 0, "deleting").otherwise("active").alias("collection_state"))


def locations(spark, d) -> DataFrame:
    """Placements of artifacts: the suppliers 1 to 12 whose number and the artifact's first document add up to a multiple of 7."""
    a = artifacts(spark, d).select("artifact_id", "first_doc", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("n"))
    return a.filter((F.col("first_doc") + F.col("n")) % 7 == 0).select("artifact_id", F.concat_ws("-", F.lit("loc"), pad(F.col("first_doc")), F.lpad(F.col("n").cast("string"), 2, "0")).alias("id"), F.concat(F.lit("store"), (F.col("n") % 3).cast("string")).alias("store_id"), F.element_at(F.array(*map(F.lit, ("good", "missing", "corrupt", "unavailable"))), ((F.col("first_doc") + F.col("n")) % 4 + 1).cast("int")).alias("outcome"))


RATERS = ("a", "b", "c")


def originals(spark, d) -> DataFrame:
    """Annotations as an append-only sequence: rater, native id, sequence, label, state, assistance, deleted."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    raters = F.array(F.struct(F.lit("a").alias("rater"), F.col("quality").cast("long").alias("v")), F.struct(F.lit("b").alias("rater"), F.col("toxic").cast("long").alias("v")), F.struct(F.lit("c").alias("rater"), (F.col("n_chars") % 2).alias("v")))
    r = j.select("doc_id", F.explode(raters).alias("r")).select("doc_id", "r.rater", "r.v")
    # The raters' gaps differ, so no two of them miss the same documents.
    shift = F.when(F.col("rater") == "a", 0).when(F.col("rater") == "b", 1).otherwise(2)
    r = r.filter((F.col("doc_id") + shift) % 17 != 0)
    seq = F.array_compact(F.array(F.lit(1), F.when(F.col("doc_id") % 6 == 0, 2), F.when(F.col("doc_id") % 19 == 0, 3)))
    r = r.select("doc_id", "rater", "v", shift.alias("shift"), F.explode(seq.cast("array<bigint>")).alias("sequence"))
    deleted = F.col("sequence") == 3
    abstain = (F.col("doc_id") + F.col("shift")) % 13 == 0
    value = F.when(F.col("sequence") == 2, 1 - F.col("v")).otherwise(F.col("v"))
    return r.select(pad(F.col("doc_id")).alias("unit"), "rater", F.concat_ws("-", F.col("doc_id").cast("string"), "rater").alias("native_id"), "sequence", F.when(~abstain & ~deleted, value.cast("string")).alias("label"), F.when(deleted | abstain, "cancelled").otherwise("submitted").alias("state"), F.when(F.col("doc_id") % 5 == 0, "assisted").otherwise("none").alias("assistance"), deleted.alias("native_deleted"))


def canonical(spark, d) -> DataFrame:
    lab = table(spark, d, "labels").select("doc_id", "quality", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 3)).alias("k"))
    name = lambda k: F.concat_ws("-", F.concat(F.lit("c"), F.col("doc_id").cast("string")), k.cast("string"))
    return lab.select(name(F.col("k")).alias("id"), F.when(F.col("k") > 0, name(F.col("k") - 1)).alias("prior_id"), pad(F.col("doc_id")).alias("unit"), F.col("k").alias("position"), F.when((F.col("doc_id") + F.col("k")) % 5 != 0, F.col("quality").cast("string")).alias("label"), ((F.col("doc_id") + F.col("k")) % 5 == 0).alias("unresolved"))


def truth_members(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.concat(F.lit("doc-"), pad(F.col("doc_id"))).alias("sample_id"), "doc_id", F.concat(F.lit("g"), F.floor(F.col("doc_id") / 4).cast("string")).alias("group"), F.sha2("text", 256).alias("content_digest"), split_of(F.col("doc_id")).alias("partition"))


def operation_events(spark, d) -> DataFrame:
    """The event log: an operation for each user; kinds of event stand for its transitions."""
    e = table(spark, d, "events")
    kind = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])
    return e.select(F.col("user_id").cast("long").alias("operation_id"), F.col("event_id").cast("long").alias("event_id"), "ts", kind[F.col("event_type")].alias("event_type"), "value")


#: The transition that each kind of harness event stands for.
EVENT_KINDS = {"signup": "queued", "view": "running", "click": "effect_completed", "error": "failed", "purchase": "succeeded"}


def lines(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marked = F.when(F.col("pos") % 7 == 0, F.concat(F.lit("a. "), "line")).when(F.col("pos") % 7 == 3, F.concat(F.lit("1. "), "line")).when(F.col("pos") % 7 == 4, F.concat(F.lit("- "), "line")).otherwise(F.col("line"))
    return docs.select(F.col("doc_id").alias("doc"), F.col("pos").cast("long").alias("pos"), marked.alias("text"))


def page_texts(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("long").alias("doc"), (F.col("turn") + 1).cast("long").alias("page"), "role", "text")


def progress(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").cast("long").alias("doc"), F.col("o_orderkey").cast("long").alias("page"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending").alias("status"))


_PAD = "lpad(cast({} as varchar), 12, '0')"
CTE = {
    "sample": f"select 'doc-' || {_PAD.format('doc_id')} as id, doc_id, 'text' as modality, source || '/' || doc_id as source_key, case when doc_id % 7 = 0 then 2 else 1 end::bigint as revision from documents",
    "sample_revision": f"select 'rev-' || {_PAD.format('doc_id')} || '-' || revision as id, 'doc-' || {_PAD.format('doc_id')} as sample_id, doc_id, revision, sha256(body) as sha256, octet_length(encode(body))::bigint as size_bytes, 'g' || (doc_id // 4) as group_id from (select doc_id, r.revision::bigint as revision, case when r.revision = 2 then text || ' r2' else text end as body from documents, (values (1), (2)) r(revision) where r.revision = 1 or doc_id % 7 = 0)",
    "membership": f"select source as draft_id, 'doc-' || {_PAD.format('doc_id')} as sample_id, doc_id, case when doc_id % 10 < 7 then 'train' when doc_id % 10 < 9 then 'test' else 'production' end as split, vf as valid_from, vt as valid_to from (select doc_id, source, 1 + doc_id % 5 as vf, case when doc_id % 4 = 0 then 2 + doc_id % 5 + doc_id % 3 end as vt from documents union all select doc_id, source, 3 + doc_id % 5 + doc_id % 3, null from documents where doc_id % 8 = 0)",
    "metadata": f"select 'doc-' || {_PAD.format('d.doc_id')} as sample_id, case when l.quality is null then null when d.doc_id % 11 = 0 then 'null' else cast(l.quality as varchar) end as quality, cast(l.toxic as varchar) as toxic from documents d left join labels l using (doc_id)",
    "catalog": f"select {_PAD.format('p_partkey')} as id, 'part-' || p_partkey as slug, p_name as name, p_type as modality, p_brand as owner, case when p_partkey % 9 = 0 then 'archived' else 'active' end as availability from part",
    "grants": "select 'p' || s_suppkey as principal, s_nationkey::bigint as namespace, case when s_suppkey % 2 = 0 then 'write' else 'read' end as access, s_suppkey % 5 = 0 as disabled from supplier",
    "artifact": "select artifact_id, size_bytes, first_doc, first_doc % 3 <> 0 as verified, case when first_doc % 13 = 0 then 'deleting' else 'active' end as collection_state from (select sha256(text) as artifact_id, max(octet_length(encode(text)))::bigint as size_bytes, min(doc_id) as first_doc from documents group by 1)",
    "location": f"select artifact_id, 'loc-' || {_PAD.format('first_doc')} || '-' || lpad(cast(n as varchar), 2, '0') as id, 'store' || (n % 3) as store_id, ['good', 'missing', 'corrupt', 'unavailable'][1 + (first_doc + n) % 4] as outcome from (select sha256(text) as artifact_id, min(doc_id) as first_doc from documents group by 1), range(1, 13) r(n) where (first_doc + n) % 7 = 0",
    "original": f"select {_PAD.format('doc_id')} as unit, rater, doc_id || '-' || rater as native_id, sequence::bigint as sequence, case when (doc_id + shift) % 13 <> 0 and sequence <> 3 then cast(case when sequence = 2 then 1 - v else v end as varchar) end as label, case when sequence = 3 or (doc_id + shift) % 13 = 0 then 'cancelled' else 'submitted' end as state, case when doc_id % 5 = 0 then 'assisted' else 'none' end as assistance, sequence = 3 as native_deleted from (select l.doc_id, r.rater, r.shift, case r.rater when 'a' then l.quality when 'b' then l.toxic else d.n_chars % 2 end as v from labels l join documents d using (doc_id), (values ('a', 0), ('b', 1), ('c', 2)) r(rater, shift) where (l.doc_id + r.shift) % 17 <> 0), (values (1), (2), (3)) s(sequence) where sequence = 1 or (sequence = 2 and doc_id % 6 = 0) or (sequence = 3 and doc_id % 19 = 0)",
    "canonical": f"select 'c' || doc_id || '-' || k as id, case when k > 0 then 'c' || doc_id || '-' || (k - 1) end as prior_id, {_PAD.format('doc_id')} as unit, k as position, case when (doc_id + k) % 5 <> 0 then cast(quality as varchar) end as label, (doc_id + k) % 5 = 0 as unresolved from labels, range(0, 3) r(k) where k <= doc_id % 3",
    "truth_member": f"select 'doc-' || {_PAD.format('doc_id')} as sample_id, doc_id, 'g' || (doc_id // 4) as \"group\", sha256(text) as content_digest, case when doc_id % 10 < 7 then 'train' when doc_id % 10 < 9 then 'test' else 'production' end as partition from documents",
    "event": "select user_id::bigint as operation_id, event_id::bigint as event_id, ts, case event_type when 'signup' then 'queued' when 'view' then 'running' when 'click' then 'effect_completed' when 'error' then 'failed' when 'purchase' then 'succeeded' end as event_type, value from events",
    "line": "select doc, pos, case when pos % 7 = 0 then 'a. ' || line when pos % 7 = 3 then '1. ' || line when pos % 7 = 4 then '- ' || line else line end as text from (select doc_id as doc, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as pos from documents)",
    "page_text": "select conv_id::bigint as doc, (turn + 1)::bigint as page, role, text from conversations",
    "progress": "select o_custkey::bigint as doc, o_orderkey::bigint as page, case o_orderstatus when 'F' then 'done' when 'P' then 'failed' else 'pending' end as status from orders",
}


def with_tables(names: str, body: str, *more: str) -> str:
    """SQL: the named logical tables, further expressions ``name as (...)``, and the query."""
    return "with " + ", ".join([f"{n} as ({CTE[n]})" for n in names.split()] + list(more)) + " " + body
