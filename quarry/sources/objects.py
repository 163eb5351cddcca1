"""Objects as rows: verified reads, ranges, listings, immutable writes, manifests and page files."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, pattern: str = "*", after: str | None = None, limit: int = 100) -> tuple[DataFrame, str | None]:
    """A page of 1 to 100 object names under a root, with size and time, and the token for the next page (None: there is none); contents aren't read."""
    if not 1 <= limit <= 100:
        raise ValueError("a page has 1 to 100 objects")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    if after is not None:
        files = files.filter(F.col("path") > after)
    ahead = [r["path"] for r in files.orderBy("path").select("path").limit(limit + 1).collect()]
    page = files.orderBy("path").limit(limit)
    return page, ahead[limit - 1] if len(ahead) > limit else None


def object_status(content: Column, sha256: Column, size: Column) -> Column:
    """missing, corrupt (size first, then digest) or verified."""
    return F.when(content.isNull(), "missing").when(F.octet_length(content) != size, "corrupt").when(F.sha2(content, 256) != sha256, "corrupt").otherwise("verified")


def read_verified(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Objects (name, sha256, size) with their status and, if verified, their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    j = wanted.join(named, "name", "left")
    status = object_status(F.col("content"), F.col("sha256"), F.col("size"))
    return j.select("name", status.alias("status"), F.when(status == "verified", F.col("content")).alias("content"))


#: Fixed value: the most bytes of one range read.
MOST_RANGE = 1 << 20


def byte_range(content: Column, start: int, length: int) -> Column:
    if not 0 <= start or not 0 < length <= MOST_RANGE:
        raise ValueError(f"a range has 1 to {MOST_RANGE} bytes")
    return F.substring(content, start + 1, length)


def write_once(df: DataFrame, root: str) -> tuple[str, DataFrame]:
    """Write a table under the digest of its rows, never over anything, and return its path and what can be read back.

    Writing equal rows again finds them there; a copy that was cut short, or
    that doesn't read back with the same digest, is an error.
    """
    digest = rows_digest(df)
    path = f"{root.rstrip('/')}/{digest}"
    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
    back = df.sparkSession.read.parquet(path)
    if rows_digest(back) != digest:
        raise ValueError(f"{path} doesn't hold what was written")
    return path, back


def rows_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order: their number and two sums over their hashes."""
    names = [f"c{i}" for i in range(len(df.columns))]
    hashed = df.toDF(*names).select(*[F.xxhash64(F.lit(seed), *names).cast("decimal(38,0)").alias(seed) for seed in ("a", "b")])
    r = hashed.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()
    return hashlib.sha256(repr((sorted(df.dtypes), *map(str, r))).encode()).hexdigest()


def verified_manifest(spark: SparkSession, path: str, sha256: str, size: int, identity: dict[str, str]) -> DataFrame:
    """The members of a manifest file, once its bytes are those of its descriptor, its header names what was asked for, and its ids ascend."""
    file = spark.read.format("binaryFile").load(path).select(object_status(F.col("content"), F.lit(sha256), F.lit(size)).alias("status"), F.substring_index(F.decode("content", "UTF-8"), "\n", 1).alias("head")).first()
    if file is None or file["status"] != "verified":
        raise ValueError(f"{path}: {file['status'] if file else 'missing'}")
    head = json.loads(file["head"])
    if any(head.get(k) != v for k, v in identity.items()):
        raise ValueError(f"{path}: the manifest of something else")
    members = read_manifest(spark, path)
    if not members.filter(~F.col("ascends")).isEmpty():
        raise ValueError(f"{path}: members repeat or are out of order")
    return members.drop("ascends", "file")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Members of a manifest written line by line, with line numbers of their order and whether ids ascend."""
    from pyspark.sql import Window

    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    typed = lines.select("line", "file", F.from_json("value", "sample_id string, revision_id string, split string, format string").alias("m"))
    members = typed.filter("m.sample_id is not null").select("line", "file", "m.sample_id", "m.revision_id", "m.split")
    w = Window.partitionBy("file").orderBy("line")
    return members.withColumn("ascends", F.coalesce(F.lag("sample_id").over(w) < F.col("sample_id"), F.lit(True)))


def page_files(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Page IRs from ``page-NNN.ir.json`` files: from the first brace to the last, with the page number of the name."""
    raw = spark.read.option("pathGlobFilter", "page-*.ir.json").option("recursiveFileLookup", "true").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    number = F.regexp_extract("path", r"page-(\d+)\.ir\.json$", 1).cast("long")
    return raw.select(number.alias("page"), F.from_json(F.regexp_extract("value", r"(?s)(\{.*\})", 1), schema).alias("ir"))


def run_outputs(spark: SparkSession, root: str) -> DataFrame:
    """All files of a run (name, kind, bytes, chars): kinds by name and folder, characters of Markdown, pages and HTML; hidden files aren't there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", f"{re.escape(root.rstrip('/').removeprefix('file:'))}/(.*)$", 1)
    named = files.select(name.alias("name"), F.col("length").alias("bytes"), "content").filter(~F.col("name").rlike(r"(^|/)\."))
    kind = output_kind(F.col("name"))
    texts = kind.isin("markdown", "page", "html")
    return named.select("name", kind.alias("kind"), "bytes", F.when(texts, F.length(F.decode("content", "UTF-8"))).alias("chars"))


def output_kind(name: Column) -> Column:
    """What a file of a run is, by its path under the run's folder."""
    whole = F.element_at(F.split(name, "/"), -1)
    folder = F.when(name.contains("/"), F.regexp_replace(name, "/[^/]*$", "")).otherwise("")
    return (
        F.when(whole == "document.md", "markdown")
        .when(whole == "document.html", "html")
        .when(whole == "plan.json", "plan")
        .when(whole == "page-progress.json", "progress")
        .when((folder == "pages") & (whole.endswith(".md") | whole.endswith(".ir.json")), "page")
        .when(folder == "artifacts", "artifact")
        .otherwise("other")
    )


def input_kind(path: Column) -> Column:
    """How an input becomes pages, by its extension: ``pdf``, ``image``, or null for what isn't supported."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext == ".pdf", "pdf").when(ext.isin(".png", ".jpg", ".jpeg", ".webp"), "image")


JOB = "runId string, status string, createdAt string, updatedAt string, events array<struct<ts:string,message:string,phase:string>>"


def import_jobs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Jobs and their events (run_id, seq, ts, message, phase) of ``*.json`` files; files that aren't JSON or have no run are left out, and of a run's files the last by name holds."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(root, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    jobs = raw.select("file", F.from_json("value", JOB).alias("j")).filter("j.runId is not null and j.runId <> ''")
    last = jobs.groupBy(F.col("j.runId").alias("run_id")).agg(F.max_by("j", "file").alias("j"))
    events = last.select("run_id", F.posexplode("j.events").alias("seq", "e")).select("run_id", "seq", "e.ts", "e.message", "e.phase")
    return last.select("run_id", "j.status", F.col("j.createdAt").alias("created_at"), F.col("j.updatedAt").alias("updated_at")), events


def import_reviews(spark: SparkSession, root: str) -> DataFrame:
    """Reviews (run_id, review, updated_at) of ``<run>/review.json`` files of version 1."""
    raw = spark.read.option("pathGlobFilter", "review.json").option("recursiveFileLookup", "true").text(root, wholetext=True).select("value", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run_id"))
    return raw.filter(F.get_json_object("value", "$.v") == "1").select("run_id", F.col("value").alias("review"), F.get_json_object("value", "$.updatedAt").alias("updated_at"))


def fixture_cases(files: DataFrame) -> DataFrame:
    """Cases of a listing (path, value): folders with both ``input.*`` and ``expected.md``; ``meta.json`` may be there."""
    parts = F.split("path", "/")
    f = files.select(F.element_at(parts, -2).alias("id"), F.element_at(parts, -1).alias("name"), "path", "value")
    inputs = f.filter(F.lower("name").startswith("input.")).groupBy("id").agg(F.min("path").alias("input_path"))
    expected = f.filter(F.lower("name") == "expected.md").select("id", F.col("value").alias("expected"))
    meta = f.filter("name = 'meta.json'").select("id", F.col("value").alias("meta"))
    return inputs.join(expected, "id").join(meta, "id", "left")
