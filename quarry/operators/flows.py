"""Process flows and jobs: admission, ordered steps, lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import canonical
from quarry.functions import text as tx

TRANSFORMS = {"identity": lambda c: c, "strip": tx.strip, "lowercase": F.lower}


def admit_runs(runs: DataFrame) -> DataFrame:
    """Outcome of run requests (candidate, version, state, members, max_members, model_steps, max_model_calls)."""
    one = F.col("candidate").isNull() != F.col("version").isNull()
    fits = (F.col("state") == "sealed") & F.col("members").between(1, F.col("max_members"))
    outcome = F.when(~one, "invalid").when(~fits, "not_admissible").when(F.col("model_steps") * F.col("members") > F.col("max_model_calls"), "over_budget").otherwise("admitted")
    return runs.withColumn("outcome", outcome)


def run_steps(texts: DataFrame, steps: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a member and step with the chain of digests; the steps of a flow are few and fixed, so they are columns."""
    now, rows = F.col(text), []
    for i, step in enumerate(steps):
        new = TRANSFORMS[step](now)
        rows.append(F.struct(F.lit(i).cast("long").alias("step"), F.sha2(now, 256).alias("input_digest"), F.sha2(canonical.canonical_object({"text": new}), 256).alias("output_digest"), F.octet_length(new).cast("long").alias("bytes")))
        now = new
    return texts.select(key, F.inline(F.array(*rows)))


#: The states a job may go to from each.
JOB_STATES = {"queued": ("running", "cancelled"), "running": ("completed", "failed", "cancelled"), "completed": ("queued",), "failed": ("queued",), "cancelled": ("queued",)}


def job_move(state: Column, wanted: Column) -> Column:
    """The state after a wanted move, or the old one if that isn't allowed."""
    out = state
    for source, targets in JOB_STATES.items():
        out = F.when((state == source) & wanted.isin(*targets), wanted).otherwise(out)
    return out


#: Stages of a digest and their phases.
STAGES = {"assemble": ("structure", "stitch"), "write": ("write",), "done": ("done",)}


def stage_view(events: DataFrame, stages: dict[str, tuple[str, ...]] = STAGES) -> DataFrame:
    """Of each run (run_id, phase) and stage: how many of its different steps have been seen."""
    rows = [F.struct(F.lit(i).cast("long").alias("stage"), F.lit(name).alias("label"), F.lit(p).alias("step")) for i, (name, phases) in enumerate(stages.items()) for p in phases]
    runs = events.select("run_id").distinct().select("run_id", F.inline(F.array(*rows)))
    seen = events.select("run_id", F.col("phase").alias("step")).distinct().withColumn("hit", F.lit(1))
    return runs.join(seen, ["run_id", "step"], "left").groupBy("run_id", "stage", "label").agg(F.count("hit").alias("done"), F.count(F.lit(1)).alias("total"))


def model_valid(provider: Column, transport: Column, model: Column, identity: Column) -> Column:
    word = "[a-zA-Z0-9][a-zA-Z0-9_.-]*"
    family = F.when(provider == "gemini", "google").otherwise("z-ai")
    routed = (identity == "mutable_alias") & model.startswith(F.concat(family, F.lit("/"))) & F.substring_index(model, "/", -1).rlike(f"^{word}$") & (F.size(F.split(model, "/")) == 2)
    return F.when(transport == "openrouter", routed).otherwise(model.rlike(f"^{word}$"))


def label_view(labels: Column, instructions: Column) -> Column:
    """The annotation form of a labelling task, as XML; null if the labels aren't 2 to 30 different, filled ones of at most 100 characters."""

    def attribute(c: Column) -> Column:
        c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        for char, name in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
            c = F.replace(c, F.lit(char), F.lit(name))
        double = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit("&quot;")), F.lit('"'))
        return F.when(F.contains(c, F.lit('"')) & ~F.contains(c, F.lit("'")), F.concat(F.lit("'"), c, F.lit("'"))).otherwise(double)

    ok = F.size(labels).between(2, 30) & (F.size(F.array_distinct(labels)) == F.size(labels)) & F.forall(labels, lambda x: (tx.trim(x) != "") & (F.length(x) <= 100)) & (tx.trim(instructions) != "")
    choices = F.array_join(F.transform(labels, lambda x: F.concat(F.lit("<Choice value="), attribute(x), F.lit("/>"))), "")
    form = F.concat(F.lit("<View><Header value="), attribute(instructions), F.lit('/><Text name="text" value="$text"/><Choices name="label" toName="text" choice="single" required="true">'), choices, F.lit('</Choices><Choices name="assistance" toName="text" choice="single"><Choice value="independent"/><Choice value="assisted"/><Choice value="unknown"/></Choices></View>'))
    return F.when(ok, form)


def data_path(path: Column, root: str) -> Column:
    """A path under the data folder ``root``, from paths of other hosts by their last ``/data/``."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    inside = (path == root) | path.startswith(root + "/")
    after = F.regexp_extract(p, r"^.*/data/(.*)$", 1)
    rel = F.regexp_replace(F.regexp_replace(p, r"^\./", ""), "^data/", "")
    return F.when(inside, path).when(path.startswith("/") & p.contains("/data/"), F.concat(F.lit(root + "/"), after)).when(path.startswith("/"), path).when(rel == "data", F.lit(root)).otherwise(F.concat(F.lit(root + "/"), rel))


#: Dates of headers, without their weekday.
HTTP_DATE, HTTP_FORMAT = r"^[A-Za-z]{3,9}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) GMT$", "dd MMM yyyy HH:mm:ss Z"


def retry_after_ms(value: Column, now: Column | None = None) -> Column:
    """Milliseconds of a pause given in seconds, or until a date if ``now`` is given (0 for a past one); null for anything else."""
    seconds = value.try_cast("double")
    pause = F.when((seconds >= 0) & (seconds < float("inf")), F.round(seconds * 1000).cast("long"))
    if now is None:
        return pause
    day = F.regexp_extract(F.trim(value), HTTP_DATE, 1)
    at = F.when(day != "", F.try_to_timestamp(F.concat(day, F.lit(" +0000")), F.lit(HTTP_FORMAT)))
    return F.when(seconds.isNotNull(), pause).when(at.isNotNull(), F.greatest(F.lit(0).cast("long"), F.unix_millis(at) - F.unix_millis(now)))


#: Fixed value: how often a page is tried.
PAGE_ATTEMPTS = 2


def accept_pages(attempts: DataFrame) -> DataFrame:
    """doc, page, status, attempts, reasons and chars of pages by their attempts (doc, page, attempt, text, error).

    A first attempt that is valid is done; one that fails by a rate limit ends
    the page, any other is tried again. The last attempt counts with its faults
    unless it failed or is empty; a page whose last attempt isn't there is pending.
    """
    made = F.struct("error", tx.validate_markdown(F.col("text")).alias("reasons"), F.length(tx.trim(F.col("text"))).cast("long").alias("chars"))
    tries = attempts.filter(F.col("attempt").between(1, PAGE_ATTEMPTS)).withColumn("made", made)
    by = tries.groupBy("doc", "page").agg(F.max_by("made", F.when(F.col("attempt") == 1, 1)).alias("a"), F.max_by("made", F.when(F.col("attempt") == PAGE_ATTEMPTS, 1)).alias("b"))
    fine = lambda x: x["error"].isNull() & (F.size(x["reasons"]) == 0)
    a, b = F.col("a"), F.col("b")
    limited = a["error"].isNotNull() & tx.rate_limited(F.lit(None).cast("int"), a["error"])
    status = (
        F.when(F.coalesce(fine(a), F.lit(False)), "done")
        .when(F.coalesce(limited, F.lit(False)), "failed")
        .when(b.isNull(), "pending")
        .when(b["error"].isNotNull() | ((F.size(b["reasons"]) > 0) & (b["chars"] == 0)), "failed")
        .otherwise("done")
    )
    first = F.coalesce(fine(a) | limited, F.lit(False))
    last = F.when(first | b.isNull(), a).otherwise(b)
    tried = F.when((status == "failed"), PAGE_ATTEMPTS).when(first | b.isNull(), a.isNotNull().cast("int")).otherwise(PAGE_ATTEMPTS)
    return by.select("doc", "page", status.alias("status"), tried.cast("long").alias("attempts"), F.array_join(F.when(last["error"].isNull(), last["reasons"]).otherwise(F.array(last["error"])), ",").alias("reasons"), F.when(status == "done", last["chars"]).otherwise(0).cast("long").alias("chars"))


def digest_status(pages: DataFrame) -> DataFrame:
    """Of each document: failed with any failed page, running with any pending one, else completed."""
    n = lambda x: F.count_if(F.col("status") == x)
    by = pages.groupBy("doc").agg(n("done").alias("done"), n("failed").alias("failed"), n("pending").alias("pending"), F.sum("chars").alias("chars"))
    return by.withColumn("status", F.when(F.col("failed") > 0, "failed").when(F.col("pending") > 0, "running").otherwise("completed"))
