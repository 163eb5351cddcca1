"""Annotations: latest originals, one answer a contributor, agreement statistics, disagreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(originals: DataFrame) -> DataFrame:
    """The last row of each native annotation."""
    w = Window.partitionBy("unit", "native_id").orderBy(F.desc("sequence"))
    return originals.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def selection(originals: DataFrame, assigned: DataFrame) -> DataFrame:
    """For each assigned (unit, rater) the answer: the active latest one, else the last skipped one, else missing.

    Two active ones are ambiguous. A skipped annotation abstains, a deleted one
    is missing; what is missing has unknown assistance.
    """
    last = latest(originals).withColumn("active", F.col("state") == "submitted")
    rows = assigned.join(last, ["unit", "rater"], "left")
    by = rows.groupBy("unit", "rater").agg(
        F.count_if(F.coalesce("active", F.lit(False))).alias("actives"),
        F.max_by(F.when(F.col("active"), F.struct("label", "assistance")), F.when(F.col("active"), F.col("sequence"))).alias("a"),
        F.max_by(F.when(~F.col("active") & ~F.col("native_deleted"), F.struct("assistance")), F.when(~F.col("active") & ~F.col("native_deleted"), F.col("sequence"))).alias("s"),
    )
    state = F.when(F.col("actives") > 1, "ambiguous").when(F.col("actives") == 1, "submitted").when(F.col("s").isNotNull(), "abstained").otherwise("missing")
    assistance = F.when(F.col("actives") == 1, F.col("a.assistance")).when(F.col("s").isNotNull(), F.col("s.assistance")).otherwise("unknown")
    return by.select("unit", "rater", state.alias("state"), F.when(F.col("actives") == 1, F.col("a.label")).alias("label"), assistance.alias("assistance"))


def state_counts(selected: DataFrame) -> DataFrame:
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("submitted", "abstained", "missing")]
    return selected.groupBy("rater").agg(*states, F.count_if(F.col("assistance") == "assisted").alias("assisted"), F.count_if(F.col("assistance") == "unknown").alias("unknown"))


def disagreement(selected: DataFrame, contributors: int) -> DataFrame:
    """Units with more than one submitted label, or not submitted by all."""
    label = F.when(F.col("state") == "submitted", F.col("label"))
    by = selected.groupBy("unit").agg(F.count_distinct(label).alias("labels"), F.count_if(F.col("state") == "submitted").alias("submitted"))
    return by.filter((F.col("labels") > 1) | (F.col("submitted") != contributors))


def confusion(selected: DataFrame, raters: list[str], labels: list[str]) -> DataFrame:
    """Dense counts for each pair of raters and labels; one row a unit holds all raters, so no self-join is needed."""
    label = lambda r: F.max(F.when((F.col("rater") == r) & (F.col("state") == "submitted"), F.col("label")))
    wide = selected.groupBy("unit").agg(*[label(r).alias(f"r{i}") for i, r in enumerate(raters)])
    cells = [(i, j, x, y) for i in range(len(raters)) for j in range(i + 1, len(raters)) for x in labels for y in labels]
    counted = wide.agg(*[F.count_if((F.col(f"r{i}") == x) & (F.col(f"r{j}") == y)).alias(f"c{n}") for n, (i, j, x, y) in enumerate(cells)])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(raters[i]).alias("left"), F.lit(raters[j]).alias("right"), F.lit(x).alias("left_label"), F.lit(y).alias("right_label"), F.col(f"c{n}").alias("n")) for n, (i, j, x, y) in enumerate(cells)])))


def agreement(cells: DataFrame) -> DataFrame:
    """Observed agreement and Cohen's kappa of each pair, from whole numbers; undefined without overlap or by equal constant marginals."""
    by = ["left", "right"]
    out = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("left_label") == F.col("right_label"), F.col("n")).otherwise(0)).alias("agreed"), F.collect_list(F.struct("left_label", "right_label", "n")).alias("cells"))
    # A pair's cells are the labels' square, so its margins are sums within the row.
    margin = lambda side, x: F.aggregate(F.filter("cells", lambda c: c[side] == x), F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    labels = F.array_distinct(F.transform("cells", lambda c: c["left_label"]))
    out = out.withColumn("chance", F.aggregate(labels, F.lit(0).cast("long"), lambda acc, x: acc + margin("left_label", x) * margin("right_label", x)))
    square = F.col("n") * F.col("n")
    po = F.when(F.col("n") > 0, F.round(F.col("agreed").cast("double") / F.col("n"), 12))
    kappa = F.when((F.col("n") > 0) & (F.col("chance") != square), F.round((F.col("agreed") * F.col("n") - F.col("chance")).cast("double") / F.nullif(square - F.col("chance"), F.lit(0)), 12))
    why = F.when(F.col("n") == 0, "no overlap").when(F.col("chance") == square, "constant identical marginals")
    return out.select(*by, "n", "agreed", po.alias("observed"), kappa.alias("kappa"), why.alias("undefined"))


COHORT = ("namespace", "name", "browser_origin", "machine_origin", "image", "issuer")


def cohort_admissions(requests: DataFrame, cohorts: DataFrame) -> DataFrame:
    """request, outcome and cohort of requests for cohorts of trust (request, the columns of ``COHORT``, reason) against those admitted (cohort and the same columns).

    ``invalid``: no name or reason, or an issuer without https; ``overlaps``:
    its origins are those of several cohorts; ``shared``: those of one that
    differs otherwise; ``known``: of one that is the same; else ``admitted``.
    """
    origins = lambda df, key: df.select(key, F.explode(F.array_distinct(F.array("browser_origin", "machine_origin"))).alias("origin"))
    met = origins(requests, "request").join(origins(cohorts, "cohort"), "origin").groupBy("request").agg(F.count_distinct("cohort").alias("n"), F.min("cohort").alias("__cohort"))
    was = cohorts.select(F.col("cohort").alias("__c"), F.struct(*COHORT).alias("__was"))
    j = requests.join(met, "request", "left").join(was, F.col("__cohort") == F.col("__c"), "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    bad = blank("name") | blank("reason") | ~F.coalesce(F.col("issuer").startswith("https://"), F.lit(False))
    outcome = F.when(bad, "invalid").when(F.col("n") > 1, "overlaps").when(F.col("__c").isNull(), "admitted").when(F.struct(*COHORT).eqNullSafe(F.col("__was")), "known").otherwise("shared")
    return j.select("request", outcome.alias("outcome"), F.when(outcome == "known", F.col("__cohort")).alias("cohort"))


#: The most contributors and units of one agreement report.
MOST_CONTRIBUTORS, MOST_UNITS = 10, 100


def report_outcomes(requested: DataFrame) -> DataFrame:
    """report, contributors, units and outcome of requests for agreement reports (requested: report, unit, revision_id, schema, cohort, rater).

    A report has one task schema and one cohort of trust (else ``mixed``),
    units that are distinct revisions (else ``repeated``), and a bounded number
    of contributors and units (else ``too_many``).
    """
    by = requested.groupBy("report").agg(F.count_distinct("schema", "cohort").alias("kinds"), F.count_distinct("rater").alias("contributors"), F.count_distinct("unit").alias("units"), F.count_distinct("revision_id").alias("revisions"))
    outcome = F.when(F.col("kinds") != 1, "mixed").when(F.col("revisions") != F.col("units"), "repeated").when((F.col("contributors") > MOST_CONTRIBUTORS) | (F.col("units") > MOST_UNITS), "too_many").otherwise("created")
    return by.select("report", "contributors", "units", outcome.alias("outcome"))


def report_pairs(requested: DataFrame, selected: DataFrame) -> DataFrame:
    """report, left, right, left_label, right_label and n of the reports that are created: how often two contributors, both from the data, gave a unit these labels.

    A unit's contributors are one short array (at most ``MOST_CONTRIBUTORS``),
    whose pairs are counted; counts combine before the exchange.
    """
    ok = report_outcomes(requested).filter("outcome = 'created'").select("report")
    asked = requested.join(ok, "report", "left_semi").select("report", "unit", "rater").distinct()
    given = asked.join(selected.filter("state = 'submitted'").select("unit", "rater", "label"), ["unit", "rater"])
    by = given.groupBy("report", "unit").agg(F.array_sort(F.collect_list(F.struct("rater", "label"))).alias("r"))
    pairs = F.flatten(F.transform("r", lambda x, i: F.transform(F.slice(F.col("r"), i + 2, F.size("r")), lambda y: F.struct(x["rater"].alias("left"), y["rater"].alias("right"), x["label"].alias("left_label"), y["label"].alias("right_label")))))
    return by.select("report", F.inline(pairs)).groupBy("report", "left", "right", "left_label", "right_label").agg(F.count(F.lit(1)).alias("n"))


def report_counts(requested: DataFrame, selected: DataFrame) -> DataFrame:
    """report, its outcome, and of those created how many contributions are in each state, assisted or not, and how many units are in the queue of disagreements."""
    asked = requested.select("report", "unit", "rater").distinct()
    rows = asked.join(selected, ["unit", "rater"], "left").withColumn("state", F.coalesce("state", F.lit("missing")))
    label = F.when(F.col("state") == "submitted", F.col("label"))
    n = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    units = rows.groupBy("report", "unit").agg(*[n(F.col("state") == s).alias(s) for s in ("submitted", "abstained", "missing")], n(F.col("assistance") == "assisted").alias("assisted"), ((F.count_distinct(label) > 1) | (n(F.col("state") == "submitted") != F.count(F.lit(1)))).alias("open"))
    by = units.groupBy("report").agg(*[F.sum(c).alias(c) for c in ("submitted", "abstained", "missing", "assisted")], F.count_if("open").alias("disagreements"))
    out = report_outcomes(requested).join(by, "report")
    return out.select("report", "outcome", *[F.when(F.col("outcome") == "created", F.col(c)).alias(c) for c in ("submitted", "abstained", "missing", "assisted", "disagreements")])


#: Fixed value: the 97.5 % point of the normal distribution.
Z = 1.959963984540054


def wilson(agreed: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval of a proportion, within 0 and 1; null for n = 0."""
    n_, p = n.cast("double"), agreed.cast("double") / F.nullif(n, F.lit(0))
    z2 = Z * Z
    middle = (p + z2 / (2 * n_)) / (1 + z2 / n_)
    half = Z * F.sqrt(p * (1 - p) / n_ + z2 / (4 * n_ * n_)) / (1 + z2 / n_)
    return F.when(n > 0, F.round(F.greatest(F.lit(0.0), middle - half), 12)), F.when(n > 0, F.round(F.least(F.lit(1.0), middle + half), 12))


def import_diff(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append when natives (unit, native_id, digest) are imported: new or changed ones, tombstones of vanished ones."""
    k, i = known.alias("k"), incoming.alias("i")
    j = k.join(i, (F.col("k.unit") == F.col("i.unit")) & (F.col("k.native_id") == F.col("i.native_id")), "full")
    change = F.when(F.col("k.native_id").isNull(), "new").when(F.col("i.native_id").isNull() & ~F.col("k.native_deleted"), "deleted").when(F.col("k.digest") != F.col("i.digest"), "changed")
    rows = j.select(F.coalesce("k.unit", "i.unit").alias("unit"), F.coalesce("k.native_id", "i.native_id").alias("native_id"), (F.coalesce("k.sequence", F.lit(0).cast("long")) + 1).alias("sequence"), change.alias("change"))
    return rows.filter("change is not null")


def assignment_detail(assigned: DataFrame, originals: DataFrame, heads: DataFrame) -> DataFrame:
    """Of each unit: its originals, contributors without any, and the head of its canonical chain."""
    has = originals.groupBy("unit").agg(F.count(F.lit(1)).alias("originals"))
    lacking = assigned.join(originals.select("unit", "rater").distinct(), ["unit", "rater"], "left_anti").groupBy("unit").agg(F.count(F.lit(1)).alias("missing_contributors"))
    head = heads.groupBy("unit").agg(F.max("id").alias("canonical_id"))
    zero = F.lit(0).cast("long")
    units = assigned.select("unit").distinct()
    return units.join(has, "unit", "left").join(lacking, "unit", "left").join(head, "unit", "left").select("unit", F.coalesce("originals", zero).alias("originals"), F.coalesce("missing_contributors", zero).alias("missing_contributors"), "canonical_id")


def assignments(requests: DataFrame, members: DataFrame, admitted: DataFrame) -> DataFrame:
    """Outcomes of assignment requests (unit, rater, content): pins the current member's revision (members: unit, revision_id, sha256) and the digest of the content handed out.

    The unit must be a current member, its content that of the pinned revision,
    and the rater admitted.
    """
    m = members.select(F.col("unit").alias("__u"), "revision_id", F.col("sha256").alias("__sha"))
    a = admitted.select(F.col("rater").alias("__r")).distinct()
    j = requests.join(m, F.col("unit") == F.col("__u"), "left").join(a, F.col("rater") == F.col("__r"), "left").withColumn("content_digest", F.sha2("content", 256))
    outcome = F.when(F.col("__u").isNull(), "not_a_member").when(F.col("__r").isNull(), "not_admitted").when(F.col("content_digest") != F.col("__sha"), "content_changed").otherwise("assigned")
    ok = F.col("outcome") == "assigned"
    return j.withColumn("outcome", outcome).select("unit", "rater", "outcome", F.when(ok, F.col("revision_id")).alias("revision_id"), F.when(ok, F.col("content_digest")).alias("content_digest"))
