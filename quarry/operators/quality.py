"""Quality rules over a sealed selection: one pass of conditional aggregates, bounded evidence, exact thresholds."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the evidence that a rule shows.
EVIDENCE, MOST_EVIDENCE = 25, 100


@dataclass(frozen=True)
class Rule:
    """``minimum_samples`` (minimum) or ``required_metadata`` (key, max_missing as decimal text), over one split or all."""

    id: str
    kind: str
    required: bool = True
    split: str | None = None
    minimum: int = 0
    key: str = ""
    max_missing: str = "0"


def missing(metadata: Column, key: str) -> Column:
    """Absent or JSON null; false, 0 and "" are values."""
    value = metadata[key]
    return metadata.isNull() | value.isNull() | (value == "null")


def _selected(rule: Rule) -> Column:
    return F.lit(True) if rule.split is None else F.coalesce(F.col("split") == rule.split, F.lit(False))


def _failed(rule: Rule) -> Column:
    return _selected(rule) & missing(F.col("metadata"), rule.key) if rule.kind == "required_metadata" else F.lit(False)


def counters(members: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule_id, examined and failures of every rule, counted in one scan; partial results of batches may be added up."""
    sums = []
    for i, r in enumerate(rules):
        sums += [F.count_if(_selected(r)).alias(f"e{i}"), F.count_if(_failed(r)).alias(f"f{i}")]
    one = members.agg(*sums)
    return one.select(F.inline(F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.col(f"e{i}").alias("examined"), F.col(f"f{i}").alias("failures")) for i, r in enumerate(rules)])))


def merge_counters(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("rule_id").agg(F.sum("examined").alias("examined"), F.sum("failures").alias("failures"))


def statuses(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """passed, failed, or unknown where a metadata rule has examined nothing; fractions are compared by whole numbers."""
    status = F.lit(None).cast("string")
    required, split = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for r in rules:
        here = F.col("rule_id") == r.id
        if r.kind == "minimum_samples":
            says = F.when(F.col("examined") >= r.minimum, "passed").otherwise("failed")
        else:
            most = Fraction(r.max_missing)
            wide = lambda c, n: F.col(c).cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)")
            says = F.when(F.col("examined") == 0, "unknown").when(wide("failures", most.denominator) <= wide("examined", most.numerator), "passed").otherwise("failed")
        status, required, split = F.when(here, says).otherwise(status), F.when(here, F.lit(r.required)).otherwise(required), F.when(here, F.lit(r.split).cast("string")).otherwise(split)
    return counted.withColumns({"status": status, "required": required, "split": split})


def offenders(members: DataFrame, rules: list[Rule], limit: int = EVIDENCE) -> DataFrame:
    """rule_id, position and sample_id of the first offenders of each rule by id: a top-k for each rule, so no rule's rows meet in one task."""
    parts = [members.filter(_failed(r)).orderBy("sample_id").limit(limit).select(F.lit(r.id).alias("rule_id"), "sample_id") for r in rules if r.kind == "required_metadata"]
    return reduce(DataFrame.unionByName, parts) if parts else members.limit(0).select(F.lit("").alias("rule_id"), "sample_id")


def report(members: DataFrame, rules: list[Rule], limit: int = EVIDENCE) -> DataFrame:
    if not 0 <= limit <= MOST_EVIDENCE:
        raise ValueError(f"evidence: 0 to {MOST_EVIDENCE}")
    shown = offenders(members, rules, limit).groupBy("rule_id").agg(F.sort_array(F.collect_list("sample_id")).alias("offending"))
    out = statuses(counters(members, rules), rules).join(shown, "rule_id", "left")
    listed = F.coalesce("offending", F.array().cast("array<string>"))
    return out.select("rule_id", "required", "split", "status", "examined", "failures", F.array_join(listed, ",").alias("offending"), (F.col("failures") > F.size(listed)).alias("truncated"))


def partial(members: DataFrame, rules: list[Rule], limit: int = EVIDENCE) -> DataFrame:
    """The state of a report over some members: of each rule its counters and its first offenders, ``limit`` at most; states of parts can be merged, kept and merged again."""
    if not 0 <= limit <= MOST_EVIDENCE:
        raise ValueError(f"evidence: 0 to {MOST_EVIDENCE}")
    shown = offenders(members, rules, limit).groupBy("rule_id").agg(F.sort_array(F.collect_list("sample_id")).alias("offending"))
    return counters(members, rules).join(shown, "rule_id", "left").withColumn("offending", F.coalesce("offending", F.array().cast("array<string>")))


def merge_states(*states: DataFrame, limit: int = EVIDENCE) -> DataFrame:
    """The state over all parts' members. Merging is associative and commutative; the least offenders of all are among the least of each part, so nothing is lost."""
    first = F.slice(F.array_sort(F.flatten(F.collect_list("offending"))), 1, limit) if limit else F.array().cast("array<string>")
    return reduce(DataFrame.unionByName, states).groupBy("rule_id").agg(F.sum("examined").alias("examined"), F.sum("failures").alias("failures"), first.alias("offending"))


def finish(state: DataFrame, rules: list[Rule]) -> DataFrame:
    """The report that a state comes to, as ``report`` gives it over all members at once."""
    out = statuses(state, rules)
    return out.select("rule_id", "required", "split", "status", "examined", "failures", F.array_join("offending", ",").alias("offending"), (F.col("failures") > F.size("offending")).alias("truncated"))


def gate(reported: DataFrame) -> DataFrame:
    """One row: whether every required rule has passed."""
    return reported.agg(F.coalesce(F.bool_and(~F.col("required") | (F.col("status") == "passed")), F.lit(True)).alias("required_rules_pass"), F.count_if(F.col("required")).alias("required_rules"), F.count_if(F.col("status") == "passed").alias("passed"))


def running_view(reported: DataFrame, state: str) -> DataFrame:
    """While a validation runs, nothing is said about its rules."""
    return reported.withColumn("status", F.when(F.lit(state) == "running", "pending").otherwise(F.col("status")))
