"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import evaluate as ev
from quarry.sources import fixtures as fx


def cases(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    other = docs.filter("doc_id % 4 <> 0").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("predicted"))
    return docs.join(other, "doc_id", "left").select(F.col("doc_id").alias("id"), "predicted", F.col("text").alias("expected"))


def a17_token_f1(spark, d):
    return ev.token_f1(cases(spark, d))


def scored(spark, d):
    f1 = ev.token_f1(cases(spark, d))
    md = F.concat(F.when(F.col("id") % 3 == 0, F.lit("# T\n")).otherwise(F.lit("")), F.when(F.col("id") % 5 == 0, F.lit("```mermaid\ngraph TD\n```\n")).when(F.col("id") % 7 == 0, F.lit("```mermaid\nnothing\n```\n")).otherwise(F.lit("")), F.lit("body"))
    return f1.select("id", tx.structure_score(md).alias("structure"), F.col("f1").alias("similarity"))


def x10_structure(spark, d):
    return scored(spark, d).select("id", "structure")


def x11_fixture_scores(spark, d):
    return scored(spark, d)


def a18_averages(spark, d):
    s = scored(spark, d)
    return ev.averages(s.withColumn("similarity", F.when(F.col("id") % 6 != 0, F.col("similarity"))))


def x09_tokens(spark, d):
    docs = fx.table(spark, d, "documents")
    t = tx.tokens(F.concat(F.lit("```\nx y\n``` "), "text"))
    return docs.select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("distinct"))


def s15_dataset_items(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select(F.concat(F.lit("fixtures/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/input.txt")).alias("path"), F.col("doc_id").cast("string").alias("case_id"), F.sha2("text", 256).alias("expected"))


TOKENS = "list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
CASE = "eval_case as (select a.doc_id as id, b.text as predicted, a.text as expected from documents a left join documents b on b.doc_id = a.doc_id + 1 and b.doc_id % 4 <> 0)"
F1 = f"f1 as (select c.id, case when t.p is null then 1.0 else round(2 * t.both::double / (t.p + t.e), 12) end as f1 from eval_case c left join (select id, sum(least(p, e)) as both, sum(p) as p, sum(e) as e from (select id, token, count(*) filter (side = 'p') as p, count(*) filter (side = 'e') as e from (select id, 'p' as side, unnest({TOKENS.format('predicted')}) as token from eval_case union all select id, 'e', unnest({TOKENS.format('expected')}) from eval_case) group by 1, 2) group by 1) t using (id))"
STRUCTURE = "case when id % 5 = 0 then ((id % 3 = 0)::int + 1) / 2.0::double when id % 7 = 0 then (id % 3 = 0)::int / 2.0::double else (id % 3 = 0)::int::double end"

QUERIES = {
    "x09_tokens": (x09_tokens, f"select doc_id, len(t)::bigint as tokens, len(list_distinct(t))::bigint as \"distinct\" from (select doc_id, {TOKENS.format('text')} as t from documents)"),
    "x10_structure": (x10_structure, f"select doc_id as id, {STRUCTURE.replace('id %', 'doc_id %')} as structure from documents"),
    "x11_fixture_scores": (x11_fixture_scores, f"with {CASE}, {F1} select id, {STRUCTURE} as structure, f1 as similarity from f1"),
    "a17_token_f1": (a17_token_f1, f"with {CASE}, {F1} select id, f1 from f1"),
    "a18_averages": (a18_averages, f"with {CASE}, {F1} select count(*) as cases, round(sum({STRUCTURE}::decimal(20, 10))::double / count(*), 9) as structure, round(sum(case when id % 6 <> 0 then f1 else 0 end::decimal(20, 10))::double / count(*), 9) as similarity from f1"),
    "s15_dataset_items": (s15_dataset_items, "select 'fixtures/' || source || '/' || doc_id || '/input.txt' as path, cast(doc_id as varchar) as case_id, sha256(text) as expected from documents"),
}
