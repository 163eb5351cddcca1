"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quarry.llm import decontaminate, langid, neardup, quality, repeats, resample, rules, sharding, substrings, tokens, urls, vectors
from quarry.llm.common import crc_mod, pick, table


def op1_bpe(spark, sf_dir):
    """Every whole text encoded and decoded again, as digests; a null text is empty."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = tokens.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_decontaminate(spark, sf_dir):
    """Words of every whole text that stand in windows of the benchmark; null texts have no words."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"], cleaned=False)
    hit = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s[1] - s[0]).cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op3_sharding(spark, sf_dir):
    """Every document in one of 24 shards of a bounded ring, counts at most one apart."""
    dealt = sharding.shard(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality(spark, sf_dir):
    """The score of every whole text by the line model, learned from labels that aren't held out; null and empty texts are scored as one empty line."""
    docs = pick(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    labels = pick(table(spark, sf_dir, "labels"), ["doc_id", "quality"])
    model = quality.fit(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("bad_lines").alias("n_bad_lines"))


def op5_suffix_dedup(spark, sf_dir):
    """Bytes of every whole text without the 50-byte strings that a document of smaller id has; null texts are empty."""
    left = repeats.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_counts(spark, sf_dir):
    """Tokens of every whole text by the library's rules; null texts have none."""
    docs = pick(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    docs = docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    counted = tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op7_language_id(spark, sf_dir):
    """The language of every whole text, learned from rows that aren't held out; `und` without a letter."""
    docs = pick(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"])
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 5) != 0)
    found = langid.predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "languages")


def op8_quality_rules(spark, sf_dir):
    """Measures of every whole text and the verdict on common lines; null texts have no words and fail."""
    return rules.judge_lines(table(spark, sf_dir, "documents"))


def op9_minhash(spark, sf_dir):
    """The component of every document by four-word shingles; documents without words are alone."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op10_url_filter(spark, sf_dir):
    """Host, path, rule and verdict of every page's url; null urls are allowed."""
    return urls.judge(table(spark, sf_dir, "pages"), keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


def op11_vector_codes(spark, sf_dir):
    """Codes of every whole vector by codebooks of integers; rows without a finite vector are dropped."""
    rows = pick(table(spark, sf_dir, "embeddings"), ["vec_id", "embedding", "label"])
    books = vectors.fit(rows)
    coded = vectors.add_group_error(vectors.encode(rows, books, keep=["vec_id", "label"]), new="label_error")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_substring_dedup(spark, sf_dir):
    """Words of every whole text without the 20-word windows that start earlier; null texts have no words."""
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_resample(spark, sf_dir):
    """Weight, score and rank of every document, a quarter drawn towards the benchmark; null texts have no words and aren't drawn."""
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries():
    return {f.__name__: f for f in (op1_bpe, op2_decontaminate, op3_sharding, op4_quality, op5_suffix_dedup, op6_token_counts, op7_language_id, op8_quality_rules, op9_minhash, op10_url_filter, op11_vector_codes, op12_substring_dedup, op13_resample)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


def _terms(terms) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


OP2 = rf"""
with word as (select 'd' as side, cast(doc_id as varchar) as id, regexp_extract_all({_lowered("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all select 'b', item_id, regexp_extract_all({_lowered("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
item as (select distinct id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as t from word, range(1, 20000) r(i) where side = 'b' and len(w) > 0 and i <= greatest(1, len(w) - 9)),
size as (select distinct n from item),
doc as (select id, n, i, array_to_string(w[i:i + n - 1], ' ') as t from (select id, w, n, unnest(range(1, len(w) - n + 2)) as i from word, size where side = 'd')),
met as (select d.id, d.i, d.n, b.id as item from doc d join item b on d.n = b.n and d.t = b.t),
hit as (select id, count(distinct p) as n_hit from (select id, unnest(range(i, i + n)) as p from met) group by 1),
items as (select id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct id, item from met) group by 1)
select w.id::bigint as doc_id, len(w.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from word w left join hit using (id) left join items using (id) where side = 'd'"""

OP5 = """
with doc as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
win as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, greatest(n - 49, 0))) as i from doc)),
hit as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as f from win) where f < doc_id),
span as (select doc_id, min(i) as a, max(i) + 50 as b from (select doc_id, i, sum(new) over (partition by doc_id order by i) as g from (select doc_id, i, case when i > 50 + lag(i) over (partition by doc_id order by i) then 1 else 0 end as new from hit)) group by doc_id, g),
piece as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from span),
gone as (select doc_id, count(*) as n_spans, sum(b - a)::bigint as n_removed, max(b) as ends from span group by 1),
kept as (select p.doc_id, string_agg(substr(d.h, 2 * p.before + 1, 2 * (p.a - p.before)), '' order by p.a) as k from piece p join doc d using (doc_id) group by 1)
select d.doc_id, d.n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(ends, 0) + 1))) as kept_sha256 from doc d left join gone using (doc_id) left join kept using (doc_id)"""

OP8 = r"""
with doc as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
line as (select doc_id, source, trim(regexp_replace(lower(translate(l, chr(9) || chr(11) || chr(12) || chr(13), '    ')), ' +', ' ', 'g'), ' ') as l from (select doc_id, source, unnest(string_split(t, chr(10))) as l from doc)),
host as (select source as o, count(distinct doc_id) as n from documents group by 1),
common as (select source, l from line join host on o is not distinct from source where l <> '' group by source, l, host.n having count(distinct doc_id) > 20 and count(distinct doc_id) > 0.01 * host.n),
lost as (select doc_id, sum(length(line.l) - length(replace(line.l, ' ', '')) + 1)::bigint as n from line join common c on c.l = line.l and c.source is not distinct from line.source group by 1),
win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from doc)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from win) where n > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from twice) group by 1),
dup as (select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(t, chr(10))) as l from doc) where regexp_matches(l, '[^\x20\x09-\x0D]') group by 1),
base as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(lost.n, 0) as common_words from doc d left join dup using (doc_id) left join rep using (doc_id) left join lost using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_words - common_words >= 0.3 * n_words as kept, common_words from base"""

OP9 = rf"""
with recursive word as (select doc_id, regexp_extract_all({_lowered("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
gram as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from word where len(w) > 0)),
size as (select doc_id, count(*) as n from gram group by 1),
met as (select a.doc_id as x, b.doc_id as y, count(*) as n from gram a join gram b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
edge as (select x, y from met join size s on s.doc_id = x join size t on t.doc_id = y where 100 * met.n >= 80 * (s.n + t.n - met.n)),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, e.t from reach r join (select x as f, y as t from edge union all select y, x from edge) e on r.y = e.f)
select d.doc_id, coalesce(s.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept from documents d left join size s using (doc_id) join (select x as doc_id, min(y) as component_id from reach group by 1) c using (doc_id)"""

_FITS = "\n".join(f"when (host = '{r[: r.index('/')]}' or ends_with(host, '.{r[: r.index('/')]}')) and starts_with(path, '{r[r.index('/') :]}') then '{r}'" for r, _ in sorted(urls.RULES, key=lambda r: -len(r[0])))
_SAYS = " ".join(f"when '{r}' then '{v}'" for r, v in urls.RULES)
OP10 = f"""
with part as (select page_id, coalesce({_lowered("regexp_extract(url, '://([^/?#]*)', 1)")}, '') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
judged as (select *, case {_FITS} end as rule, {_lowered("host || path")} as site from part)
select page_id, host, path, rule, case rule {_SAYS} else case when len(list_filter({_terms(urls.STRICT)}, lambda x: regexp_matches(site, '(^|[^a-z])' || x || '([^a-z]|$)'))) > 0 or len(list_filter({_terms(urls.SOFT)}, lambda x: regexp_matches(site, '(^|[^a-z])' || x || '([^a-z]|$)'))) >= 2 then 'block' else 'allow' end end as verdict from judged"""


def _op11() -> str:
    """Six rounds of assignment to the nearest of 16 entries and floored means, each round a query of its own."""
    steps = ["""kept as (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
part as materialized (select vec_id, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] as v from kept, range(8) r(p)),
book0 as materialized (select p, (row_number() over (partition by p order by vec_id) - 1)::int as e, v from part where vec_id in (select vec_id from kept order by vec_id limit 16))"""]
    for r in range(7):
        steps.append(f"near{r} as materialized (select vec_id, p, v, d // 16 as d, (d % 16)::int as e from (select vec_id, part.p, any_value(part.v) as v, min(16 * list_sum(list_transform(list_zip(part.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint + b.e) as d from part join book{r} b using (p) group by vec_id, part.p))")
        if r < 6:
            steps.append(f"""mean{r} as (select p, e, list((s - ((s % n) + n) % n) // n order by i) as v from (select p, e, i, count(*) as n, sum(v[i])::bigint as s from near{r}, range(1, 1 + (select max(len(v)) from part)) r(i) group by p, e, i) group by p, e),
book{r + 1} as materialized (select p, e, coalesce(m.v, b.v) as v from book{r} b left join mean{r} m using (p, e))""")
    return "with " + ",\n".join(steps) + """,
coded as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from near6 group by vec_id)
select c.vec_id, code, error, (sum(error) over (partition by k.label))::bigint as label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from book6) as codebooks_sha256 from coded c join kept k using (vec_id)"""


OP12 = r"""
with word as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from word)),
hit as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as r from win) where r > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from hit),
kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from word) anti join gone using (doc_id, p) group by 1)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from word left join kept using (doc_id)"""


def _crc32() -> str:
    """crc32 of a blob ``f``, byte by byte from its hexadecimal digits; the table comes from the polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(f)), lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, {table}[xor(c, b) % 256 + 1])), 4294967295)"


OP13 = rf"""
with word as (select 'd' as side, doc_id::varchar as id, regexp_extract_all({_lowered("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all select 'b', item_id::varchar, regexp_extract_all({_lowered("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
gram as (select side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as g from word),
seen as (select g, encode(g) as f from (select distinct g from gram)),
code as materialized (select g, {_crc32()} % 10000 as b from seen),
feature as materialized (select side, id, b, count(*) as n from gram join code using (g) group by all),
both_ as (select b, coalesce(sum(n) filter (side = 'd'), 0)::double as s, coalesce(sum(n) filter (side = 'b'), 0)::double as t from (select side, b, n from feature union all select 'd', unnest(range(10000)), 0) group by b),
gain as (select b, floor(1000 * ln((t + 1) * ((select sum(s) from both_) + 10000) / ((s + 1) * ((select sum(t) from both_) + 10000))))::bigint as gain from both_),
weighed as (select id, sum(n)::bigint as n_features, sum(n * gain)::bigint as total from feature join gain using (b) where side = 'd' group by id),
scored as (select id::bigint as doc_id, len(w) as words, coalesce(n_features, 0) as n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::bigint as weight, floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as noise from word left join weighed using (id) where side = 'd'),
ranked as (select doc_id, row_number() over (order by weight + noise desc, doc_id) as r from scored where words >= 20)
select doc_id, n_features, weight, weight + noise as score, case when r <= (select count(*) * 25 // 100 from ranked) then r end as rank from scored left join ranked using (doc_id)"""


def oracle_sql():
    return {"op2_decontaminate": OP2, "op5_suffix_dedup": OP5, "op8_quality_rules": OP8, "op9_minhash": OP9, "op10_url_filter": OP10, "op11_vector_codes": _op11(), "op12_substring_dedup": OP12, "op13_resample": OP13}
