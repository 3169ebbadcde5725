"""One named query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadmerge.llm.common import table
from leadmerge.llm.decontamination import contaminated
from leadmerge.llm.embeddings import embedding_duplicates
from leadmerge.llm.hmm import hmm_scores
from leadmerge.llm.html import extract_pages
from leadmerge.llm.jaccard import jaccard_components
from leadmerge.llm.licenses import license_scan
from leadmerge.llm.mixing import mix_sources
from leadmerge.llm.neighbours import nearest_neighbours
from leadmerge.llm.search import lexical_search
from leadmerge.llm.substrings import substring_dedup
from leadmerge.llm.tokens import token_counts
from leadmerge.llm.toxicity import toxicity
from leadmerge.llm.variants import variant_groups


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_sentences", "n_removed", "text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hmm_scores, op2_token_counts, op3_html_extraction, op4_jaccard_join, op5_embedding_duplicates,
        op6_mixing, op7_decontamination, op8_substring_dedup, op9_license_scan, op10_toxicity,
        op11_lexical_search, op12_nearest_neighbours, op13_spelling_variants,
    )
}
# The others learn, hash, round at random or compare approximately: tested against
# brute force instead.
SQL: dict[str, str] = {
    "op4_jaccard_join": r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w
  from documents),
grams as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from worded where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as common
  from grams x join grams y on x.g = y.g and x.doc_id < y.doc_id group by all),
links as (
  select a, b from pairs join sizes s on s.doc_id = a join sizes t on t.doc_id = b
  where 100 * common >= 75 * (s.n + t.n - common)),
edges as (select a, b from links union all select b, a from links),
reach as (
  select a, b from edges
  union
  select r.a, e.b from reach r join edges e on r.b = e.a)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id
from documents d left join sizes using (doc_id)
left join (select a as doc_id, min(b) as m from reach group by a) using (doc_id)""",
    "op11_lexical_search": r"""
with worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
docs as (select row_number() over () as k, doc_id, w, len(w) as n from worded where len(w) > 0),
totals as (select count(*) as total, cast(sum(n) as bigint) as length from docs),
tokens as (select k, unnest(w) as term from docs),
counted as (select k, term, count(*) as tf from tokens group by all),
asked as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
weights as (
  select term, cast(floor(1000 * ln(cast(2 * total + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w
  from (select term, count(*) as df from counted group by term), totals),
scored as (
  select a.item_id, d.doc_id, d.k,
         cast(sum(x.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * d.n * t.total) // t.length)))) as bigint) as score
  from asked a join counted c on c.term = a.term join weights x on x.term = a.term join docs d on d.k = c.k, totals t
  group by a.item_id, d.doc_id, d.k),
ranked as (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as r
  from scored where score > 0)
select item_id, cast(r as integer) as rank, doc_id, score from ranked where r <= 50""",
    "op13_spelling_variants": r"""
with recursive bits as (
  select [list_reduce(list_prepend(b, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)
          for b in range(256)] as step),
runs as (
  select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) as run
  from documents),
lowered as (
  select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as k
  from runs group by all),
bytes as (
  select id, run, k, hex(encode(id || ':' || run)) as x from lowered),
hashed as (
  select run, k, xor(4294967295, list_reduce(list_prepend(4294967295, [cast('0x' || x[2 * i + 1 : 2 * i + 2] as bigint) for i in range(length(x) // 2)]),
      lambda c, b: xor(c >> 8, step[cast(xor(c, b) & 255 as integer) + 1]))) as h
  from bytes, bits),
spelled as (
  select case when h % 31 = 0 then run[1 : h % length(run)] || run[h % length(run) + 2 :] else run end as word, k from hashed),
words as (
  select word, cast(sum(k) as bigint) as n from spelled where length(word) >= 7 group by word having sum(k) >= 2),
plain as (
  select word, n, translate(word, (select string_agg(chr(cast(c as integer)), '' order by c) from range(192, 256) t(c)),
      (select string_agg(chr(cast(c as integer)), '' order by c) from range(33, 97) t(c))) as p from words),
pieces as (
  select word, n, p, unnest([p] || [p[1 : i] || p[i + 2 :] for i in range(length(p))]) as piece from plain),
pairs as (
  select distinct a.word, b.word as near, b.n as m
  from pieces a join pieces b on a.piece = b.piece and a.word <> b.word
  where levenshtein(a.p, b.p) = 1),
best as (
  select word, count(*) as n_near, arg_min(near, (-m, near)) as form, max(m) as form_n from pairs group by word),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 10 * w.n then form end as form,
         case when form_n >= 10 * w.n then form_n end as form_n
  from words w left join best b on b.word = w.word),
chain as (
  select word, word as root, 0 as steps from forms
  union all
  select c.word, f.form, c.steps + 1 from chain c join forms f on f.word = c.root where f.form is not null)
select word, n, n_near, form, form_n, (select arg_max(root, steps) from chain c where c.word = f.word) as root from forms f""",
}
