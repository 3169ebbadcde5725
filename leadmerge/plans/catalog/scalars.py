"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmerge import functions as fn
from leadmerge.plans.catalog.leads import (
    LEADS_SQL, base_leads, secondary_leads,
)
from leadmerge.plans.catalog.registry import Tables, query, text_time
from leadmerge.sources.sinks import csv_lines

STOPWORDS_SQL = "('ltd','limited','llp','llc','plc','inc','co','company','the','and','')"
SPACE_SQL = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


@query(f"""
with {LEADS_SQL}
select source, rec_id, phone_raw, match_key as phone,
       coalesce(match_key, '+44' || cast(2000000000 + rec_id as varchar)) as first_phone
from leads""")
def phone_normalize(t: Tables):
    leads = base_leads(t).unionByName(secondary_leads(t))
    spare = F.concat(F.lit("0"), (F.col("rec_id") + 2000000000).cast("string"))
    return leads.select(
        "source", "rec_id", "phone_raw",
        fn.normalize_uk_phone(F.col("phone_raw")).alias("phone"),
        fn.first_uk_phone(F.lit("N/A"), F.col("phone_raw"), spare).alias("first_phone"),
    )


@query(f"with {LEADS_SQL} select dedup_key, match_key from leads")
def match_key(t: Tables):
    leads = base_leads(t).unionByName(secondary_leads(t))
    return leads.select(
        F.concat_ws("-", "source", F.col("rec_id").cast("string")).alias("dedup_key"),
        fn.match_key(F.col("phone_raw")).alias("match_key"),
    )


URL_PARTS_SQL = """
rest as (select page_id, url, split_part(regexp_replace(url, '^https?://', ''), '#', 1) as r from pages),
parts as (select page_id, url, split_part(r, '?', 1) as loc,
                 substr(r, length(split_part(r, '?', 1)) + 2) as q from rest),
split as (select page_id, url, q, lower(split_part(loc, '/', 1)) as host,
                 lower(rtrim(substr(loc, length(split_part(loc, '/', 1)) + 1), '/')) as path from parts)
"""


@query(f"""
with {URL_PARTS_SQL}
select page_id, url,
       host || case when path = '' then '/' else path end as permalink,
       case when host like '%example.com' then 'www.example.com'
            when host like '%example.net' then 'www.example.com' else host end
         || case when path = '' then '/' else path end
         || case when regexp_extract('&' || q, '&page=([^&]*)', 1) <> ''
                 then '?page=' || lower(regexp_extract('&' || q, '&page=([^&]*)', 1)) else '' end as page_link
from split""")
def permalink_normalize(t: Tables):
    grouped = fn.normalize_permalink(
        F.col("url"),
        params=("page",),
        short_hosts=(),
        suffixes=(("example.com", "www.example.com"), ("example.net", "www.example.com")),
    )
    return t.pages.select(
        "page_id", "url", fn.normalize_permalink(F.col("url")).alias("permalink"), grouped.alias("page_link")
    )


@query(f"""
with {URL_PARTS_SQL}
select host, case when host like '%example.com' or host like '%example.org' then 'one.example'
                  else host end as canonical_host, count(*) as pages
from split group by all""")
def canonical_hosts(t: Tables):
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    rules = (("example.com", "one.example"), ("example.org", "one.example"))
    hosts = t.pages.select(host.alias("host"))
    return hosts.groupBy("host", fn.canonical_host(F.col("host"), (), rules).alias("canonical_host")).agg(
        F.count("*").alias("pages")
    )


@query("""
select page_id,
       coalesce(nullif(regexp_extract(url, '/(?:en|fr|de|es)/([0-9]+)', 1), ''),
                nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '')) as post_id,
       coalesce(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), ''),
                nullif(regexp_extract(url, '/(?:en|fr|de|es)/([0-9]+)', 1), '')) as page_first,
       coalesce(nullif(regexp_extract(url, 'th[a-z]+r', 0), ''),
                nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '')) as token_first
from pages""")
def post_id_extract(t: Tables):
    path, page = r"(?i)/(?:en|fr|de|es)/(\d+)", r"(?i)[?&]page=(\d+)"
    url = F.col("url")
    return t.pages.select(
        "page_id",
        fn.extract_post_id(url, (path, page), None).alias("post_id"),
        fn.extract_post_id(url, (page, path), None).alias("page_first"),
        fn.extract_post_id(url, (page,), "th[a-z]+r").alias("token_first"),
    )


@query(f"""
select p_partkey,
       array_to_string(list_filter(
         string_split_regex(lower(p_name || ' & The ' || p_brand || ', Ltd.'), '[^a-z0-9]+'),
         lambda w: w not in {STOPWORDS_SQL}), '') as business_key
from part""")
def business_key(t: Tables):
    name = F.concat(F.col("p_name"), F.lit(" & The "), F.col("p_brand"), F.lit(", Ltd."))
    return t.part.select("p_partkey", fn.business_key(name).alias("business_key"))


@query(f"""
select doc_id, sha256(array_to_string(list_filter(
         string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+'),
         lambda w: w not in {STOPWORDS_SQL}), '')) as key_hash
from documents""")
def business_key_text(t: Tables):
    return t.documents.select("doc_id", F.sha2(fn.business_key(F.col("text")), 256).alias("key_hash"))


@query("select doc_id, sha256(strip_accents(text)) as text_hash from documents")
def deaccent(t: Tables):
    return t.documents.select("doc_id", F.sha2(fn.deaccent(F.col("text")), 256).alias("text_hash"))


@query("select doc_id, sha256(strip_accents(text)) as text_hash from documents")
def deaccent_exact(t: Tables):
    return t.documents.select("doc_id", F.sha2(fn.deaccent_exact(F.col("text")), 256).alias("text_hash"))


@query("""
select s_suppkey,
       case when s_nationkey % 5 = 0 then null
            else 'supplier' || right(s_name, 9) || '|N' || s_nationkey || 'X' || s_suppkey end as fingerprint
from supplier""")
def fingerprint(t: Tables):
    place = F.concat_ws(" ", F.concat(F.lit(" n"), F.col("s_nationkey")), F.concat(F.lit("x"), F.col("s_suppkey")))
    postcode = F.when(F.col("s_nationkey") % 5 != 0, place)
    return t.supplier.select(
        "s_suppkey", fn.fingerprint(F.concat(F.col("s_name"), F.lit(" Ltd")), postcode).alias("fingerprint")
    )


@query("""
select c_custkey, sha256('NFULL|Company Name=' || c_name || chr(1) || 'County=null' || chr(1)
         || 'Segment=' || c_mktsegment || chr(1) || 'balance=' || cast(c_nationkey as varchar)) as row_hash
from customer""")
def row_hash(t: Tables):
    cells = F.create_map(
        F.lit("balance"), F.col("c_nationkey").cast("string"),
        F.lit("Segment"), F.col("c_mktsegment"),
        F.lit("County"), F.lit(None).cast("string"),
        F.lit("Company Name"), F.col("c_name"),
    )
    return t.customer.select("c_custkey", fn.row_hash(F.lit("NFULL"), cells).alias("row_hash"))


@query("""
with rendered as (
  select o_orderkey, case o_orderkey % 8
    when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S')
    when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
    when 2 then strftime(ts, '%-m/%-d/%Y %-H:%M:%S')
    when 3 then strftime(ts, '%-m/%-d/%Y')
    when 4 then strftime(ts, '%b %-d, %Y %H:%M:%S')
    when 5 then strftime(ts, '%Y/%m/%d %H:%M')
    when 6 then strftime(ts, '%Y-%m-%d %H:%M')
    else 'not a date ' || o_orderkey end as raw_time
  from (select o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) as ts from orders))
select o_orderkey, raw_time, strftime(coalesce(
    try_strptime(raw_time, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%SZ', '%m/%d/%Y %H:%M:%S', '%m/%d/%Y',
                            '%b %d, %Y %H:%M:%S', '%Y/%m/%d %H:%M', '%Y-%m-%d %H:%M'])),
    '%Y-%m-%d %H:%M:%S') as parsed
from rendered""")
def tolerant_timestamp(t: Tables):
    ts = F.timestamp_micros(
        F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 86400) * 1000000
    )
    shapes = (
        "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "M/d/yyyy H:mm:ss", "M/d/yyyy",
        "MMM d, yyyy HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd HH:mm",
    )
    kind = F.col("o_orderkey") % 8
    raw = F.when(kind == 7, F.concat(F.lit("not a date "), F.col("o_orderkey")))
    for i, shape in enumerate(shapes):
        raw = raw.when(kind == i, F.date_format(ts, shape))
    rendered = t.orders.select("o_orderkey", raw.alias("raw_time"))
    return rendered.withColumn("parsed", text_time(fn.tolerant_timestamp(F.col("raw_time"))))


@query("""
select o_orderkey,
       case o_orderkey % 4 when 0 then null when 1 then null when 2 then o_orderkey || '@x.org' else null end as email
from orders""")
def clean_email(t: Tables):
    key = F.col("o_orderkey")
    raw = (
        F.when(key % 4 == 0, F.lit(" . "))
        .when(key % 4 == 1, F.lit("  "))
        .when(key % 4 == 2, F.concat(F.lit(" "), key, F.lit("@x.org ")))
    )
    return t.orders.select("o_orderkey", fn.clean_email(raw).alias("email"))


@query("""
select event_id, round(greatest(0, least(100, case
    when event_type in ('click', 'view') then value * 3
    when event_type = 'error' then 0 when event_type = 'signup' then -value
    else 0 end)), 4) as clamped
from events""")
def clamp(t: Tables):
    value = F.col("value")
    raw = (
        F.when(F.col("event_type").isin("click", "view"), (value * 3).cast("string"))
        .when(F.col("event_type") == "error", F.lit("n/a"))
        .when(F.col("event_type") == "signup", (-value).cast("string"))
        .otherwise(F.lit("Infinity"))
    )
    return t.events.select("event_id", F.round(fn.clamp(raw, 0, 100), 4).alias("clamped"))


@query("""
select o_orderkey,
       epoch(timestamp '2031-06-01 12:30:00' - o_orderdate) / 3600 as age_hours,
       'stale_' || cast(floor(epoch(timestamp '2031-06-01 12:30:00' - o_orderdate) / 3600 + 0.5) as bigint) || 'h' as stale
from orders""")
def age_hours(t: Tables):
    as_of = "2031-06-01 12:30:00"
    ts = F.col("o_orderdate").cast("timestamp")
    return t.orders.select("o_orderkey", fn.age_hours(ts, as_of).alias("age_hours"), fn.stale_text(ts, as_of).alias("stale"))


FLAT_SQL = f"regexp_replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


@query(f"""
with flat as (select doc_id, source, {FLAT_SQL} as line_text from documents)
select doc_id || ',' || case when regexp_matches(line_text, '[",]')
         then '"' || replace(line_text, '"', '""') || '"' else line_text end || ',' || source as line
from flat""")
def csv_rows(t: Tables):
    rows = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source")
    return csv_lines(rows, ("doc_id", "text", "source"))


@query(f"""
with inner_text as (
  select event_id, event_type,
    case event_type when 'view' then 'oops ' || props
      else '{{"verdict":"' || upper(event_type) || '","opportunity_score":'
        || regexp_extract(props, '[0-9]+', 0) || ',"red_flags":["r' || user_id || '"]}}' end as doc,
    regexp_extract(props, '[0-9]+', 0) as k, user_id
  from events)
select event_id,
  case event_type when 'view' then null when 'error' then null else upper(event_type) end as verdict,
  case event_type when 'view' then null when 'error' then null else k end as score,
  case event_type when 'view' then null when 'error' then null else 'r' || user_id end as red_flags,
  event_type in ('view', 'error') as malformed
from inner_text""")
def verdict_json(t: Tables):
    k = F.regexp_extract("props", "[0-9]+", 0)
    inner = F.concat(
        F.lit('{"verdict":"'), F.upper("event_type"), F.lit('","opportunity_score":'), k,
        F.lit(',"red_flags":["r'), F.col("user_id"), F.lit('"]}'),
    )
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(F.lit("oops "), F.col("props")))
        .when(kind == "click", F.concat(F.lit("```json\n"), inner, F.lit("\n```")))
        .otherwise(inner)
    )
    wrapped = F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("content")))
    response = F.when(kind == "signup", inner).when(kind == "error", F.lit("{")).otherwise(wrapped)
    decoded = t.events.select("event_id", fn.decode_verdict(response).alias("v"))
    return decoded.select(
        "event_id",
        F.col("v.verdict").alias("verdict"),
        F.col("v.opportunity_score").alias("score"),
        F.array_join("v.red_flags", "|").alias("red_flags"),
        F.col("v").isNull().alias("malformed"),
    )
