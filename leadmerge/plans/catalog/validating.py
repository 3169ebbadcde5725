"""Screening, decisions, evidence and the job queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadmerge.functions import error_text
from leadmerge.operators import queue, validation as vl
from leadmerge.plans.catalog.registry import Tables, joined, query, text_time

# Words that occur in the test texts.
WORDS = {"wordy": ("that ", "with"), "legal": ("license",), "french": (" fr", "eaux"), "free": ("free",)}
EXCLUDING = ("legal", "free")
AS_OF = "2025-03-04 12:00:00"

FLAGS_SQL = """
case when contains(b, 'that ') or contains(b, 'with') then ['wordy'] else [] end
  || case when contains(b, 'license') then ['legal'] else [] end
  || case when contains(b, ' fr') or contains(b, 'eaux') then ['french'] else [] end
  || case when contains(b, 'free') then ['free'] else [] end
"""
# Documents as leads: some without link, blank, old or without contact.
DOCS_SQL = f"""
leads as (
  select d.doc_id, cast(d.doc_id as varchar) as dedup_key,
         case when d.source = 'src3' then null else d.source end as norm_permalink,
         case when d.n_chars % 11 = 0 then '  ' else d.text end as message, d.lang as location,
         timestamp '2025-03-04 12:00:00' - to_seconds(d.n_chars * 60) as post_timestamp,
         'Doc ' || d.doc_id as business_name,
         case when d.n_chars % 2 = 0 then '01130 ' || d.doc_id end as phone, d.lang as postcode,
         l.quality, l.toxic, d.n_chars, d.text
  from documents d left join labels l using (doc_id)),
flagged as (
  select *, case when norm_permalink is null then 'missing_or_invalid_proof'
                 when trim(message) = '' then 'missing_message'
                 when n_chars / 60.0 > 24 then 'stale_' || cast(floor(n_chars / 60.0 + 0.5) as bigint) || 'h' end as reject_reason,
         lower(message || ' ' || location) as b
  from leads),
screened as (
  select *, case when reject_reason is null then {FLAGS_SQL} else [] end as flags from flagged),
scored as (
  select *,
    case when quality is null then '' when quality = 0 then 'BAD' when toxic = 1 then 'ODD' else 'GOOD' end as word,
    least(n_chars % 120, 100) as score
  from screened),
decided0 as (
  select *, case when word = 'BAD' then 'REJECTED' when word = '' then 'REVIEW_REQUIRED'
                 when score >= 75 then 'APPROVED' when score >= 50 then 'REVIEW_REQUIRED' else 'REJECTED' end as first
  from scored),
decided as (
  select *, first = 'APPROVED' and len(list_intersect(flags, ['legal', 'free'])) > 0 as disagreement,
         case when first = 'APPROVED' and len(list_intersect(flags, ['legal', 'free'])) > 0
              then 'REVIEW_REQUIRED' else first end as decision
  from decided0)
"""


def document_leads(t: Tables) -> DataFrame:
    n, as_of = F.col("n_chars"), F.lit(AS_OF).cast("timestamp")
    return t.documents.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("dedup_key"),
        F.when(F.col("source") != "src3", F.col("source")).alias("norm_permalink"),
        F.when(n % 11 == 0, F.lit("  ")).otherwise(F.col("text")).alias("message"),
        F.col("lang").alias("location"),
        F.timestamp_seconds(F.unix_timestamp(as_of) - n * 60).alias("post_timestamp"),
        F.concat(F.lit("Doc "), F.col("doc_id")).alias("business_name"),
        F.when(n % 2 == 0, F.concat(F.lit("01130 "), F.col("doc_id"))).alias("phone"),
        F.col("lang").alias("postcode"),
        "n_chars",
    )


def label_verdicts(t: Tables) -> DataFrame:
    """Responses from the labels; a document without label gets an empty verdict."""
    docs = t.documents.select("doc_id", "n_chars", F.contains("text", F.lit("the")).alias("has_the"))
    rows = docs.join(t.labels, "doc_id", "left")
    word = (
        F.when(F.col("quality").isNull(), F.lit("")).when(F.col("quality") == 0, F.lit("bad"))
        .when(F.col("toxic") == 1, F.lit("Odd")).otherwise(F.lit("GOOD"))
    )
    flag = F.col("has_the")
    caption = F.struct(
        flag.alias("has_opening_keywords"), F.lit(False).alias("has_relocation_keywords"),
        F.lit(False).alias("has_ownership_keywords"), (F.col("n_chars") % 3 == 0).alias("has_minor_update_keywords"),
    )
    verdict = F.struct(
        word.alias("verdict"), (F.col("n_chars") % 120).alias("opportunity_score"),
        F.when(F.col("n_chars") % 7 != 0, F.col("n_chars") % 130).alias("confidence"),
        F.array(F.concat(F.lit("n"), F.col("n_chars"))).alias("key_factors"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("red_flags"),
        F.lit("by label").alias("reasoning"), caption.alias("caption_analysis"),
    )
    body = F.to_json(F.struct(F.array(F.struct(F.to_json(verdict).alias("text"))).alias("content")))
    return rows.select(
        F.col("doc_id").cast("string").alias("dedup_key"), body.alias("response_json"),
        F.lit(None).cast("string").alias("error"),
    )


def decided(t: Tables) -> DataFrame:
    """Screened documents with their decision, deterministic rejects included."""
    jobs = document_leads(t).select(
        "dedup_key", F.concat(F.lit("job-"), "dedup_key").alias("job_id"), F.lit(1).alias("attempt_count")
    )
    return vl.validate_batch(
        jobs, document_leads(t), label_verdicts(t), AS_OF, keywords=WORDS, excluding=EXCLUDING
    )


@query(f"with {DOCS_SQL} select doc_id, array_to_string({FLAGS_SQL}, '|') as flags from flagged")
def keyword_flags(t: Tables):
    flags = vl.keyword_flags(F.col("message"), F.col("location"), WORDS)
    return document_leads(t).select("doc_id", joined(flags).alias("flags"))


@query(f"with {DOCS_SQL} select doc_id, reject_reason, array_to_string(flags, '|') as flags from screened")
def rules_screen(t: Tables):
    rows = vl.screen(document_leads(t), AS_OF, keywords=WORDS)
    return rows.select("doc_id", "reject_reason", joined(F.col("flags")).alias("flags"))


@query(f"""
with {DOCS_SQL}
select dedup_key, decision, disagreement, cast(score as integer) as score,
       case when n_chars % 7 <> 0 then round(least(n_chars % 130, 100) / 100.0, 4) end as confidence,
       case when contains(text, 'the') then 'COMMERCIAL_COT' else 'UNKNOWN' end as lead_type,
       case when score >= 75 then 'HIGH' when score >= 50 then 'MEDIUM' else 'LOW' end as intent,
       case when word = 'GOOD' then 'TRADING' else 'UNKNOWN' end as business_status,
       case when phone is null then 'NO_CONTACT' else 'CONTACT_FOUND' end as contact_status,
       n_chars % 3 = 0 as is_promotional, decision = 'REVIEW_REQUIRED' as requires_manual_review
from decided where reject_reason is null""")
def verdict_decision(t: Tables):
    rows = decided(t).where("outcome = 'decided'")
    return rows.select(
        "dedup_key", "decision", "disagreement", "score", F.round("confidence", 4).alias("confidence"),
        "lead_type", "intent", "business_status", "contact_status", "is_promotional", "requires_manual_review",
    )


@query(f"""
with {DOCS_SQL}
select dedup_key, 'n' || n_chars || case when toxic = 1 then '|⚠ toxic' else '' end || '|by label'
       || case when disagreement then '|Deterministic rules flagged excluded signals; routed to manual review.' else '' end as reasons
from decided where reject_reason is null""")
def decision_reasons(t: Tables):
    rows = decided(t).where("outcome = 'decided'")
    return rows.select("dedup_key", joined(F.col("reasons")).alias("reasons"))


@query(f"""
with {DOCS_SQL}
select dedup_key, 'job-' || dedup_key as job_id, 'Deterministic reject: ' || reject_reason as reasons, 'REJECTED' as decision,
       0 as score, 1.0 as confidence, case when phone is null then 'NO_CONTACT' else 'CONTACT_FOUND' end as contact_status,
       'deterministic' as layer, '1.1.0' as rules_version, business_name, postcode
from screened where reject_reason is not null""")
def reject_rows(t: Tables):
    rows = vl.reject_records(decided(t).where("outcome = 'rejected'"))
    return rows.select(
        "dedup_key", "job_id", joined(F.col("reasons")).alias("reasons"), "decision", "score", "confidence",
        "contact_status", "layer", "rules_version", "extracted.business_name", "extracted.postcode",
    )


@query(f"""
with {DOCS_SQL}
select dedup_key, 'job-' || dedup_key as job_id, decision, cast(score as integer) as score, 'ai' as layer,
       '1.1.0' as rules_version, 'validator-remote' as prompt_version, business_name, phone,
       cast(null as integer) as prompt_tokens, false as is_residential, true as has_raw
from decided where reject_reason is null""")
def result_rows(t: Tables):
    rows = vl.result_records(decided(t).where("outcome = 'decided'"))
    return rows.select(
        "dedup_key", "job_id", "decision", "score", "layer", "rules_version", "prompt_version",
        "extracted.business_name", "extracted.phone", "prompt_tokens", "is_residential",
        F.col("raw").isNotNull().alias("has_raw"),
    )


@query(f"""
with {DOCS_SQL}, jobs as (select *, doc_id % 5 as attempts from decided)
select dedup_key,
  case when reject_reason is not null then 'rejected' when quality is null then 'failed' else 'decided' end as outcome,
  case when reject_reason is not null then 'COMPLETED'
       when quality is null then case when attempts >= 4 then 'FAILED' else 'RETRY' end
       when decision = 'REVIEW_REQUIRED' then 'MANUAL_REVIEW' else 'COMPLETED' end as job_status,
  case when reject_reason is not null then 'REJECTED'
       when quality is null then case when attempts >= 4 then 'REVIEW_REQUIRED' end
       else decision end as lead_status,
  case when reject_reason is null and quality is null and attempts < 4
       then strftime(timestamp '2025-03-04 12:00:00' + to_minutes(attempts * 5), '%Y-%m-%d %H:%M:%S') end as next_retry_at,
  case when reject_reason is null and quality is null then 'no verdict' end as last_error
from jobs""")
def validate_batch(t: Tables):
    jobs = document_leads(t).select(
        "dedup_key", F.concat(F.lit("job-"), "dedup_key").alias("job_id"),
        (F.col("doc_id") % 5).cast("int").alias("attempt_count"),
    )
    labelled = t.labels.select(F.col("doc_id").cast("string").alias("dedup_key"))
    verdicts = label_verdicts(t).join(labelled, "dedup_key", "left_semi")
    rows = vl.validate_batch(jobs, document_leads(t), verdicts, AS_OF, keywords=WORDS, excluding=EXCLUDING)
    moved = queue.after_outcome(rows, AS_OF)
    return moved.select(
        "dedup_key", "outcome", "job_status", "lead_status", text_time(F.col("next_retry_at")).alias("next_retry_at"), "last_error"
    )


# -- evidence -------------------------------------------------------------------------------------

def benchmark_evidence(t: Tables) -> DataFrame:
    item = F.col("item_id")
    body = F.struct(
        F.when(item % 4 == 0, F.lit(False)).when(item % 4 == 1, F.lit(True)).alias("success"),
        F.when(item % 3 == 0, F.lit("not_found")).when(item % 3 == 1, F.lit("success")).alias("status"),
        F.col("text").alias("postText"), F.array(F.lit("p1"), F.lit("p2")).alias("previousPosts"),
        F.struct(F.concat(F.lit("author "), item).alias("author")).alias("rawData"),
    )
    return t.benchmark.select(item.cast("string").alias("dedup_key"), F.to_json(body).alias("evidence_json"))


@query("""
select cast(doc_id as varchar) as dedup_key, item_id is null as missing,
       case when item_id is not null then item_id % 4 <> 0 and item_id % 3 <> 0 end as post_exists,
       b.text as post_text, case when item_id is not null then 'author ' || item_id end as author,
       case when item_id is not null then 'p1|p2' end as previous_posts
from documents left join benchmark b on item_id = doc_id""")
def evidence_attach(t: Tables):
    masters = t.documents.select(F.col("doc_id").cast("string").alias("dedup_key"))
    stored = vl.evidence_records(benchmark_evidence(t))
    rows = vl.attach_evidence(masters, stored)
    return rows.select(
        "dedup_key", F.col("raw").isNull().alias("missing"), "post_exists", "post_text", "author",
        joined(F.col("previous_posts")).alias("previous_posts"),
    )


@query("select cast(doc_id as varchar) as dedup_key from documents where doc_id not in (select item_id from benchmark)")
def evidence_missing(t: Tables):
    masters = t.documents.select(F.col("doc_id").cast("string").alias("dedup_key"))
    return vl.needs_evidence(masters, vl.evidence_records(benchmark_evidence(t)))


@query("""
select 'job-' || d.doc_id as job_id, case when l.doc_id is null then 'missing' else 'failed' end as outcome,
       case when l.doc_id is null then 'COMPLETED' else 'RETRY' end as job_status
from documents d left join labels l using (doc_id)""")
def job_master_lookup(t: Tables):
    key = F.col("doc_id").cast("string")
    jobs = t.documents.select(key.alias("dedup_key"), F.concat(F.lit("job-"), key).alias("job_id"), F.lit(1).alias("attempt_count"))
    masters = document_leads(t).withColumn("norm_permalink", F.lit("x")).withColumn("message", F.lit("m"))
    known = masters.withColumn("post_timestamp", F.lit(None).cast("timestamp")).join(t.labels.select("doc_id"), "doc_id", "left_semi")
    verdicts = label_verdicts(t).withColumn("response_json", F.lit(None).cast("string"))
    moved = queue.after_outcome(vl.validate_batch(jobs, known, verdicts, AS_OF), AS_OF)
    return moved.select("job_id", "outcome", "job_status")


# -- queue ----------------------------------------------------------------------------------------

def job_log(t: Tables) -> DataFrame:
    """Events as a log of job states, one job per user and day."""
    ts, kind, k = F.col("ts").cast("timestamp"), F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    day = F.date_format(ts, "yyyy-MM-dd")
    status = (
        F.when(kind == "click", "PENDING").when(kind == "error", "RETRY").when(kind == "purchase", "COMPLETED")
        .when(kind == "signup", "PROCESSING").otherwise("FAILED")
    )
    return t.events.select(
        F.concat_ws("/", F.col("user_id").cast("string"), day).alias("job_id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("dedup_key"),
        status.alias("status"), (k % 5).alias("attempt_count"),
        F.when(kind == "error", F.timestamp_seconds(F.unix_timestamp(ts) + k * 3600)).alias("next_retry_at"),
        F.date_trunc("day", ts).alias("created_at"), ts.alias("updated_at"), F.lit(0).alias("step"),
    )


JOBS_SQL = """
log as (
  select user_id || '/' || strftime(ts, '%Y-%m-%d') as job_id, event_id, ts, date_trunc('day', ts) as created_at,
         case event_type when 'click' then 'PENDING' when 'error' then 'RETRY' when 'purchase' then 'COMPLETED'
              when 'signup' then 'PROCESSING' else 'FAILED' end as status,
         cast(regexp_extract(props, '[0-9]+', 0) as integer) as k,
         case when event_type = 'error' then date_trunc('second', ts) + to_hours(cast(regexp_extract(props, '[0-9]+', 0) as integer)) end as next_retry_at
  from events),
jobs as (select * from (select *, row_number() over (partition by job_id order by ts desc) as n from log) where n = 1),
due as (select * from jobs where status in ('PENDING', 'RETRY')
          and (next_retry_at is null or next_retry_at <= timestamp '2024-01-20 12:00:00'))
"""
CLAIM_AT = "2024-01-20 12:00:00"


@query(f"""
with {JOBS_SQL}
select job_id, status, k % 5 as attempt_count, strftime(next_retry_at, '%Y-%m-%d %H:%M:%S') as next_retry_at from due""")
def claimable_jobs(t: Tables):
    rows = queue.claimable(queue.current_jobs(job_log(t)), CLAIM_AT)
    return rows.select("job_id", "status", "attempt_count", text_time(F.col("next_retry_at")).alias("next_retry_at"))


@query(f"""
with {JOBS_SQL}
select job_id, 'PROCESSING' as status, k % 5 + 1 as attempt_count from (select * from due order by created_at, job_id limit 40)""")
def queue_claim(t: Tables):
    rows = queue.claim(queue.current_jobs(job_log(t)), CLAIM_AT, limit=40)
    return rows.select("job_id", "status", "attempt_count")


@query("""
with e as (select event_id, event_type, cast(regexp_extract(props, '[0-9]+', 0) as integer) % 7 as attempts from events)
select event_id,
  case event_type when 'click' then case when attempts >= 4 then 'FAILED' else 'RETRY' end
    when 'view' then 'MANUAL_REVIEW' else 'COMPLETED' end as job_status,
  case event_type when 'click' then case when attempts >= 4 then 'REVIEW_REQUIRED' end
    when 'view' then 'REVIEW_REQUIRED' when 'purchase' then 'APPROVED' when 'signup' then 'REJECTED' end as lead_status,
  case when event_type = 'click' and attempts < 4
    then strftime(timestamp '2024-01-20 12:00:00' + to_minutes(attempts * 5), '%Y-%m-%d %H:%M:%S') end as next_retry_at,
  case when event_type = 'click' then rpad('down', 500, 'x') end as last_error
from e""")
def queue_transition(t: Tables):
    kind = F.col("event_type")
    handled = t.events.select(
        "event_id",
        (F.get_json_object("props", "$.k").cast("int") % 7).alias("attempt_count"),
        F.when(kind == "click", "failed").when(kind.isin("view", "purchase"), "decided")
        .when(kind == "signup", "rejected").otherwise("missing").alias("outcome"),
        F.when(kind == "view", "REVIEW_REQUIRED").otherwise("APPROVED").alias("decision"),
        error_text(F.when(kind == "click", F.concat(F.rpad(F.lit("down"), 500, "x"), F.lit(" and more")))).alias("error_text"),
    )
    moved = queue.after_outcome(handled, CLAIM_AT)
    return moved.select(
        "event_id", "job_status", "lead_status", text_time(F.col("next_retry_at")).alias("next_retry_at"), "last_error"
    )


REQUEUE_SQL = """
waiting as (
  select o_orderkey, o_orderdate from orders where o_orderstatus = 'O' and not exists (
    select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'A' and l_linestatus = 'O'))
"""


def _order_queue(t: Tables) -> tuple[DataFrame, DataFrame]:
    masters = t.orders.select(
        F.col("o_orderkey").cast("string").alias("dedup_key"), F.col("o_orderdate").alias("created_at"), "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", "INGESTED").otherwise("APPROVED").alias("status"),
    )
    active = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")
    jobs = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("dedup_key"), F.when(active, "PENDING").otherwise("COMPLETED").alias("status")
    )
    return masters, jobs


@query(f"with {REQUEUE_SQL} select cast(o_orderkey as varchar) as dedup_key from waiting")
def requeue_candidates(t: Tables):
    return queue.requeue_candidates(*_order_queue(t)).select("dedup_key")


@query(f"with {REQUEUE_SQL} select cast(o_orderkey as varchar) as dedup_key from (select * from waiting order by o_orderdate, o_orderkey limit 25)")
def requeue_oldest(t: Tables):
    rows = queue.requeue_candidates(*_order_queue(t), limit=25, order=("created_at", "o_orderkey"))
    return rows.select("dedup_key")
