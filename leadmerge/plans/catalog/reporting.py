"""Lists, pages, statistics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadmerge.functions import on_date
from leadmerge.operators import listing, reports, stats
from leadmerge.operators.canonical import source_badge
from leadmerge.operators.merge import asymmetric_merge
from leadmerge.operators.queue import current_status, status_bucket
from leadmerge.plans.catalog.leads import LEADS_SQL, base_keyed, secondary_keyed, with_row_key
from leadmerge.plans.catalog.registry import Tables, joined, query, text_time


# Orders as masters, line items as links (by line status) and export marks (returned).
def order_masters(t: Tables) -> DataFrame:
    return t.orders.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("dedup_key"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
    )


def line_links(t: Tables) -> DataFrame:
    source = F.when(F.col("l_linestatus") == "O", F.lit("NFULL")).otherwise(F.lit("MFULL"))
    return t.lineitem.select(
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("dedup_key"), source.alias("source")
    )


def return_marks(t: Tables) -> DataFrame:
    returned = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))
    return returned.select(F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("dedup_key"))


LIST_SQL = """
masters as (select lpad(cast(o_orderkey as varchar), 12, '0') as dedup_key, o_orderkey, o_orderdate as created_at,
                   o_orderstatus as status from orders),
linked as (
  select m.*, (select string_agg(distinct case when l_linestatus = 'O' then 'NFULL' else 'MFULL' end, '|'
                 order by case when l_linestatus = 'O' then 'NFULL' else 'MFULL' end)
               from lineitem where l_orderkey = o_orderkey) as sources,
         exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity > 40) as exported
  from masters m)
"""
LIST_COLUMNS_SQL = "select dedup_key, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, status, sources, exported"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        "dedup_key", text_time(F.col("created_at")).alias("created_at"), "status",
        joined(F.col("sources")).alias("sources"), "exported",
    )


@query(f"""
with {LIST_SQL} {LIST_COLUMNS_SQL} from (
  select * from linked where sources is not null order by created_at desc, dedup_key desc limit 50 offset 100)""")
def lead_list_page(t: Tables):
    rows = listing.lead_list(order_masters(t), line_links(t), return_marks(t))
    return _shown(listing.page_of(rows, page=3, page_size=50))


@query(f"""
with {LIST_SQL} {LIST_COLUMNS_SQL} from (
  select * from linked where sources is not null and (created_at < timestamp '1998-01-01'
      or created_at = timestamp '1998-01-01' and dedup_key < '000000000100')
  order by created_at desc, dedup_key desc limit 100)""")
def lead_list_after(t: Tables):
    rows = listing.lead_list(order_masters(t), line_links(t), return_marks(t))
    return _shown(listing.page_after(rows, "1998-01-01 00:00:00", "000000000100"))


@query(f"with {LIST_SQL} {LIST_COLUMNS_SQL} from linked where status = 'F' and not exported and sources = 'MFULL|NFULL'")
def lead_list_filtered(t: Tables):
    rows = listing.lead_list(
        order_masters(t), line_links(t), return_marks(t), status="f", exported=False, source="both"
    )
    return _shown(rows)


@query(f"with {LIST_SQL} {LIST_COLUMNS_SQL} from linked where cast(created_at as date) = date '1998-03-01' and sources like '%NFULL%'")
def lead_list_of_day(t: Tables):
    rows = listing.lead_list(
        order_masters(t), line_links(t), return_marks(t), date="1998-03-01", source="NFULL"
    )
    return _shown(rows)


@query(f"""
with {LIST_SQL}
select cast(2 as bigint) as page, cast(70 as bigint) as page_size, count(*) as total,
       cast(ceil(count(*) / 70.0) as bigint) as total_pages
from linked where exported and sources = 'MFULL|NFULL'""")
def page_total(t: Tables):
    rows = listing.lead_list(
        order_masters(t), line_links(t), return_marks(t), exported=True, source="BOTH", mark_exported=False
    )
    return listing.page_summary(rows, page=2, page_size=70)


@query(f"with {LIST_SQL} select dedup_key, status, exported from linked")
def export_marks(t: Tables):
    return listing.with_exported(order_masters(t), return_marks(t)).select("dedup_key", "status", "exported")


# -- overlap of two sources: clicks and views per user and day ----------------------------------

def day_links(t: Tables) -> DataFrame:
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    return t.events.select(
        F.concat_ws("/", F.lpad(F.col("user_id").cast("string"), 9, "0"), day).alias("dedup_key"),
        F.col("event_type").alias("source"),
        F.col("ts").cast("timestamp").alias("first_seen"),
    )


PAIR = {"base": "click", "secondary": "view"}
DAYS_SQL = """
days as (
  select lpad(cast(user_id as varchar), 9, '0') || '/' || strftime(ts, '%Y-%m-%d') as dedup_key,
         event_type as source, ts as first_seen
  from events where event_type in ('click', 'view'))
"""


@query(f"with {DAYS_SQL} select dedup_key from days group by 1 having count(distinct source) = 2")
def found_by_both(t: Tables):
    return stats.found_by_both(day_links(t), **PAIR)


@query(f"with {DAYS_SQL} select dedup_key from days group by 1 having count(distinct source) = 1 and max(source) = 'view'")
def only_in_source(t: Tables):
    return stats.only_in(day_links(t), "view", **PAIR)


@query(f"""
with {DAYS_SQL}
select dedup_key, case when count(distinct source) = 2 then 'BOTH' else min(source) end as badge,
       string_agg(distinct source, '|' order by source) as sources
from days group by 1""")
def badge(t: Tables):
    sourced = listing.collect_sources(day_links(t), tuple(PAIR.values()))
    return sourced.select(
        "dedup_key", source_badge(F.col("sources")).alias("badge"), joined(F.col("sources")).alias("sources")
    )


@query(f"""
with {DAYS_SQL}
select dedup_key, 'User ' || substr(dedup_key, 1, 9) as business_name, 'phone +44' || substr(dedup_key, 1, 9) as matched_on
from days group by 1 having count(distinct source) = 2 order by dedup_key limit 10""")
def examples_top(t: Tables):
    links = day_links(t)
    user = F.substring("dedup_key", 1, 9)
    masters = links.select("dedup_key").distinct().select(
        "dedup_key",
        F.concat(F.lit("User "), user).alias("business_name"),
        F.concat(F.lit("+44"), user).alias("norm_phone"),
        F.lit(None).cast("string").alias("norm_permalink"),
    )
    return reports.both_examples(masters, links, **PAIR)


# -- statistics ---------------------------------------------------------------------------------

def merged_masters(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw leads, merged masters and links with a sighting per lead."""
    base, second = with_row_key(base_keyed(t)), with_row_key(secondary_keyed(t))
    masters = asymmetric_merge(base, second).withColumn(
        "possible_duplicate_of", F.when(F.col("match_key").isNull(), F.col("dedup_key"))
    )
    seen = F.timestamp_seconds(F.col("rec_id") % 10 * 86400 + 1740787200)
    links = masters.select("dedup_key", "source", seen.alias("first_seen"))
    return base.unionByName(second), masters, links


@query(f"""
with {LEADS_SQL}
select (select count(*) from merged) as combined_unique,
       (select count(*) from merged where match_key is null) as flagged_possible_duplicates,
       (select count(*) from leads) as total_occurrences,
       (select count(*) from merged where source = 'NFULL') as base_total,
       (select count(*) from merged where source = 'MFULL') as secondary_total,
       (select count(*) from merged where source = 'NFULL' and rec_id % 10 = 3) as base_today,
       (select count(*) from merged where source = 'MFULL' and rec_id % 10 = 3) as secondary_today,
       cast(0 as bigint) as found_by_both,
       (select count(*) from merged where source = 'NFULL') as base_only,
       (select count(*) from merged where source = 'MFULL') as secondary_only,
       (select count(*) from leads) - (select count(*) from merged) as duplicates_removed""")
def stats_overview(t: Tables):
    raw, masters, links = merged_masters(t)
    return stats.overview(masters, raw, links, "2025-03-04")


@query(f"""
with {DAYS_SQL}, per_key as (select dedup_key, count(*) filter (where source = 'click') as c,
                                    count(*) filter (where source = 'view') as v from days group by 1)
select (select count(*) from days where source = 'click') as base_total,
       (select count(*) from days where source = 'view') as secondary_total,
       (select count(*) from days where source = 'click' and cast(first_seen as date) = date '2024-01-05') as base_today,
       (select count(*) from days where source = 'view' and cast(first_seen as date) = date '2024-01-05') as secondary_today,
       (select count(*) from per_key where c > 0 and v > 0) as found_by_both,
       (select count(*) from per_key where c > 0 and v = 0) as base_only,
       (select count(*) from per_key where c = 0 and v > 0) as secondary_only""")
def link_counts(t: Tables):
    return stats.link_counts(day_links(t), "2024-01-05", **PAIR)


def event_results(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as lead statuses, as jobs (one per user) and as results."""
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_type")
    status = (
        F.when(kind == "click", "APPROVED").when(kind == "error", "REJECTED")
        .when(kind == "purchase", "REVIEW_REQUIRED").when(kind == "signup", "INGESTED").otherwise("VALIDATING")
    )
    statuses = t.events.select(status.alias("status"))
    jobs = t.events.groupBy(F.col("user_id").alias("job_id")).agg(
        F.min(ts).alias("created_at"),
        F.when(F.max("value") > 80, "FAILED").otherwise("COMPLETED").alias("status"),
    )
    results = t.events.select(
        F.col("user_id").alias("job_id"), ts.alias("validated_at"),
        F.when(kind.isin("click", "view"), "ai").otherwise("deterministic").alias("layer"),
        (F.col("value").cast("decimal(10,2)") / 1000).cast("decimal(10,6)").alias("ai_cost_usd"),
    )
    return statuses, jobs, results


@query("""
with jobs as (select user_id, min(ts) as created_at, max(value) as top from events group by 1)
select (select count(*) from events where event_type = 'click') as approved,
       (select count(*) from events where event_type = 'purchase') as review_required,
       (select count(*) from events where event_type = 'error') as rejected,
       (select count(*) from events where event_type in ('signup', 'view')) as pending,
       (select count(*) from jobs where top > 80) as validation_failures,
       (select count(*) from events where event_type not in ('click', 'view')) as rejected_before_ai,
       (select count(*) from events where event_type in ('click', 'view')) as ai_calls,
       (select round(cast(sum(cast(value as decimal(10,2))) as double) / 1000, 4) from events) as total_ai_cost_usd,
       (select round(avg(epoch(e.ts - j.created_at))) from events e join jobs j using (user_id)) as avg_validation_seconds,
       (select round(cast(sum(cast(value as decimal(10,2))) as double) / 1000
                / (select count(*) from events where event_type = 'click'), 6) from events) as cost_per_approved_lead""")
def validation_stats(t: Tables):
    counts = stats.validation_counts(*event_results(t))
    return counts.withColumn("total_ai_cost_usd", F.round("total_ai_cost_usd", 4)).withColumn(
        "cost_per_approved_lead", F.round("cost_per_approved_lead", 6)
    )


@query("""
with starts as (select user_id, min(ts) as created_at from events where event_type = 'signup' group by 1)
select round(avg(epoch(e.ts - s.created_at))) as avg_validation_seconds
from events e join starts s using (user_id) where event_type = 'purchase'""")
def latency_avg(t: Tables):
    ts = F.col("ts").cast("timestamp")
    starts = t.events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("job_id")).agg(F.min(ts).alias("created_at"))
    ends = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("job_id"), ts.alias("validated_at"))
    return stats.latency(ends, starts)


@query("""
select event_type, count(*) filter (where cast(ts as date) = date '2024-01-10') as that_day, count(*) as total
from events group by 1""")
def daily_counts(t: Tables):
    of_day = on_date(F.col("ts").cast("timestamp"), "2024-01-10")
    return t.events.groupBy("event_type").agg(F.count_if(of_day).alias("that_day"), F.count("*").alias("total"))


STATUS_SQL = """
log as (
  select l_orderkey, l_shipdate as changed_at, cast(round(l_extendedprice * 100) as bigint) as step,
         case l_returnflag || l_linestatus when 'AO' then 'INGESTED' when 'AF' then 'READY_FOR_VALIDATION'
           when 'NO' then 'VALIDATING' when 'NF' then 'APPROVED' when 'RO' then 'REJECTED' else 'REVIEW_REQUIRED' end as status
  from lineitem),
last as (select l_orderkey, arg_max(status, {'a': changed_at, 'b': step}) as status from log group by 1)
"""


def order_status(t: Tables) -> DataFrame:
    kind = F.concat("l_returnflag", "l_linestatus")
    status = (
        F.when(kind == "AO", "INGESTED").when(kind == "AF", "READY_FOR_VALIDATION").when(kind == "NO", "VALIDATING")
        .when(kind == "NF", "APPROVED").when(kind == "RO", "REJECTED").otherwise("REVIEW_REQUIRED")
    )
    log = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("dedup_key"), status.alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("changed_at"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("step"),
    )
    return current_status(log)


@query(f"with {STATUS_SQL} select cast(l_orderkey as varchar) as dedup_key, status from last")
def latest_status(t: Tables):
    return order_status(t)


@query(f"""
with {STATUS_SQL}
select case when status in ('INGESTED', 'READY_FOR_VALIDATION', 'VALIDATING') then 'pending' else lower(status) end as bucket,
       count(*) as leads
from last group by 1""")
def status_buckets(t: Tables):
    return order_status(t).groupBy(status_bucket(F.col("status")).alias("bucket")).agg(F.count("*").alias("leads"))


# -- reports ------------------------------------------------------------------------------------

@query(f"""
with {LEADS_SQL}
select source, count(*) as served, (select count(*) from merged m where m.source = l.source) as stored,
       count(*) - (select count(*) from merged m where m.source = l.source) as missing
from leads l group by source""")
def shadow_delta(t: Tables):
    raw, _, links = merged_masters(t)
    return reports.shadow_delta(raw, links)


@query(f"""
with {LEADS_SQL}
select (select count(*) from leads) as occurrences, (select count(*) from merged) as masters,
       (select count(*) from leads) - (select count(*) from merged) as duplicates_merged""")
def duplicates_merged(t: Tables):
    raw, masters, _ = merged_masters(t)
    return reports.duplicates_merged(raw, masters)


@query(f"""
with {LEADS_SQL}
select (select count(*) from merged where source = 'NFULL') as base_total,
       (select count(*) from merged where source = 'MFULL') as secondary_total,
       (select count(*) from merged) as masters, cast(0 as bigint) as merged,
       (select count(*) from merged where source = 'NFULL') as base_only,
       (select count(*) from merged where source = 'MFULL') as secondary_only,
       cast(0 as bigint) as found_by_both,
       (select count(*) from merged where match_key is null) as flagged""")
def dedup_report(t: Tables):
    _, masters, links = merged_masters(t)
    return reports.dedup_report(masters, links)


@query(f"""
with {DAYS_SQL},
per as (select dedup_key, count(*) filter (where source = 'click') as nb, count(*) filter (where source = 'view') as ns
        from days group by 1)
select cast(sum(nb) as bigint) as base_total, cast(sum(ns) as bigint) as secondary_total, count(*) as masters,
       cast(sum(nb) + sum(ns) as bigint) - count(*) as merged,
       count(*) filter (where nb > 0 and ns = 0) as base_only, count(*) filter (where nb = 0 and ns > 0) as secondary_only,
       count(*) filter (where nb > 0 and ns > 0) as found_by_both, cast(0 as bigint) as flagged
from per""")
def dedup_report_overlap(t: Tables):
    """Masters that both sources found, besides those of one; other sources are left out of account."""
    links = day_links(t)
    masters = links.where(F.col("source").isin("click", "view")).select("dedup_key").distinct().withColumn("possible_duplicate_of", F.lit(None).cast("string"))
    return reports.dedup_report(masters, links, **PAIR)


@query("""
select arg_max(event_id, {'a': ts, 'b': event_id}) as run_id, event_type as source,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') as started_at
from events group by event_type""")
def latest_runs(t: Tables):
    from leadmerge.operators.latest import latest_per_key

    runs = latest_per_key(t.events, ["event_type"], ["ts", "event_id"])
    return runs.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("source"), text_time(F.col("ts")).alias("started_at"))


@query("""
with slices as (
  select strftime(o_orderdate, '%Y-%m') as slice, count(*) as received, count(distinct o_custkey) as inserted,
         count(*) filter (where o_orderstatus = 'P') as errors
  from orders group by 1)
select cast(sum(received) as bigint) as received, cast(sum(inserted) as bigint) as inserted,
       cast(sum(received - inserted) as bigint) as duplicates, cast(sum(errors) as bigint) as errors
from slices""")
def run_totals(t: Tables):
    month = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM")
    runs = t.orders.groupBy(month.alias("slice")).agg(
        F.count("*").alias("received"), F.countDistinct("o_custkey").alias("inserted"),
        F.count_if(F.col("o_orderstatus") == "P").alias("errors"),
    )
    return reports.run_totals(runs.withColumn("duplicates", F.col("received") - F.col("inserted")))
