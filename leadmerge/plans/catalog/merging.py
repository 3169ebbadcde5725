"""Merge, incremental ingest and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadmerge.functions import parse_cutoff
from leadmerge.operators import incremental as inc, latest, merge
from leadmerge.plans.catalog.leads import (
    LEADS_SQL, base_keyed, base_payloads, secondary_keyed, secondary_payloads, with_row_key,
)
from leadmerge.plans.catalog.registry import Tables, query, text_time
from leadmerge.session import cut_lineage, work_path
from leadmerge.sources.store import LeadStore
from leadmerge.streaming.ingest import item_stream, start_ingest


@query(f"with {LEADS_SQL} select source, rec_id, business_name, phone_raw, match_key from merged")
def asym_merge_rows(t: Tables):
    return merge.asymmetric_merge(base_keyed(t), secondary_keyed(t))


@query(f"""
with {LEADS_SQL}
select count(*) filter (where source = 'NFULL') as base,
       (select count(*) from leads where source = 'MFULL') as secondary_total,
       (select count(*) from leads where source = 'MFULL')
         - count(*) filter (where source = 'MFULL') as secondary_omitted,
       count(*) filter (where source = 'MFULL') as secondary_only,
       count(*) as merged_total
from merged""")
def asym_merge_counts(t: Tables):
    return merge.merge_counts(base_keyed(t), secondary_keyed(t))


@query(f"""
with {LEADS_SQL}
select rec_id, match_key from leads l
where source = 'MFULL' and exists (select 1 from leads b where b.source = 'NFULL' and b.match_key = l.match_key)""")
def omitted_rows(t: Tables):
    return merge.omitted_secondary(base_keyed(t), secondary_keyed(t)).select("rec_id", "match_key")


@query(f"""
with {LEADS_SQL}
select rec_id, match_key in (select match_key from leads where source = 'NFULL') and match_key is not null as omitted
from leads where source = 'MFULL'""")
def split_rows(t: Tables):
    return merge.split_secondary(base_keyed(t), secondary_keyed(t)).select("rec_id", "omitted")


@query(f"with {LEADS_SQL} select source, count(match_key) as keyed, count(*) as total from leads group by source")
def key_coverage(t: Tables):
    return merge.key_coverage(base_keyed(t).unionByName(secondary_keyed(t)))


# -- first and last per key ----------------------------------------------------------------

PICK = "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts {0}, event_id {0}) as n from events) where n = 1"


@query(PICK.format("asc"))
def first_per_key(t: Tables):
    picked = latest.first_per_key(t.events, ["user_id", "event_type"], ["ts", "event_id"])
    return picked.select("user_id", "event_type", "event_id", "value")


@query(PICK.format("desc"))
def latest_per_key(t: Tables):
    picked = latest.latest_per_key(t.events, ["user_id", "event_type"], ["ts", "event_id"])
    return picked.select("user_id", "event_type", "event_id", "value")


# -- occurrences -------------------------------------------------------------------------------

def line_items(t: Tables) -> DataFrame:
    """Line items as occurrences; order and line number repeat."""
    key = F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"))
    return t.lineitem.select(
        F.lit("NFULL").alias("source"), key.alias("source_record_id"), key.alias("dedup_key"), "l_returnflag"
    )


@query("select distinct 'NFULL' as source, l_orderkey || '-' || l_linenumber as source_record_id from lineitem")
def occurrence_dedup(t: Tables):
    return latest.distinct_occurrences(line_items(t)).select("source", "source_record_id")


LINKED_SQL = """
raw as (select distinct l_orderkey || '-' || l_linenumber as dedup_key from lineitem),
masters as (select distinct l_orderkey || '-' || l_linenumber as dedup_key from lineitem where l_returnflag = 'N')
"""


def _raw_and_masters(t: Tables) -> tuple[DataFrame, DataFrame]:
    lines = line_items(t)
    raw = lines.select("source", "source_record_id", "dedup_key").distinct()
    return raw, lines.where("l_returnflag = 'N'").select("dedup_key").distinct()


@query(f"with {LINKED_SQL} select raw.dedup_key, masters.dedup_key as master_key from raw left join masters using (dedup_key)")
def link_raw_master(t: Tables):
    return inc.link_raw(*_raw_and_masters(t)).select("dedup_key", "master_key")


@query(f"with {LINKED_SQL} select dedup_key from raw where dedup_key not in (select dedup_key from masters)")
def unlinked_raw(t: Tables):
    return inc.unlinked_raw(*_raw_and_masters(t)).select("dedup_key")


@query("""
select o_orderkey, o_custkey as old_master, case when o_orderstatus = 'F' then null else c.c_custkey end as master_key
from orders left join (select c_custkey from customer where c_acctbal > 0) c on c.c_custkey = o_custkey
where o_custkey is distinct from case when o_orderstatus = 'F' then null else c.c_custkey end""")
def changed_links(t: Tables):
    known = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("_k"))
    linked = t.orders.join(known, "o_custkey", "left").select(
        "o_orderkey",
        F.col("o_custkey").alias("old_master"),
        F.when(F.col("o_orderstatus") != "F", F.col("_k")).alias("master_key"),
    )
    return inc.changed_links(linked)


@query("""
with stored as (select distinct o_custkey from orders where o_orderdate < timestamp '1998-01-01')
select distinct cast(o_custkey as varchar) as source_record_id,
       o_custkey not in (select o_custkey from stored) as is_new
from orders where o_orderdate >= timestamp '1998-01-01'""")
def upsert_classify(t: Tables):
    rows = t.orders.select(
        F.lit("NFULL").alias("source"), F.col("o_custkey").cast("string").alias("source_record_id"), "o_orderdate"
    )
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    stored, batch = rows.where(F.col("o_orderdate") < cut), rows.where(F.col("o_orderdate") >= cut)
    return inc.classify_occurrences(batch, stored).select("source_record_id", "is_new")


def two_batches(t: Tables) -> tuple[DataFrame, DataFrame]:
    """All leads in two batches: customers by balance, orders by date."""
    early = F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp_ntz")
    orders = t.orders.select(F.col("o_orderkey").alias("rec_id"), early.alias("early"))
    customers = t.customer.select(F.col("c_custkey").alias("rec_id"), (F.col("c_acctbal") < 4000).alias("early"))
    base = with_row_key(base_keyed(t)).join(customers, "rec_id")
    second = with_row_key(secondary_keyed(t)).join(orders, "rec_id")
    stage = base.unionByName(second)
    return stage.where("early").drop("early"), stage.where("not early").drop("early")


TWO_BATCHES_SQL = f"""
{LEADS_SQL},
staged as (
  select l.*, case when l.source = 'NFULL' then c_acctbal < 4000
                   else o_orderdate < timestamp '1998-07-01' end as early
  from leads l left join customer on l.source = 'NFULL' and c_custkey = rec_id
               left join orders on l.source = 'MFULL' and o_orderkey = rec_id),
first_batch as (
  select * from staged s where early and (source = 'NFULL' or match_key is null or not exists (
    select 1 from staged b where b.source = 'NFULL' and b.early and b.match_key = s.match_key))),
second_batch as (
  select * from staged s where not early and (source = 'NFULL' or match_key is null or not exists (
    select 1 from staged b where b.source = 'NFULL' and b.match_key = s.match_key)))
"""


@query(f"""
with {TWO_BATCHES_SQL}
select 1 as batch, dedup_key, match_key from first_batch
union all select 2, dedup_key, match_key from second_batch""")
def ingest_two_batches(t: Tables):
    one, two = two_batches(t)
    nothing = one.limit(0)
    # The masters of a batch are stored before the next batch is compared with them.
    first = cut_lineage(inc.new_masters(one, nothing))
    second = inc.new_masters(two, first)
    columns = ["dedup_key", "match_key"]
    return first.select(F.lit(1).alias("batch"), *columns).unionByName(
        second.select(F.lit(2).alias("batch"), *columns)
    )


@query(f"""
with {TWO_BATCHES_SQL}
select count(*) as omitted from staged s where source = 'MFULL' and not early
  and exists (select 1 from staged b where b.source = 'NFULL' and b.match_key = s.match_key)""")
def ingest_omitted_count(t: Tables):
    one, two = two_batches(t)
    return inc.omitted_count(two, inc.new_masters(one, one.limit(0)))


@query(f"""
with {TWO_BATCHES_SQL}
select dedup_key, match_key, 2 as batch, true as recounted from first_batch f where source = 'MFULL' and exists (
  select 1 from second_batch b where b.source = 'NFULL' and b.match_key = f.match_key)""")
def superseded_masters(t: Tables):
    """Secondary masters of the first batch that base rows of the second make redundant:
    reported batch by batch, and found again over all masters."""
    one, two = two_batches(t)
    first = cut_lineage(inc.new_masters(one, one.limit(0)))
    second = cut_lineage(inc.new_masters(two, first))
    parts = [(1, inc.newly_superseded(first, first.limit(0))), (2, inc.newly_superseded(second, first, second.count()))]
    reported = [late.withColumn("batch", F.lit(n)) for n, late in parts]
    whole = inc.superseded_masters(first.unionByName(second)).select("dedup_key", F.lit(True).alias("recounted"))
    return reported[0].unionByName(reported[1]).join(whole, "dedup_key", "full").select(
        "dedup_key", "match_key", "batch", F.coalesce("recounted", F.lit(False)).alias("recounted")
    )


@query("""
select cast(user_id as varchar) as dedup_key, event_type as source,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen
from events group by all""")
def source_links(t: Tables):
    seen = t.events.select(
        F.col("user_id").cast("string").alias("dedup_key"),
        F.col("event_type").alias("source"),
        F.col("ts").cast("timestamp").alias("seen_at"),
    )
    links = inc.source_links(seen)
    return links.select("dedup_key", "source", text_time(F.col("first_seen")).alias("first_seen"), text_time(F.col("last_seen")).alias("last_seen"))


@query("""
select cast(o_orderkey as varchar) as dedup_key, '1.1.0' as rules_version
from orders where o_orderdate >= timestamp '1998-06-15 00:00:00' and not exists (
  select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag in ('A', 'R') and l_linestatus = 'O')""")
def cutover_enqueue(t: Tables):
    masters = t.orders.select(
        F.col("o_orderkey").cast("string").alias("dedup_key"), F.col("o_orderdate").cast("timestamp").alias("scrape_timestamp")
    )
    open_line = F.col("l_returnflag").isin("A", "R") & (F.col("l_linestatus") == "O")
    jobs = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("dedup_key"),
        F.when(open_line, F.lit("RETRY")).otherwise(F.lit("COMPLETED")).alias("status"),
    )
    return inc.jobs_to_enqueue(inc.after_cutoff(masters, parse_cutoff("1998-06-15T00:00:00Z")), jobs)


@query("""
with least as (select p_name || '|' || p_brand as fp, min(p_partkey) as least from part group by 1)
select p_partkey, case when least <> p_partkey then least end as possible_duplicate_of
from part join least on fp = p_name || '|' || p_brand""")
def duplicate_flag(t: Tables):
    rows = t.part.select("p_partkey", F.concat_ws("|", "p_name", "p_brand").alias("fingerprint"))
    return inc.possible_duplicates(rows, key="p_partkey").select("p_partkey", "possible_duplicate_of")


@query("""
with f as (select p_partkey, p_name || '|' || p_brand as fp, p_partkey % 2 as late from part),
first_batch as (select fp, min(p_partkey) as least from f where late = 0 group by 1),
stored as (select fp, min(p_partkey) as least from f group by 1)
select p_partkey, case when least <> p_partkey then least end as possible_duplicate_of from f join first_batch using (fp) where late = 0
union all
select p_partkey, case when least <> p_partkey then least end from f join stored using (fp) where late = 1""")
def duplicate_flag_batches(t: Tables):
    """Two batches one after the other; the second one probes the least keys of the first."""
    rows = t.part.select("p_partkey", F.concat_ws("|", "p_name", "p_brand").alias("fingerprint"))
    one, two = (rows.where(F.col("p_partkey") % 2 == n) for n in (0, 1))
    nothing = inc.least_keys(one.limit(0), "p_partkey")
    stored = cut_lineage(inc.least_keys(one, "p_partkey"))
    flagged = inc.flag_against(one, nothing, key="p_partkey").unionByName(inc.flag_against(two, stored, two.count(), key="p_partkey"))
    return flagged.select("p_partkey", "possible_duplicate_of")


# Files of one slice, written by as many tasks.
SLICE_FILES = 32


@query(f"""
with {LEADS_SQL}
select source, match_key, count(*) as masters from merged group by all""")
def stream_ingest(t: Tables):
    """Base files, then secondary files in two slices, each as a stream of batches of some files."""
    spark, root = t.spark, work_path(t.spark, "stream")
    store = LeadStore(spark, f"{root}/state")
    own_phone = F.map_filter("raw_payload", lambda k, v: k != "Secondary Contact ")
    landing = (("base", base_payloads(t), 1), ("secondary", secondary_payloads(t), 2))
    for name, rows, slices in landing:
        items = rows.select("source", own_phone.alias("raw_payload"))
        items.repartition(slices * SLICE_FILES).write.parquet(f"{root}/{name}")
        stream = item_stream(spark, f"{root}/{name}", fmt="parquet", max_files=SLICE_FILES)
        start_ingest(stream, store, f"{root}/checkpoint-{name}", name=f"leads-{name}").awaitTermination()
    # A new checkpoint delivers the same batches again under the same numbers.
    start_ingest(item_stream(spark, f"{root}/base", fmt="parquet", max_files=SLICE_FILES), store, f"{root}/checkpoint-again", name="leads-base").awaitTermination()
    masters = store.read("masters")
    return masters.groupBy("source", "match_key").agg(F.count("*").alias("masters"))
