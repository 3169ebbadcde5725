"""Header detection, alias mapping, payload merge and display."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadmerge.operators import canonical as cn
from leadmerge.operators.merge import asymmetric_merge, mapping_coverage as coverage
from leadmerge.operators.payloads import merge_payloads
from leadmerge.plans.catalog.leads import CANONICAL_SQL, base_payloads, secondary_payloads
from leadmerge.plans.catalog.registry import Tables, query, text_time
from leadmerge.sources.grids import grid_counts as counts_per_grid, grid_rows


# One grid per customer: title, blank row, header with a repeated name, then one row
# per order; rows are short, exact or too long by turns.
def order_grids(t: Tables) -> DataFrame:
    grid = F.concat(F.lit("g"), F.col("c_custkey")).alias("grid_id")
    text = lambda *cs: F.array(*[c.cast("string") for c in cs])
    row = lambda i, cells: F.struct(F.lit(i).cast("bigint").alias("row_idx"), cells.alias("cells"))
    fixed = F.array(
        row(-3, text(F.col("c_name"))),
        row(-2, text(F.lit(""), F.lit(" "), F.lit(None))),
        row(-1, text(F.lit("Key "), F.lit("Status"), F.lit("Key"), F.lit("Status"))),
    )
    heads = t.customer.select(grid, F.explode(fixed).alias("r")).select("grid_id", "r.*")
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    cells = (
        F.when(priority == "5-LOW", text(F.lit(" "), F.lit(""), F.lit(None)))
        .when(status == "O", text(key))
        .when(status == "F", text(key, status, F.lit("k"), priority))
        .otherwise(text(key, status, F.lit(""), F.lit(None), F.lit("surplus")))
    )
    rows = t.orders.select(
        F.concat(F.lit("g"), F.col("o_custkey")).alias("grid_id"), key.alias("row_idx"), cells.alias("cells")
    )
    return heads.unionByName(rows)


@query("""
select 'g' || o_custkey as grid_id, o_orderkey as row_idx, cast(o_orderkey as varchar) as key_spaced,
       case when o_orderstatus = 'F' then 'k' else '' end as key,
       case when o_orderstatus = 'F' then o_orderpriority else '' end as status
from orders where o_orderpriority <> '5-LOW' and o_custkey in (select c_custkey from customer)""")
def header_detect(t: Tables):
    rows = grid_rows(order_grids(t), min_cells=2)
    cell = lambda h: F.col("raw_payload").getItem(h)
    return rows.select(
        "grid_id", "row_idx", cell("Key ").alias("key_spaced"), cell("Key").alias("key"), cell("Status").alias("status")
    )


@query("""
select 'g' || o_custkey as grid_id, o_orderkey as row_idx, cast(o_orderkey as varchar) as titled
from orders where o_orderpriority <> '5-LOW' and o_custkey in (select c_custkey from customer)
union all
select 'g' || c_custkey, -1, 'Key ' from customer""")
def header_detect_first_row(t: Tables):
    rows = grid_rows(order_grids(t), min_cells=1)
    return rows.select("grid_id", "row_idx", F.element_at(F.map_values("raw_payload"), 1).alias("titled"))


@query("""
with data as (select o_custkey as k, count(*) filter (where o_orderpriority <> '5-LOW') as n from orders group by 1)
select 'g' || coalesce(c_custkey, k) as grid_id,
       cast(coalesce(n, 0) + case when c_custkey is null then 0 else 2 end as bigint) as populated_rows,
       cast(greatest(coalesce(n, 0) + case when c_custkey is null then 0 else 2 end - 1, 0) as bigint) as data_rows
from customer full join data on c_custkey = k""")
def grid_counts(t: Tables):
    return counts_per_grid(order_grids(t))


def _canonical_leads(t: Tables) -> tuple[DataFrame, DataFrame]:
    return cn.canonical(base_payloads(t)), cn.canonical(secondary_payloads(t))


@query(f"""
with {CANONICAL_SQL}
select source, rec_id, dedup_key as source_record_id, dedup_key, match_key, post_id, url,
       cast(null as varchar) as owner_name, message, cast(null as varchar) as post_timestamp,
       strftime(scrape_timestamp, '%Y-%m-%d %H:%M:%S') as scrape_timestamp, business_name, phone, phone2,
       email, postcode, address1, location, norm_permalink, norm_phone
from canonical""")
def canonical_rows(t: Tables):
    base, secondary = _canonical_leads(t)
    return (
        base.unionByName(secondary)
        .withColumn("post_timestamp", text_time(F.col("post_timestamp")))
        .withColumn("scrape_timestamp", text_time(F.col("scrape_timestamp")))
        .drop("raw_payload")
    )


@query("""
select 'MFULL' as source, o_orderkey as rec_id, o_orderpriority as message,
       cast(null as varchar) as address1, case when o_orderkey % 2 = 0 then o_orderstatus end as town,
       case when o_orderkey % 3 = 0 then 'Kent' end as county,
       case when o_orderkey % 2 = 0 then '.' else o_orderkey || '@x.org' end as email,
       'p' || o_orderkey as postcode
from orders
union all
select 'NFULL', c_custkey, 'Opening in ' || c_mktsegment, c_custkey || ' Mill Lane', 'Town ' || c_nationkey,
       null, null, 'n' || c_nationkey || ' 1aa'
from customer""")
def alias_coalesce(t: Tables):
    rows = base_payloads(t).unionByName(secondary_payloads(t))
    cells = rows.withColumn("cells", cn.header_lookup(F.col("raw_payload")))
    fields = ("message", "address1", "town", "county", "email", "postcode")
    picked = [cn.alias_value(F.col("cells"), f).alias(f) for f in fields]
    return cells.select("source", "rec_id", *picked)


@query("""
with ranked as (
  select conv_id, role, text,
         row_number() over (partition by conv_id, role order by turn) as n
  from conversations where trim(text) <> '')
select conv_id, role, text from ranked where n = 1""")
def payload_merge(t: Tables):
    turns = t.conversations.select(
        "conv_id", "turn", F.create_map(F.col("role"), F.col("text"), F.lit("empty"), F.lit(" ")).alias("cells")
    )
    merged = merge_payloads(turns, key="conv_id", payload="cells", order=("turn",))
    return merged.select("conv_id", F.explode("merged_payload").alias("role", "text"))


DISPLAY_SQL = """
select coalesce(message, '') as "Lead Statement",
       strftime(scrape_timestamp, '%Y-%m-%dT%H:%M:%S.000Z') as "Timestamp",
       coalesce(business_name, '') as "Company Name", coalesce(phone, '') as "Phone Number",
       coalesce(address1, '') as "Address 1 (Road/Street/Lane/Park/Industrial Estate)",
       coalesce(location, '') as "Address 2 (Village/Town/City)",
       coalesce(phone2, '') as "Phone 2",
       coalesce(postcode, '') as "Post Code (Please Put The Full Postcode, Example: CH41 5LH)",
       coalesce(url, '') as "Lead Proof URL",
       case when rec_id % 3 = 0 then 'BOTH' else source end as source, dedup_key as master_id,
       'INGESTED' as validation_status, rec_id % 2 = 0 as exported,
       cast(null as varchar) as possible_duplicate_of
"""


@query(f"""
with {CANONICAL_SQL}
{DISPLAY_SQL}
from canonical c
where source = 'NFULL' or match_key is null
   or not exists (select 1 from canonical b where b.source = 'NFULL' and b.match_key = c.match_key)""")
def display_rows(t: Tables):
    base, secondary = _canonical_leads(t)
    third = F.col("rec_id") % 3 == 0
    merged = asymmetric_merge(base.drop("raw_payload"), secondary.drop("raw_payload"))
    rows = (
        merged.withColumn("sources", F.when(third, F.array(F.lit("MFULL"), F.lit("NFULL"))).otherwise(F.array("source")))
        .withColumn("status", F.lit("INGESTED"))
        .withColumn("exported", F.col("rec_id") % 2 == 0)
        .withColumn("possible_duplicate_of", F.lit(None).cast("string"))
    )
    return cn.display_rows(rows)


@query(f"""
with {CANONICAL_SQL}
select dedup_key as master_key,
  case when source = 'NFULL' then 'Town ' || regexp_extract(location, '[0-9]+', 0)
       when split_part(coalesce(location, ''), ',', 1) in ('O', 'F', 'P') then split_part(location, ',', 1)
       else coalesce(location, '') end as town,
  case when source = 'MFULL' and rec_id % 3 = 0 then 'Kent' else '' end as county,
  case when source = 'MFULL' then message else '' end as industry, coalesce(email, '') as email
from canonical""")
def scoring_rows(t: Tables):
    base, secondary = _canonical_leads(t)
    rows = cn.lead_rows(base.unionByName(secondary), "raw_payload")
    return rows.select(
        F.col("dedup_key").alias("master_key"),
        F.col("`Address 2 (Village/Town/City)`").alias("town"),
        F.col("County").alias("county"),
        F.col("`Industry Type`").alias("industry"),
        F.col("Email").alias("email"),
    )


@query(f"""
with {CANONICAL_SQL}
select source, count(business_name) as business_names, count(norm_permalink) as links,
       count(norm_phone) as phones, count(*) as total
from canonical group by source""")
def mapping_coverage(t: Tables):
    named = {"business_name": "business_names", "norm_permalink": "links", "norm_phone": "phones"}
    base, secondary = _canonical_leads(t)
    per_source = [
        coverage(rows, named).select(F.lit(name).alias("source"), "*")
        for name, rows in (("NFULL", base), ("MFULL", secondary))
    ]
    return per_source[0].unionByName(per_source[1])


@query("""
with p as (
  select page_id,
         case when strpos(url, '?') > 0 then nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '') end as link,
         nullif(regexp_extract(url, '/(?:en|fr|de|es)/([0-9]+)', 1), '') as post_id, url
  from pages)
select page_id, coalesce(link, case when url like '%#top' then null else post_id end,
                         case when url like 'https:%' then '+44' || page_id end, 'mid:' || page_id) as identity
from p""")
def legacy_identity(t: Tables):
    url = F.col("url")
    link = F.when(url.contains("?"), F.regexp_extract(url, "^https?://([^/?#]+)", 1))
    post = F.when(~url.endswith("#top"), F.nullif(F.regexp_extract(url, r"/(?:en|fr|de|es)/(\d+)", 1), F.lit("")))
    phone = F.when(url.startswith("https:"), F.concat(F.lit("+44"), F.col("page_id")))
    return t.pages.select("page_id", cn.legacy_identity(link, post, phone, F.col("page_id")).alias("identity"))
