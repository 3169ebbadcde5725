"""Lead rows derived from customers (base) and orders (secondary).

The secondary source spells its phones in five ways, has no phone on some rows and
reaches every second base phone. SQL fragments describe the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadmerge.contract import BASE_SOURCE, DISPLAY_HEADERS, SECONDARY_SOURCE
from leadmerge.functions import match_key
from leadmerge.plans.catalog.registry import Tables

ADDRESS1, ADDRESS2, POSTCODE = DISPLAY_HEADERS[4], DISPLAY_HEADERS[5], DISPLAY_HEADERS[7]


def base_leads(t: Tables) -> DataFrame:
    return t.customer.select(
        F.lit(BASE_SOURCE).alias("source"),
        F.col("c_custkey").alias("rec_id"),
        F.col("c_name").alias("business_name"),
        F.concat(F.lit("0"), (F.col("c_custkey") + 1000000000).cast("string")).alias("phone_raw"),
    )


def order_phone() -> Column:
    number = (F.col("o_custkey") * 2 + 1000000000).cast("string")
    kind = F.col("o_orderkey") % 5
    return (
        F.when(kind == 0, F.concat(F.lit("+44 (0)"), number))
        .when(kind == 1, F.concat(F.lit("0044 "), number))
        .when(kind == 2, F.concat(F.lit("44"), number))
        .when(kind == 3, F.concat(F.lit("0"), number))
        .otherwise(F.lit("N/A"))
    )


def secondary_leads(t: Tables) -> DataFrame:
    return t.orders.select(
        F.lit(SECONDARY_SOURCE).alias("source"),
        F.col("o_orderkey").alias("rec_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("business_name"),
        order_phone().alias("phone_raw"),
    )


def keyed(leads: DataFrame) -> DataFrame:
    return leads.withColumn("match_key", match_key(F.col("phone_raw")))


def base_keyed(t: Tables) -> DataFrame:
    return keyed(base_leads(t))


def secondary_keyed(t: Tables) -> DataFrame:
    return keyed(secondary_leads(t))


def with_row_key(leads: DataFrame) -> DataFrame:
    """A readable identity in place of the row hash."""
    key = F.concat_ws("-", "source", F.col("rec_id").cast("string"))
    return leads.withColumn("dedup_key", key).withColumn("source_record_id", key)


# -- raw payloads -----------------------------------------------------------------------

def payload(cells: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v)])


def base_payloads(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    text = key.cast("string")
    nation = F.col("c_nationkey").cast("string")
    url = (
        F.when(key % 4 == 0, F.concat(F.lit("https://www.facebook.com/Shop"), text, F.lit("/posts/"), text, F.lit("/?fbclid=x")))
        .when(key % 4 == 1, F.concat(F.lit("m.facebook.com/permalink.php?story_fbid="), text, F.lit("&id="), nation, F.lit("&ref=q")))
        .when(key % 4 == 2, F.lit(" "))
        .otherwise(F.lit("no link"))
    )
    cells = {
        "Lead Statement": F.concat(F.lit("Opening in "), F.col("c_mktsegment")),
        "Timestamp": F.date_format(F.timestamp_seconds(key * 60 + 1700000000), "yyyy-MM-dd HH:mm:ss"),
        "Company Name": F.col("c_name"),
        "Phone Number": F.concat(F.lit("0"), (key + 1000000000).cast("string")),
        ADDRESS1: F.concat(text, F.lit(" Mill Lane")),
        ADDRESS2: F.concat(F.lit("Town "), nation),
        "Phone 2": F.lit(""),
        POSTCODE: F.concat(F.lit("n"), nation, F.lit(" 1aa")),
        "Lead Proof URL": url,
    }
    return t.customer.select(
        F.lit(BASE_SOURCE).alias("source"), payload(cells).alias("raw_payload"), key.alias("rec_id")
    )


def secondary_payloads(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    text = key.cast("string")
    cells = {
        "Timestamp": F.date_format(F.col("o_orderdate").cast("timestamp"), "M/d/yyyy H:mm:ss"),
        "Primary Contact ": order_phone(),
        "Secondary Contact ": F.when(key % 3 == 0, F.concat(F.lit("07"), F.lpad(text, 9, "5"))).otherwise(F.lit("")),
        "Company Name  ": F.concat(F.lit(" Order "), text, F.lit(" ")),
        "Business Type": F.col("o_orderpriority"),
        "Address 1 (Road or Street)  ": F.lit(""),
        "Address 2 (Town or City) ": F.when(key % 2 == 0, F.col("o_orderstatus")).otherwise(F.lit(" ")),
        "County": F.when(key % 3 == 0, F.lit("Kent")).otherwise(F.lit("")),
        "Postal Code ": F.concat(F.lit("p"), text),
        'Email Address ("." if None)': F.when(key % 2 == 0, F.lit(".")).otherwise(F.concat(text, F.lit("@x.org"))),
        "Lead Proof URL ": F.concat(F.lit("https://m.facebook.com/o/posts/"), text),
        "Business Note ": F.col("o_orderpriority"),
        "Column 13": F.lit(""),
    }
    return t.orders.select(
        F.lit(SECONDARY_SOURCE).alias("source"), payload(cells).alias("raw_payload"), key.alias("rec_id")
    )


# -- the same rows in SQL -----------------------------------------------------------------

LEADS_SQL = """
raw_leads as (
  select 'NFULL' as source, c_custkey as rec_id, c_name as business_name,
         '0' || cast(1000000000 + c_custkey as varchar) as phone_raw
  from customer
  union all
  select 'MFULL', o_orderkey, 'Order ' || cast(o_orderkey as varchar),
         case o_orderkey % 5
           when 0 then '+44 (0)' || cast(1000000000 + 2 * o_custkey as varchar)
           when 1 then '0044 ' || cast(1000000000 + 2 * o_custkey as varchar)
           when 2 then '44' || cast(1000000000 + 2 * o_custkey as varchar)
           when 3 then '0' || cast(1000000000 + 2 * o_custkey as varchar)
           else 'N/A' end
  from orders),
dialled as (
  select *, regexp_replace(phone_raw, '[^0-9+]', '', 'g') as d from raw_leads),
national as (
  select *, ltrim(case
      when starts_with(d, '+44') then substr(d, 4)
      when starts_with(d, '0044') then substr(d, 5)
      when starts_with(d, '44') and length(d) >= 12 then substr(d, 3)
      when starts_with(d, '0') then substr(d, 2)
      when starts_with(d, '+') then null
      else d end, '0') as n
  from dialled),
leads as (
  select source, rec_id, business_name, phone_raw,
         source || '-' || cast(rec_id as varchar) as dedup_key,
         case when regexp_full_match(n, '[0-9]{9,10}') then '+44' || n end as match_key
  from national),
merged as (
  select * from leads l
  where source = 'NFULL' or match_key is null
     or not exists (select 1 from leads b where b.source = 'NFULL' and b.match_key = l.match_key))
"""

# Canonical columns of the payload rows, written out field by field.
CANONICAL_SQL = """
flat as (
  select 'NFULL' as source, c_custkey as rec_id,
    'Address 1 (Road/Street/Lane/Park/Industrial Estate)=' || c_custkey || ' Mill Lane' || chr(1)
      || 'Address 2 (Village/Town/City)=Town ' || c_nationkey || chr(1)
      || 'Company Name=' || c_name || chr(1)
      || 'Lead Proof URL=' || url || chr(1)
      || 'Lead Statement=Opening in ' || c_mktsegment || chr(1)
      || 'Phone 2=' || chr(1)
      || 'Phone Number=0' || (1000000000 + c_custkey) || chr(1)
      || 'Post Code (Please Put The Full Postcode, Example: CH41 5LH)=n' || c_nationkey || ' 1aa' || chr(1)
      || 'Timestamp=' || strftime(ts, '%Y-%m-%d %H:%M:%S') as pairs,
    nullif(trim(url), '') as url,
    case c_custkey % 4
      when 0 then 'www.facebook.com/shop' || c_custkey || '/posts/' || c_custkey
      when 1 then 'www.facebook.com/permalink.php?id=' || c_nationkey || '&story_fbid=' || c_custkey
    end as norm_permalink,
    case when c_custkey % 4 in (0, 1) then cast(c_custkey as varchar) end as post_id,
    'Opening in ' || c_mktsegment as message, ts as scrape_timestamp, c_name as business_name,
    '0' || (1000000000 + c_custkey) as phone, cast(null as varchar) as phone2,
    '+44' || (1000000000 + c_custkey) as norm_phone, cast(null as varchar) as email,
    'n' || c_nationkey || ' 1aa' as postcode, c_custkey || ' Mill Lane' as address1,
    'Town ' || c_nationkey as location
  from (select *, make_timestamp((c_custkey * 60 + 1700000000) * 1000000) as ts,
          case c_custkey % 4
            when 0 then 'https://www.facebook.com/Shop' || c_custkey || '/posts/' || c_custkey || '/?fbclid=x'
            when 1 then 'm.facebook.com/permalink.php?story_fbid=' || c_custkey || '&id=' || c_nationkey || '&ref=q'
            when 2 then ' ' else 'no link' end as url
        from customer)
  union all
  select 'MFULL', o_orderkey,
    'Address 1 (Road or Street)  =' || chr(1)
      || 'Address 2 (Town or City) =' || town || chr(1)
      || 'Business Note =' || o_orderpriority || chr(1)
      || 'Business Type=' || o_orderpriority || chr(1)
      || 'Column 13=' || chr(1)
      || 'Company Name  = Order ' || o_orderkey || ' ' || chr(1)
      || 'County=' || county || chr(1)
      || 'Email Address ("." if None)=' || mail || chr(1)
      || 'Lead Proof URL =https://m.facebook.com/o/posts/' || o_orderkey || chr(1)
      || 'Postal Code =p' || o_orderkey || chr(1)
      || 'Primary Contact =' || phone1 || chr(1)
      || 'Secondary Contact =' || phone2 || chr(1)
      || 'Timestamp=' || strftime(o_orderdate, '%-m/%-d/%Y %-H:%M:%S'),
    'https://m.facebook.com/o/posts/' || o_orderkey,
    'www.facebook.com/o/posts/' || o_orderkey, cast(o_orderkey as varchar),
    o_orderpriority, o_orderdate, 'Order ' || o_orderkey, phone1, nullif(phone2, ''),
    coalesce(
      case when o_orderkey % 5 < 4 then '+44' || (1000000000 + 2 * o_custkey) end,
      case when phone2 <> '' then '+44' || substr(phone2, 2) end),
    nullif(mail, '.'), 'p' || o_orderkey, cast(null as varchar),
    nullif(concat_ws(', ', nullif(trim(town), ''), nullif(county, '')), '')
  from (select *,
          case o_orderkey % 5
            when 0 then '+44 (0)' || (1000000000 + 2 * o_custkey)
            when 1 then '0044 ' || (1000000000 + 2 * o_custkey)
            when 2 then '44' || (1000000000 + 2 * o_custkey)
            when 3 then '0' || (1000000000 + 2 * o_custkey)
            else 'N/A' end as phone1,
          case when o_orderkey % 3 = 0 then '07' || lpad(cast(o_orderkey as varchar), 9, '5') else '' end as phone2,
          case when o_orderkey % 2 = 0 then o_orderstatus else ' ' end as town,
          case when o_orderkey % 3 = 0 then 'Kent' else '' end as county,
          case when o_orderkey % 2 = 0 then '.' else o_orderkey || '@x.org' end as mail
        from orders)),
canonical as (
  select *, sha256(source || '|' || pairs) as dedup_key, norm_phone as match_key from flat)
"""
