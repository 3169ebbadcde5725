"""Mapping raw rows of any header vocabulary to the canonical lead."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from leadmerge.contract import ALIASES, BOTH, CANONICAL_COLUMNS, DISPLAY_HEADERS
from leadmerge.functions import (
    clean_email, extract_post_id, fingerprint, first_uk_phone, jtrim,
    normalize_permalink, row_hash, tolerant_timestamp,
)
from leadmerge.functions.text import empty_to_null

Aliases = Mapping[str, Sequence[str]]


def header_lookup(payload: Column) -> Column:
    """Payload map with trimmed, lower-case headers and trimmed cells, blanks dropped.

    Of two headers that become equal the later one counts, even if its cell is blank.
    """
    clean = F.transform(
        F.map_entries(payload),
        lambda e: F.struct(F.lower(jtrim(e["key"])).alias("key"), jtrim(e["value"]).alias("value")),
    )
    return F.map_filter(F.map_from_entries(clean), lambda _, v: v != "")


def alias_value(lookup: Column, field: str, aliases: Aliases = ALIASES) -> Column:
    """Value of the first alias that has one, in a map made by :func:`header_lookup`."""
    names = [name.strip().lower() for name in aliases.get(field, ())]
    if not names:
        return F.lit(None).cast("string")
    return F.coalesce(*[lookup.getItem(name) for name in names])


def join_location(town: Column, county: Column) -> Column:
    """``town, county`` without the missing part; null when both are missing."""
    return empty_to_null(F.concat_ws(", ", town, county))


def canonical(df: DataFrame, *, aliases: Aliases = ALIASES, **url_rules) -> DataFrame:
    """Rows ``(source, raw_payload, ...)`` to the canonical columns.

    Other columns of ``df`` are kept behind the canonical ones. The header map is
    built once per row and the picked fields feed the derived ones, so no text is
    parsed twice. ``url_rules`` go to :func:`normalize_permalink`.
    """
    extra = [c for c in df.columns if c not in ("source", "raw_payload")]
    looked_up = df.withColumn("_cells", header_lookup(F.col("raw_payload")))
    pick = lambda field: alias_value(F.col("_cells"), field, aliases)
    picked = looked_up.select(
        "source",
        "raw_payload",
        *extra,
        row_hash(F.col("source"), F.col("raw_payload")).alias("source_record_id"),
        pick("url").alias("url"),
        pick("message").alias("message"),
        pick("posting_date").alias("_posting_date"),
        pick("timestamp").alias("_timestamp"),
        pick("business_name").alias("business_name"),
        pick("phone").alias("_phone1"),
        pick("phone2").alias("phone2"),
        first_uk_phone(pick("phone"), pick("phone2"), pick("phone3")).alias("norm_phone"),
        clean_email(pick("email")).alias("email"),
        pick("postcode").alias("postcode"),
        pick("address1").alias("address1"),
        join_location(pick("town"), pick("county")).alias("location"),
    )
    derived = {
        "dedup_key": F.col("source_record_id"),
        "match_key": F.col("norm_phone"),
        "post_id": extract_post_id(F.col("url")),
        "norm_permalink": normalize_permalink(F.col("url"), **url_rules),
        "owner_name": F.lit(None).cast("string"),
        "post_timestamp": tolerant_timestamp(F.col("_posting_date")),
        "scrape_timestamp": tolerant_timestamp(F.col("_timestamp")),
        "phone": F.coalesce("_phone1", "phone2"),
    }
    columns = [derived[c].alias(c) if c in derived else F.col(c) for c in CANONICAL_COLUMNS]
    return picked.select(*columns, *extra)


def with_fingerprint(df: DataFrame) -> DataFrame:
    """Adds the business-and-postcode fingerprint stored with every master."""
    return df.withColumn("fingerprint", fingerprint(F.col("business_name"), F.col("postcode")))


def instant_text(c: Column) -> Column:
    """An instant as ISO text with milliseconds and ``Z``, the exported spelling."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def lead_row(payload: str | None = None, *, aliases: Aliases = ALIASES) -> dict[str, Column]:
    """The 14 verbose columns of a lead: master value, then payload value, then ''.

    The town prefers the payload, because the master holds town and county in one
    text. ``payload`` names a map column with the merged raw cells, if any.
    """
    if payload is None:
        cell = lambda field: F.lit(None).cast("string")
    else:
        lookup = header_lookup(F.col(payload))
        cell = lambda field: alias_value(lookup, field, aliases)
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    return {
        "Lead Statement": first(F.col("message"), cell("message")),
        "Timestamp": first(instant_text(F.col("scrape_timestamp")), cell("timestamp")),
        "Company Name": first(F.col("business_name"), cell("business_name")),
        "Phone Number": first(F.col("phone")),
        "Phone 2": first(F.col("phone2"), cell("phone2")),
        "Industry Type": first(cell("industry")),
        DISPLAY_HEADERS[4]: first(F.col("address1"), cell("address1")),
        DISPLAY_HEADERS[5]: first(cell("town"), F.col("location")),
        "County": first(cell("county")),
        DISPLAY_HEADERS[7]: first(F.col("postcode")),
        "Lead Proof URL": first(F.col("url")),
        "Lead Posting Date": first(instant_text(F.col("post_timestamp"))),
        aliases["old_address"][0]: first(cell("old_address")),
        "Email": first(F.col("email")),
    }


def lead_rows(df: DataFrame, payload: str | None = None, *, aliases: Aliases = ALIASES) -> DataFrame:
    """Masters as verbose rows, keyed by ``dedup_key``."""
    values = lead_row(payload, aliases=aliases)
    return df.select("dedup_key", *[v.alias(h) for h, v in values.items()])


def source_badge(sources: Column) -> Column:
    """``BOTH`` for two distinct sources, else the one there is."""
    names = F.sort_array(F.array_distinct(sources))
    return F.when(F.size(names) == 2, F.lit(BOTH)).otherwise(F.try_element_at(names, F.lit(1)))


def display_rows(df: DataFrame) -> DataFrame:
    """Nine display columns plus badge, master id, status, exported and flag.

    ``df`` is the output of the list operator; only master columns are used.
    """
    values = lead_row()
    return df.select(
        *[values[header].alias(header) for header in DISPLAY_HEADERS],
        source_badge(F.col("sources")).alias("source"),
        F.col("dedup_key").alias("master_id"),
        F.col("status").alias("validation_status"),
        "exported",
        "possible_duplicate_of",
    )


def legacy_identity(
    permalink: Column, post_id: Column, phone: Column, row_id: Column
) -> Column:
    """Identity of rows stored before row hashes: link, post, phone, row id."""
    return F.coalesce(
        permalink, post_id, phone, F.concat(F.lit("mid:"), row_id.cast("string"))
    )
