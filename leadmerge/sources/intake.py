"""Batches pushed as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadmerge.contract import SOURCES
from leadmerge.session import cut_lineage
from leadmerge.sources.blocks import pieces, records

ROWS_SCHEMA = "rows array<map<string,string>>"
MIXED_SCHEMA = "rows array<struct<source:string,row:map<string,string>>>"

# What stands before the first entry and behind the last one, by the brackets that are
# open beyond it.
_OPENING = (r'(?s)^\s*+\{\s*+"rows"\s*+:\s*+\[', r'(?s)^\s*+"rows"\s*+:\s*+\[')
_CLOSING = (r"(?s)\]\s*\}\s*$", r"(?s)\]\s*$")


class BatchRejected(ValueError):
    """A pushed batch that must not be ingested at all."""


def body_entries(spark: SparkSession, path: str | list[str]) -> DataFrame | None:
    """``(file, text)``: the entries of the list ``rows`` of each body, as JSON text.

    A body is cut at the commas between its entries in many tasks, so that no value
    holds more than one entry. Null if a body has other lists or objects beside
    ``rows``: those have to be read whole. A file without a byte is no body.
    """
    found, outer, states = records(pieces(spark, path, ","), ",", limit=2, nested=True)
    before, after, text = F.col("before"), F.col("after"), F.col("text")
    opens = ((before == 0) & text.rlike(_OPENING[0])) | ((before == 1) & text.rlike(_OPENING[1]))
    units = found.withColumn("opens", opens)
    ends = states.groupBy("file").agg(F.max_by(F.struct("odd_after", "depth_after"), "block").alias("end"))
    # Only what lies outside the list decides whether it is a body.
    unit_counts = outer.withColumn("opens", opens).withColumn("other", (before < 2) & (after >= 2) & ~F.col("opens")).groupBy("file").agg(
        F.count_if("opens").alias("lists"), F.count_if("other").alias("others"), F.count_if(before == 0).alias("tops")
    )
    facts = ends.join(unit_counts, "file", "left").agg(
        F.coalesce(F.sum("others"), F.lit(0)).alias("others"),
        F.count_if(~((F.col("end.odd_after") == 0) & (F.col("end.depth_after") == 0) & F.coalesce((F.col("lists") == 1) & (F.col("tops") == 1), F.lit(False)))).alias("bad"),
    ).first()
    if facts["others"]:
        return None
    if facts["bad"]:
        raise BatchRejected("payload without a list of rows")
    first = F.when(before == 0, F.regexp_replace("text", _OPENING[0], "")).otherwise(F.regexp_replace("text", _OPENING[1], ""))
    entry = F.when(F.col("opens"), first).otherwise(text)
    entry = F.when(after == 0, F.regexp_replace(entry, _CLOSING[0], "")).when(after == 1, F.regexp_replace(entry, _CLOSING[1], "")).otherwise(entry)
    inner = units.where((before >= 2) | F.col("opens")).withColumn("text", _stripped(entry))
    # The one blank unit of an empty list is no entry; elsewhere a blank one is malformed.
    return inner.where(~(F.col("opens") & (after < 2) & (F.col("text") == ""))).select("file", "text")


def _stripped(value: Column) -> Column:
    """Without JSON's white space at both ends."""
    return F.btrim(value, F.lit(" \t\r\n"))


def _whole(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Entries of bodies that are read as one value each."""
    bodies = spark.read.text(path, wholetext=True).select(F.from_json("value", schema)["rows"].alias("rows"))
    if bodies.where(F.col("rows").isNull()).limit(1).count():
        raise BatchRejected("payload without a list of rows")
    return bodies.select(F.explode("rows").alias("entry"))


def _entries(spark: SparkSession, path: str | list[str], schema: str, batch_schema: str) -> DataFrame:
    """Parsed entries, written once; a malformed one rejects the batch."""
    found = body_entries(spark, path)
    if found is None:
        return _whole(spark, path, batch_schema)
    parsed = F.from_json("text", schema)
    # The parser takes some text that is no object for one without fields.
    broken = (F.col("text") != "null") & (parsed.isNull() | ~F.col("text").rlike(r"(?s)^\{.*\}$"))
    entries = cut_lineage(found.select(parsed.alias("entry"), broken.alias("broken")))
    if not entries.where("broken").isEmpty():
        raise BatchRejected("payload without a list of rows")
    return entries.select("entry")


def read_source_batch(spark: SparkSession, path: str | list[str], source: str) -> DataFrame:
    """Files ``{"rows": [{header: value}, ...]}`` of one source as ingest items."""
    entries = _entries(spark, path, "map<string,string>", ROWS_SCHEMA)
    return entries.select(F.lit(source).alias("source"), F.col("entry").alias("raw_payload"))


def invalid_items(items: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """Items with an unknown source or without a row object."""
    known = F.coalesce(F.col("source").isin(*sources), F.lit(False))
    return items.where(~known | F.col("raw_payload").isNull())


def read_mixed_batch(
    spark: SparkSession, path: str | list[str], sources: Sequence[str] = SOURCES
) -> DataFrame:
    """Files ``{"rows": [{"source": ..., "row": {...}}, ...]}`` as ingest items.

    One bad entry rejects the whole batch before anything is written.
    """
    entries = _entries(spark, path, "source string, row map<string,string>", MIXED_SCHEMA)
    items = entries.select(F.col("entry.source").alias("source"), F.col("entry.row").alias("raw_payload"))
    bad = invalid_items(items, sources).limit(1).collect()
    if bad:
        raise BatchRejected(f"entry with unknown source or without cells (source: {bad[0].source})")
    return items


def read_json_lines(spark: SparkSession, path: str | list[str], source: str) -> DataFrame:
    """One lead object per line; splittable, for large drops. Bad lines: null payload."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(
        F.lit(source).alias("source"),
        F.from_json("value", "map<string,string>").alias("raw_payload"),
    )
