"""Reconciliation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadmerge.contract import BASE_SOURCE, EXAMPLES_LIMIT, SECONDARY_SOURCE
from leadmerge.operators.onerow import side_by_side
from leadmerge.operators.stats import found_by_both, link_counts


def shadow_delta(served: DataFrame, links: DataFrame) -> DataFrame:
    """Per source: rows served, rows stored, rows missing from the store.

    Sources on either side are kept; stored rows of a source that serves nothing make
    ``missing`` negative.
    ``served``: rows of the sources with a ``source`` column.
    """
    there = served.groupBy("source").agg(F.count("*").alias("served"))
    here = links.groupBy("source").agg(F.count("*").alias("stored"))
    both = there.join(here, "source", "full").select(
        "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("served", "stored")]
    )
    return both.withColumn("missing", F.col("served") - F.col("stored"))


def duplicates_merged(links: DataFrame, masters: DataFrame) -> DataFrame:
    """One row: occurrences, masters, duplicates_merged."""
    parts = side_by_side(
        links.agg(F.count("*").alias("occurrences")), masters.agg(F.count("*").alias("masters"))
    )
    return parts.withColumn("duplicates_merged", F.col("occurrences") - F.col("masters"))


def dedup_report(masters: DataFrame, links: DataFrame, *, base: str = BASE_SOURCE, secondary: str = SECONDARY_SOURCE) -> DataFrame:
    """One row: occurrences per source, masters, merged, both/only, flagged."""
    counts = link_counts(links, "1970-01-01", base=base, secondary=secondary)
    parts = side_by_side(
        counts,
        masters.agg(
            F.count("*").alias("masters"), F.count("possible_duplicate_of").alias("flagged")
        ),
    )
    return parts.select(
        "base_total",
        "secondary_total",
        "masters",
        (F.col("base_total") + F.col("secondary_total") - F.col("masters")).alias("merged"),
        "base_only",
        "secondary_only",
        "found_by_both",
        "flagged",
    )


def both_examples(masters: DataFrame, links: DataFrame, limit: int = EXAMPLES_LIMIT, **names) -> DataFrame:
    """First masters that both sources found, with what they were matched on."""
    hits = masters.join(found_by_both(links, **names), "dedup_key", "left_semi")
    matched_on = F.coalesce(
        F.concat(F.lit("permalink "), F.col("norm_permalink")),
        F.concat(F.lit("phone "), F.col("norm_phone")),
        F.lit("fuzzy"),
    )
    top = hits.orderBy("dedup_key").limit(limit)
    return top.select(
        "dedup_key", F.coalesce("business_name", F.lit("(no name)")).alias("business_name"),
        matched_on.alias("matched_on"),
    )


def run_totals(runs: DataFrame) -> DataFrame:
    """Sums of the run counts."""
    names = ("received", "inserted", "duplicates", "errors")
    return runs.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
