"""Batch merge of a secondary source into a base source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadmerge.operators.membership import distinct_keys, drop_members, keep_members, mark_members
from leadmerge.operators.onerow import side_by_side


def kept_secondary(base: DataFrame, secondary: DataFrame, key: str = "match_key") -> DataFrame:
    """Secondary rows whose key is null or absent from the base."""
    return drop_members(secondary, base, key)


def omitted_secondary(base: DataFrame, secondary: DataFrame, key: str = "match_key") -> DataFrame:
    """Secondary rows the base already has."""
    return keep_members(secondary, base, key)


def split_secondary(base: DataFrame, secondary: DataFrame, key: str = "match_key") -> DataFrame:
    """All secondary rows with ``omitted`` true or false, in one pass."""
    return mark_members(secondary, base, key, "omitted")


def asymmetric_merge(base: DataFrame, secondary: DataFrame, key: str = "match_key") -> DataFrame:
    """Every base row, and every secondary row the base does not have.

    Neither source is deduplicated against itself.
    """
    return base.unionByName(kept_secondary(base, secondary, key))


def merge_counts(base: DataFrame, secondary: DataFrame, key: str = "match_key") -> DataFrame:
    """One row: base, secondary_total, secondary_omitted, secondary_only, merged_total.

    Works on per-key counts, which are combined before the shuffle, so no row of
    either source is joined and a heavy key costs one row.
    """
    per_key = secondary.groupBy(key).agg(F.count("*").alias("_n"))
    members = distinct_keys(base, key).withColumn("_hit", F.lit(True))
    secondary_part = per_key.join(members, key, "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("secondary_total"),
        F.coalesce(F.sum(F.when(F.col("_hit"), F.col("_n"))), F.lit(0)).alias("secondary_omitted"),
    )
    both = side_by_side(base.agg(F.count("*").alias("base")), secondary_part)
    only = F.col("secondary_total") - F.col("secondary_omitted")
    return both.select(
        "base",
        "secondary_total",
        "secondary_omitted",
        only.alias("secondary_only"),
        (F.col("base") + only).alias("merged_total"),
    )


def key_coverage(rows: DataFrame, source: str = "source", key: str = "match_key") -> DataFrame:
    """Per source: rows with a key, of all rows."""
    return rows.groupBy(source).agg(
        F.count(key).alias("keyed"), F.count("*").alias("total")
    )


def mapping_coverage(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Non-null count per mapped column, and the total. ``columns``: column -> name."""
    return rows.agg(
        *[F.count(c).alias(name) for c, name in columns.items()], F.count("*").alias("total")
    )
