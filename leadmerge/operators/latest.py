"""First or last row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], chooser) -> DataFrame:
    """Aggregates instead of a window: rows are combined before the shuffle, so a
    key with a large share of the rows sends one row per task."""
    picked = df.groupBy(*keys).agg(
        chooser(F.struct(*df.columns), F.struct(*order)).alias("_row")
    )
    return picked.select("_row.*")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key."""
    return _pick(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per key."""
    return _pick(df, keys, order, F.min_by)


def distinct_occurrences(df: DataFrame, keys: Sequence[str] = ("source", "source_record_id")) -> DataFrame:
    """One row per occurrence key. Rows with equal keys are byte-identical."""
    return df.dropDuplicates(list(keys))
