"""Testing rows of one table for a key of another, safe against hot and missing keys.

Row-level semi, anti and mark joins all go through :func:`mark_members`. The left
side is read once and joined once:

* the right side is reduced to distinct keys first, so copies collapse before
  they are shuffled and no row is multiplied;
* keyless rows match nothing; a second join column deals them over all partitions,
  where a join on the key alone would gather them in one;
* a heavy key of the left side makes a large partition whose other side is one row
  per key: adaptive execution splits it (``skewJoin``, set by ``session.prepare``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Largest batch whose keys are broadcast to probe a stored table.
PROBE_ROWS = 200_000
# Parts over which rows without key are dealt.
KEYLESS_PARTS = 1 << 16


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys."""
    return df.where(F.col(key).isNotNull()).select(key).distinct()


def _deal(rows: DataFrame, key: str) -> Column:
    """0 for rows with a key, spread values for rows without."""
    part = F.pmod(F.monotonically_increasing_id(), F.lit(KEYLESS_PARTS)).cast("int")
    return F.when(F.col(key).isNull(), part).otherwise(F.lit(0))


def mark_members(rows: DataFrame, keys: DataFrame, key: str, flag: str = "is_member") -> DataFrame:
    """All ``rows`` plus a boolean: does ``key`` occur in ``keys``? Null: false."""
    members = distinct_keys(keys, key).withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False)).alias(flag)
    return attach(rows, members, key).select(*rows.columns, hit)


def keep_members(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return mark_members(rows, keys, key, "_member").where("_member").drop("_member")


def drop_members(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is null or does not occur in ``keys``."""
    return mark_members(rows, keys, key, "_member").where("not _member").drop("_member")


def attach(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join to a lookup with one row per key; keyless rows get nulls."""
    added = [c for c in lookup.columns if c != key]
    dealt = rows.withColumn("_deal", _deal(rows, key))
    found = lookup.where(F.col(key).isNotNull()).withColumn("_deal", F.lit(0))
    return dealt.join(found, [key, "_deal"], "left").select(*rows.columns, *added)


def stored_keys(
    stored: DataFrame, batch: DataFrame, key: str, batch_rows: int | None = None
) -> DataFrame:
    """Keys of a stored table, narrowed to those a small batch can meet.

    A stored table grows without limit while a batch is small, and an anti join
    cannot broadcast its left side. With a known batch size up to ``PROBE_ROWS``
    the batch keys are broadcast and the stored keys are filtered where they lie,
    without a shuffle. Larger or unknown batches compare against all stored keys
    in a shuffled join.
    """
    return stored_keys_of(stored.where(F.col(key).isNotNull()).select(key), batch, key, batch_rows)


def stored_keys_of(stored: DataFrame, batch: DataFrame, key: str, batch_rows: int | None = None) -> DataFrame:
    """Stored rows, narrowed by their key to those a small batch can meet."""
    if batch_rows is not None and batch_rows <= PROBE_ROWS:
        return stored.join(F.broadcast(distinct_keys(batch, key)), key, "left_semi")
    return stored
