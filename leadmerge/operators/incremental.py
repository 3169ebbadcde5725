"""Steps of the incremental ingest as pure DataFrame operators.

``stage`` is a canonical batch (both sources). ``stored_*`` are tables of earlier
batches. ``batch_rows`` is the known size of the batch, if it is known; it only
picks the join strategy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadmerge.contract import BASE_SOURCE, JOB_ACTIVE, RULES_VERSION, SECONDARY_SOURCE
from leadmerge.operators.latest import distinct_occurrences
from leadmerge.operators.membership import (
    PROBE_ROWS, attach, distinct_keys, drop_members, keep_members, stored_keys, stored_keys_of,
)


def classify_occurrences(
    stage: DataFrame, stored_raw: DataFrame, batch_rows: int | None = None
) -> DataFrame:
    """Distinct occurrences of the batch with ``is_new``: not stored before."""
    rows = distinct_occurrences(stage)
    known = stored_keys(stored_raw, rows, "source_record_id", batch_rows).distinct()
    known = known.withColumn("_known", F.lit(True))
    return (
        rows.join(known, "source_record_id", "left")
        .withColumn("is_new", F.col("_known").isNull())
        .select(*rows.columns, "is_new")
    )


def base_match_keys(
    stage: DataFrame,
    stored_masters: DataFrame,
    batch_rows: int | None = None,
    *,
    base: str = BASE_SOURCE,
) -> DataFrame:
    """Match keys of the base: stored masters and this batch together."""
    stored = stored_masters.where(F.col("source") == base)
    mine = stage.where((F.col("source") == base) & F.col("match_key").isNotNull())
    return stored_keys(stored, stage, "match_key", batch_rows).unionByName(
        mine.select("match_key")
    )


def new_masters(
    stage: DataFrame,
    stored_masters: DataFrame,
    batch_rows: int | None = None,
    *,
    base: str = BASE_SOURCE,
    secondary: str = SECONDARY_SOURCE,
) -> DataFrame:
    """Masters this batch adds.

    Base rows always; secondary rows unless the base (stored, or in this batch) has
    their match key; neither if the same row is stored already. A secondary master
    stored earlier is never removed, so the result depends on the order of batches.
    """
    rows = stage.dropDuplicates(["dedup_key"])
    base_rows = rows.where(F.col("source") == base)
    secondary_rows = rows.where(F.col("source") == secondary)
    keys = base_match_keys(stage, stored_masters, batch_rows, base=base)
    candidates = base_rows.unionByName(
        drop_members(secondary_rows, keys, "match_key")
    )
    known = stored_keys(stored_masters, rows, "dedup_key", batch_rows)
    return candidates.join(known, "dedup_key", "left_anti")


def superseded_masters(masters: DataFrame, *, base: str = BASE_SOURCE, secondary: str = SECONDARY_SOURCE) -> DataFrame:
    """``(dedup_key, match_key)``: secondary masters whose match key a base master has.

    They came before that base row; a merge that knows all rows would leave them out.
    So this is what the order of batches added to the masters.
    """
    stored = masters.where(F.col("source") == secondary).select("dedup_key", "match_key")
    return keep_members(stored, masters.where(F.col("source") == base), "match_key")


def newly_superseded(
    added: DataFrame, stored_masters: DataFrame, batch_rows: int | None = None, *, base: str = BASE_SOURCE, secondary: str = SECONDARY_SOURCE
) -> DataFrame:
    """What the base masters ``added`` by a batch supersede, each master in one batch only.

    Added up over all batches this is :func:`superseded_masters` of the result. A small
    batch probes the stored masters with its keys; keys that an earlier base master has
    are left out, since their secondary masters were reported with it.
    """
    keys = distinct_keys(added.where(F.col("source") == base), "match_key")
    earlier = stored_keys(stored_masters.where(F.col("source") == base), keys, "match_key", batch_rows)
    fresh = keys.join(earlier.distinct(), "match_key", "left_anti")
    late = stored_masters.where((F.col("source") == secondary) & F.col("match_key").isNotNull()).select("dedup_key", "match_key")
    if batch_rows is not None and batch_rows <= PROBE_ROWS:
        return late.join(F.broadcast(fresh), "match_key", "left_semi").select("dedup_key", "match_key")
    return keep_members(late, fresh, "match_key")


def omitted_count(
    stage: DataFrame,
    stored_masters: DataFrame,
    batch_rows: int | None = None,
    *,
    base: str = BASE_SOURCE,
    secondary: str = SECONDARY_SOURCE,
) -> DataFrame:
    """One row ``omitted``: staged secondary rows (copies included) the base has."""
    per_key = (
        stage.where((F.col("source") == secondary) & F.col("match_key").isNotNull())
        .groupBy("match_key")
        .agg(F.count("*").alias("_n"))
    )
    keys = base_match_keys(stage, stored_masters, batch_rows, base=base).distinct()
    hits = per_key.join(keys, "match_key", "left_semi")
    return hits.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("omitted"))


def link_raw(raw: DataFrame, masters: DataFrame) -> DataFrame:
    """Stored occurrences with their master; ``master_key`` is null if unlinked.

    For heavy dedup keys (many copies) see :func:`attach`.
    """
    keys = masters.select("dedup_key").distinct().withColumn("master_key", F.col("dedup_key"))
    return attach(raw, keys, "dedup_key")


def unlinked_raw(raw: DataFrame, masters: DataFrame) -> DataFrame:
    """Stored occurrences that became no master."""
    return drop_members(raw, masters, "dedup_key")


def changed_links(linked: DataFrame, old: str = "old_master", new: str = "master_key") -> DataFrame:
    """Links that differ from before, null-safe."""
    return linked.where(~F.col(old).eqNullSafe(F.col(new)))


def source_links(sightings: DataFrame, masters: DataFrame | None = None) -> DataFrame:
    """Which source found which master: ``first_seen``, ``last_seen`` per pair.

    Sightings are reduced to one row per pair before they meet the masters.
    """
    links = sightings.groupBy("dedup_key", "source").agg(
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen")
    )
    if masters is None:
        return links
    return links.join(masters.select("dedup_key"), "dedup_key", "left_semi")


def after_cutoff(masters: DataFrame, cutoff: Column) -> DataFrame:
    """Masters scraped at or after the cut-off; none when the cut-off is null."""
    return masters.where(F.col("scrape_timestamp") >= cutoff)


def jobs_to_enqueue(
    candidates: DataFrame, jobs: DataFrame, *, rules_version: str = RULES_VERSION
) -> DataFrame:
    """``(dedup_key, rules_version)`` for candidates without an active job."""
    active = jobs.where(F.col("status").isin(*JOB_ACTIVE)).select("dedup_key").distinct()
    free = candidates.select("dedup_key").join(active, "dedup_key", "left_anti")
    return free.select("dedup_key", F.lit(rules_version).alias("rules_version"))


def possible_duplicates(masters: DataFrame, key: str = "dedup_key", fingerprint: str = "fingerprint") -> DataFrame:
    """Optional flag: ``possible_duplicate_of`` is the least key with the same
    fingerprint, null for that one and for rows without fingerprint.

    The least key is aggregated first and joined back, so no fingerprint group is
    ever gathered in one task.
    """
    least = (
        masters.where(F.col(fingerprint).isNotNull())
        .groupBy(fingerprint)
        .agg(F.min(key).alias("_least"))
    )
    flagged = attach(masters, least, fingerprint)
    return flagged.withColumn(
        "possible_duplicate_of", F.when(F.col("_least") != F.col(key), F.col("_least"))
    ).drop("_least")


def least_keys(rows: DataFrame, key: str = "least_key", fingerprint: str = "fingerprint") -> DataFrame:
    """``(fingerprint, least_key)``: the least key of each fingerprint."""
    return rows.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("fingerprint")).agg(F.min(key).alias("least_key"))


def flag_against(added: DataFrame, stored: DataFrame, batch_rows: int | None = None, key: str = "dedup_key", fingerprint: str = "fingerprint") -> DataFrame:
    """:func:`possible_duplicates` of a batch against what is stored.

    ``stored`` has a row ``(fingerprint, least_key)`` or more for each stored
    fingerprint; a small batch probes it with its own.
    """
    mine = least_keys(added, key, fingerprint)
    known = stored_keys_of(stored, mine, "fingerprint", batch_rows)
    least = least_keys(known.unionByName(mine)).withColumnRenamed("least_key", "_least")
    flagged = attach(added, least.withColumnRenamed("fingerprint", fingerprint), fingerprint)
    return flagged.withColumn(
        "possible_duplicate_of", F.when(F.col("_least") != F.col(key), F.col("_least"))
    ).drop("_least")
