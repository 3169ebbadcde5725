"""Validation queue: claims and state transitions.

The job table is a log of states; :func:`current_jobs` gives the state per job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from leadmerge.contract import (
    CLAIM_LIMIT_DEFAULT, JOB_ACTIVE, JOB_CLAIMABLE, LEAD_PENDING, MAX_ATTEMPTS,
    RETRY_BASE_MINUTES,
)
from leadmerge.functions import retry_at
from leadmerge.functions.times import as_instant
from leadmerge.operators.latest import latest_per_key


def current_jobs(log: DataFrame) -> DataFrame:
    """Last state per job."""
    return latest_per_key(log, ["job_id"], ["updated_at", "attempt_count", "step"])


def claimable(jobs: DataFrame, as_of) -> DataFrame:
    """Waiting jobs that are due."""
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_instant(as_of))
    return jobs.where(F.col("status").isin(*JOB_CLAIMABLE) & due)


def claim(
    jobs: DataFrame,
    as_of,
    *,
    limit: int | None = CLAIM_LIMIT_DEFAULT,
    order: Sequence[str] = ("created_at", "job_id"),
) -> DataFrame:
    """Due jobs, oldest first, set to PROCESSING with one more attempt.

    ``limit=None`` claims every due job; then nothing has to be sorted.
    """
    due = claimable(jobs, as_of)
    if limit is not None:
        due = due.orderBy(*order).limit(limit)
    return due.withColumn("status", F.lit("PROCESSING")).withColumn(
        "attempt_count", F.col("attempt_count") + 1
    )


def finished_status(decision: Column) -> Column:
    """Job state after a decision."""
    return F.when(decision == "REVIEW_REQUIRED", F.lit("MANUAL_REVIEW")).otherwise(F.lit("COMPLETED"))


def after_outcome(
    handled: DataFrame,
    as_of,
    *,
    max_attempts: int = MAX_ATTEMPTS,
    retry_base_minutes: float = RETRY_BASE_MINUTES,
) -> DataFrame:
    """Adds ``job_status``, ``next_retry_at``, ``last_error`` and ``lead_status``.

    ``handled`` has ``outcome``, ``decision``, ``attempt_count`` and ``error_text``.
    A failed job is retried with linear back-off until its attempts are used up;
    then it is FAILED and its lead goes to review. ``lead_status`` is null where the
    lead stays as it is.
    """
    failed = F.col("outcome") == "failed"
    dead = failed & (F.col("attempt_count") >= max_attempts)
    retry = failed & ~dead
    job_status = (
        F.when(dead, F.lit("FAILED"))
        .when(retry, F.lit("RETRY"))
        .when(F.col("outcome") == "decided", finished_status(F.col("decision")))
        .otherwise(F.lit("COMPLETED"))
    )
    lead_status = (
        F.when(dead, F.lit("REVIEW_REQUIRED"))
        .when(F.col("outcome") == "decided", F.col("decision"))
        .when(F.col("outcome") == "rejected", F.lit("REJECTED"))
    )
    due = retry_at(F.col("attempt_count"), retry_base_minutes, as_of)
    kept = [c for c in handled.columns if c not in ("next_retry_at", "last_error", "lead_status")]
    return handled.select(
        *kept,
        job_status.alias("job_status"),
        F.when(retry, due).alias("next_retry_at"),
        F.col("error_text").alias("last_error"),
        lead_status.alias("lead_status"),
    )


def requeue_candidates(
    masters: DataFrame,
    jobs: DataFrame,
    *,
    limit: int = 0,
    order: Sequence[str] = ("created_at", "dedup_key"),
) -> DataFrame:
    """Leads still INGESTED without an active job, oldest first; 0 means all."""
    active = jobs.where(F.col("status").isin(*JOB_ACTIVE)).select("dedup_key").distinct()
    waiting = masters.where(F.col("status") == "INGESTED").join(active, "dedup_key", "left_anti")
    return waiting.orderBy(*order).limit(limit) if limit > 0 else waiting


def current_status(log: DataFrame) -> DataFrame:
    """Last status per lead, as ``dedup_key, status``."""
    return log.groupBy("dedup_key").agg(F.max_by("status", F.struct("changed_at", "step")).alias("status"))


def status_bucket(status: Column) -> Column:
    """``pending`` for the states before a decision, else the state in lower case."""
    return F.when(status.isin(*LEAD_PENDING), F.lit("pending")).otherwise(F.lower(status))
