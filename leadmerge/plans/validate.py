"""Validation of queued leads as one job per claimed batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from leadmerge.contract import (
    CLAIM_LIMIT_DEFAULT, MAX_ATTEMPTS, RETRY_BASE_MINUTES, RULES_VERSION,
)
from leadmerge.functions.times import as_instant
from leadmerge.operators.canonical import lead_rows
from leadmerge.operators.membership import PROBE_ROWS
from leadmerge.operators.latest import first_per_key, latest_per_key
from leadmerge.operators.payloads import merge_payloads
from leadmerge.operators.queue import after_outcome, claim, requeue_candidates
from leadmerge.operators.validation import (
    RESULT_COLUMNS, attach_evidence, evidence_records, latest_evidence, needs_evidence,
    reject_records, result_records, screen, validate_batch,
)
from leadmerge.plans.ingest import queue_jobs
from leadmerge.sources.store import LeadStore, keyed_by, utc_now

# Lead rows in, (dedup_key, response_json, error) or (dedup_key, evidence_json) out.
Scorer = Callable[[DataFrame], DataFrame]


def scoring_rows(
    store: LeadStore,
    masters: DataFrame,
    evidence: DataFrame | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Verbose lead rows with merged payloads, and the stored evidence if given.

    ``keys`` (a superset of the masters' keys) narrows the stored payloads.
    """
    raw = keyed_by(store.raw(), masters.select("dedup_key") if keys is None else keys)
    merged = masters.join(merge_payloads(raw), "dedup_key", "left")
    rows = lead_rows(merged, "merged_payload")
    if evidence is None:
        return rows
    results = evidence.select("dedup_key", F.col("raw").alias("fetchResults"))
    return attach_evidence(rows, results)


def run_validation(
    store: LeadStore,
    scorer: Scorer | DataFrame,
    *,
    evidence: Scorer | None = None,
    as_of: datetime | None = None,
    limit: int | None = CLAIM_LIMIT_DEFAULT,
    max_attempts: int = MAX_ATTEMPTS,
    retry_base_minutes: float = RETRY_BASE_MINUTES,
    **rules,
) -> int:
    """Claim due jobs, run all layers, store results and transitions.

    ``scorer`` is a table of verdicts ``(dedup_key, response_json, error)`` or a
    function from lead rows to such a table. Only leads that pass the deterministic
    layer reach it. Returns the number of jobs handled. Nothing of a run that dies
    is visible, so its jobs are claimed again.
    """
    run_id, as_of = f"validate-{uuid.uuid4().hex}", as_of or utc_now()
    claimed = store.stage(run_id, claim(store.jobs(), as_of, limit=limit))
    handled = claimed.count()
    if handled == 0:
        store.drop_stage(run_id)
        return 0
    with store.running("validate", run_id, as_of) as run:
        _handle(store, run_id, claimed, handled, scorer, evidence, as_of, max_attempts, retry_base_minutes, rules)
        run["received"] = handled
    return handled


def _handle(
    store: LeadStore, run_id: str, claimed: DataFrame, handled: int, scorer: Scorer | DataFrame, evidence: Scorer | None,
    as_of: datetime, max_attempts: int, retry_base_minutes: float, rules: dict,
) -> None:
    """All layers over the claimed jobs, and what they write."""
    now = as_instant(as_of)
    keys = claimed.select("dedup_key").distinct()
    # A bounded claim probes the stored tables; a large one is a shuffled join.
    keys = F.broadcast(keys) if handled <= PROBE_ROWS else keys
    masters = store.masters(keys)
    screen_rules = {k: v for k, v in rules.items() if k in ("freshness_hours", "keywords")}
    passed = screen(masters, as_of, **screen_rules).where("reject_reason is null")
    stored = latest_evidence(keyed_by(store.read("evidence"), keys))
    if evidence is not None:
        missing = needs_evidence(passed, stored)
        fetched = evidence_records(evidence(scoring_rows(store, missing, keys=keys)))
        store.write_run("evidence", run_id, fetched.withColumn("collected_at", now))
        stored = stored.unionByName(latest_evidence(store.read_run("evidence", run_id)))
    if isinstance(scorer, DataFrame):
        # A table of verdicts may be large: only those of the claimed leads are compared.
        verdicts = latest_verdicts(keyed_by(scorer, keys))
    else:
        verdicts = latest_verdicts(scorer(scoring_rows(store, passed, stored, keys)))

    keep = ["dedup_key", "norm_permalink", "message", "location", "post_timestamp", "business_name", "phone", "postcode"]
    outcome = validate_batch(claimed, masters.select(*keep), verdicts, as_of, **rules)
    moved = after_outcome(
        outcome, as_of, max_attempts=max_attempts, retry_base_minutes=retry_base_minutes
    )
    # Verdicts may come from a caller's function: fix them before they are used thrice.
    moved = store.stage(f"{run_id}-outcome", moved)

    decided = result_records(moved.where("outcome = 'decided'"))
    rejected = reject_records(moved.where("outcome = 'rejected'"))
    results = decided.select(*RESULT_COLUMNS).unionByName(rejected.select(*RESULT_COLUMNS))
    store.write_run("results", run_id, results.withColumn("validated_at", now))

    started = claimed.select(
        *[c for c in claimed.columns if c not in ("updated_at", "step")],
        now.alias("updated_at"), F.lit(1).alias("step"),
    )
    finished = moved.select(
        *[c for c in claimed.columns if c not in ("status", "updated_at", "step")],
        F.col("job_status").alias("status"), now.alias("updated_at"), F.lit(2).alias("step"),
    )
    store.write_run("jobs", run_id, started.unionByName(finished))

    validating = moved.where("outcome <> 'missing'").select(
        "dedup_key", F.lit("VALIDATING").alias("status"), now.alias("changed_at"), F.lit(2).alias("step")
    )
    final = moved.where("lead_status is not null").select(
        "dedup_key", F.col("lead_status").alias("status"), now.alias("changed_at"), F.lit(3).alias("step")
    )
    store.write_run("status", run_id, validating.unionByName(final))


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict per lead: the last one if the table has a ``scored_at``, else the
    least by content, so that a repeated job picks the same."""
    columns = ["dedup_key", "response_json", "error"]
    if "scored_at" in verdicts.columns:
        return latest_per_key(verdicts, ["dedup_key"], ["scored_at"]).select(*columns)
    return first_per_key(verdicts.select(*columns), ["dedup_key"], ["response_json", "error"])


def drain(store: LeadStore, scorer: Scorer | DataFrame, **options) -> int:
    """Handle batches until no job is due, however many that takes.

    Every round moves its jobs on: they end, or wait with one attempt less.
    """
    total = 0
    while handled := run_validation(store, scorer, **{"limit": None, **options}):
        total += handled
    return total


def requeue(store: LeadStore, *, limit: int = 0, as_of: datetime | None = None) -> int:
    """Queue leads that never got a job, oldest first; 0 means all."""
    run_id, as_of = f"requeue-{uuid.uuid4().hex}", as_of or utc_now()
    with store.running("requeue", run_id, as_of) as run:
        chosen = requeue_candidates(store.masters(), store.jobs(), limit=limit)
        jobs = chosen.select("dedup_key", F.lit(RULES_VERSION).alias("rules_version"))
        run["received"] = queued = queue_jobs(store, run_id, jobs, as_instant(as_of))
    return queued
