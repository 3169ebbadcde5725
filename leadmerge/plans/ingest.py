"""Incremental ingest of one batch into the state tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, functions as F

from leadmerge.contract import (
    BASE_SOURCE, ERROR_SAMPLES, RULES_VERSION, SECONDARY_SOURCE,
)
from leadmerge.functions import parse_cutoff
from leadmerge.functions.times import as_instant
from leadmerge.operators.canonical import canonical, with_fingerprint
from leadmerge.operators.incremental import (
    after_cutoff, classify_occurrences, flag_against, jobs_to_enqueue, least_keys, new_masters,
    newly_superseded, omitted_count,
)
from leadmerge.operators.membership import PROBE_ROWS
from leadmerge.operators.merge import merge_counts
from leadmerge.operators.onerow import side_by_side
from leadmerge.operators.queue import current_jobs
from leadmerge.session import dealt
from leadmerge.sources.store import LeadStore, keyed_by, utc_now

COUNTS = ("received", "inserted", "updated", "duplicates", "errors", "omitted", "jobs_created")


@dataclass(frozen=True)
class Names:
    """The two sources of a merge."""

    base: str = BASE_SOURCE
    secondary: str = SECONDARY_SOURCE


def run_id_for(idempotency_key: str | None) -> str:
    """The same key always writes to the same run folders."""
    if idempotency_key is None:
        return uuid.uuid4().hex
    return hashlib.sha256(idempotency_key.encode()).hexdigest()[:32]


def ingest(
    store: LeadStore,
    items: DataFrame,
    *,
    source: str | None = None,
    idempotency_key: str | None = None,
    as_of: datetime | None = None,
    cutoff: str | None = None,
    names: Names = Names(),
    max_rows: int | None = None,
    flag_duplicates: bool = False,
    **mapping,
) -> dict[str, Any]:
    """Ingest items ``(source, raw_payload)`` as one run and return its counts.

    A key that already finished returns the stored counts without reading the
    items. A key whose run did not finish is processed again. Rows without payload
    or with an unknown source are counted as errors and left out; they do not take
    other rows with them.
    """
    if idempotency_key is not None:
        done = store.finished_run(idempotency_key)
        if done is not None:
            return {**_result(done), "replayed": True}
    if max_rows is not None and (given := items.limit(max_rows + 1).count()) > max_rows:
        raise ValueError(f"batch too large ({given} > {max_rows})")
    run_id, as_of = run_id_for(idempotency_key), as_of or utc_now()
    with store.running("ingest", run_id, as_of, source=source, idempotency_key=idempotency_key) as run:
        status, counts = _ingest(
            store, items, run_id, as_of, cutoff=cutoff, names=names, flag_duplicates=flag_duplicates, **mapping
        )
        run |= dict(status=status, **counts)
    return {"run_id": run_id, "status": status, **counts, "replayed": False}


def _ingest(
    store: LeadStore, items: DataFrame, run_id: str, as_of: datetime, *, cutoff: str | None, names: Names,
    flag_duplicates: bool, **mapping,
) -> tuple[str, dict[str, Any]]:
    """Write the tables of one run; its status and counts."""
    known = F.coalesce(F.col("source").isin(names.base, names.secondary), F.lit(False))
    problem = (
        F.when(~known, F.concat(F.lit("unknown source "), F.coalesce("source", F.lit("null"))))
        .when(F.col("raw_payload").isNull(), F.lit("row is not an object"))
    )
    parsed = canonical(dealt(items.select("source", "raw_payload", problem.alias("problem"))), **mapping)
    staged = store.stage(run_id, with_fingerprint(parsed))
    received, errors = staged.agg(F.count("*"), F.count("problem")).first()
    samples = [r.problem for r in staged.where("problem is not null").limit(ERROR_SAMPLES).collect()]
    good, rows = staged.where("problem is null").drop("problem"), received - errors

    now = as_instant(as_of)
    masters_before, raw_before = store.read("masters", "raw")
    fresh = classify_occurrences(good, raw_before, rows).where("is_new")
    store.write_run("raw", run_id, fresh.withColumn("received_at", now))
    seen = good.select("source", "source_record_id", "dedup_key").distinct()
    store.write_run("sightings", run_id, seen.withColumn("seen_at", now))
    added = new_masters(
        good.drop("raw_payload"), masters_before, rows, base=names.base, secondary=names.secondary
    )
    added = added.withColumn("created_at", now).withColumn("possible_duplicate_of", F.lit(None).cast("string"))
    if flag_duplicates:
        added = flag_against(added.drop("possible_duplicate_of"), store.read("fingerprints").drop("run_id"), rows)
    store.write_run("masters", run_id, added)

    written = store.read_run("masters", run_id)
    store.write_run("fingerprints", run_id, least_keys(written, "dedup_key"))
    late = newly_superseded(written, masters_before, rows, base=names.base, secondary=names.secondary)
    store.write_run("superseded", run_id, late.withColumn("superseded_at", now))
    wrote = side_by_side(
        written.agg(F.count("*").alias("inserted")),
        store.read_run("raw", run_id).agg(F.count("*").alias("new_raw")),
        store.read_run("sightings", run_id).agg(F.count("*").alias("seen")),
        omitted_count(good, masters_before, rows, base=names.base, secondary=names.secondary),
    ).first()
    inserted, updated, omitted = wrote.inserted, wrote.seen - wrote.new_raw, wrote.omitted
    queued = _enqueue(store, run_id, written, inserted, cutoff, now) if cutoff else 0
    counts = dict(
        received=received,
        inserted=inserted,
        updated=updated,
        duplicates=rows - inserted,
        errors=errors,
        omitted=omitted,
        jobs_created=queued,
        error_samples=samples,
    )
    return ("FAILED" if errors > 0 and inserted == 0 else "COMPLETED"), counts


def _result(row: dict[str, Any]) -> dict[str, Any]:
    kept = ("run_id", "status", *COUNTS, "error_samples")
    return {k: row[k] for k in kept}


def _enqueue(store: LeadStore, run_id: str, written: DataFrame, rows: int, cutoff: str, now) -> int:
    candidates = after_cutoff(written, parse_cutoff(cutoff))
    # Only the jobs of this batch's leads are folded; a small batch probes the log.
    keys = written.select("dedup_key")
    log = keyed_by(store.read("jobs"), F.broadcast(keys) if rows <= PROBE_ROWS else keys)
    jobs = jobs_to_enqueue(candidates, current_jobs(log), rules_version=RULES_VERSION)
    return queue_jobs(store, run_id, jobs, now)


def queue_jobs(store: LeadStore, run_id: str, jobs: DataFrame, now) -> int:
    """Write PENDING jobs and mark their leads READY_FOR_VALIDATION."""
    pending = jobs.select(
        F.concat_ws(":", "dedup_key", F.lit(run_id)).alias("job_id"),
        "dedup_key",
        F.lit("PENDING").alias("status"),
        F.lit(0).alias("attempt_count"),
        F.lit(None).cast("timestamp").alias("next_retry_at"),
        F.lit(None).cast("string").alias("last_error"),
        "rules_version",
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(0).alias("step"),
    )
    store.write_run("jobs", run_id, pending)
    queued = store.read_run("jobs", run_id)
    ready = queued.select(
        "dedup_key",
        F.lit("READY_FOR_VALIDATION").alias("status"),
        now.alias("changed_at"),
        F.lit(1).alias("step"),
    )
    store.write_run("status", run_id, ready)
    return queued.count()


# -- several sources -----------------------------------------------------------------

@dataclass(frozen=True)
class SourceSpec:
    """A configured source: its name and how to read its items."""

    name: str
    read: Callable[[], DataFrame]


def ingest_sources(
    store: LeadStore, specs: Iterable[SourceSpec], *, stop_on_error: bool = False, **options
) -> dict[str, Any]:
    """Ingest every source; one that fails is recorded and the rest go on.

    ``stop_on_error=True`` is the one-shot backfill: the first failure is raised.
    """
    done: list[dict[str, Any]] = []
    failed: list[str] = []
    for spec in specs:
        try:
            result = ingest(store, spec.read(), source=spec.name, **options)
        except Exception as error:  # noqa: BLE001 - any outage of one source
            if stop_on_error:
                raise
            failed.append(f"{spec.name}: {error}")
            continue
        done.append({"source": spec.name, **result})
    totals = {n: sum(r[n] for r in done) for n in COUNTS}
    return {"ok": not failed, "ingest": done, "totals": totals, "errors": failed}


def replay(store: LeadStore, *, names: Names = Names(), **mapping) -> tuple[DataFrame, DataFrame]:
    """Recompute canonical rows from the stored payloads: ``(base, secondary)``."""
    rows = canonical(dealt(store.raw(("source", "raw_payload"))), **mapping)
    return rows.where(F.col("source") == names.base), rows.where(F.col("source") == names.secondary)


def replay_counts(store: LeadStore, *, names: Names = Names(), **mapping) -> DataFrame:
    """Order-free merge counts over everything stored."""
    return merge_counts(*replay(store, names=names, **mapping))
