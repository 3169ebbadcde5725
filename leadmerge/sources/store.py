"""State tables on Parquet.

Append-only: every run writes its own ``run_id=...`` folder and current values are
derived (latest status per lead, first and last sighting per source). A run is
visible once the ledger holds its finished row, so a run that died half way leaves
nothing behind that a reader would see, and repeating it overwrites its folder.
:meth:`LeadStore.compact` keeps the number of folders small. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from leadmerge.operators.incremental import least_keys, source_links
from leadmerge.operators.latest import latest_per_key
from leadmerge.operators.queue import current_jobs, current_status
from leadmerge.session import prepare

SCHEMAS = {
    "raw": "source string, source_record_id string, dedup_key string,"
    " raw_payload map<string,string>, received_at timestamp, run_id string",
    "sightings": "dedup_key string, source_record_id string, seen_at timestamp,"
    " run_id string, source string",
    "masters": "source_record_id string, dedup_key string, match_key string,"
    " post_id string, url string, owner_name string, message string,"
    " post_timestamp timestamp, scrape_timestamp timestamp, business_name string,"
    " phone string, phone2 string, email string, postcode string, address1 string,"
    " location string, norm_permalink string, norm_phone string, fingerprint string,"
    " possible_duplicate_of string, created_at timestamp, run_id string, source string",
    "status": "dedup_key string, status string, changed_at timestamp, step int, run_id string",
    "jobs": "job_id string, dedup_key string, status string, attempt_count int,"
    " next_retry_at timestamp, last_error string, rules_version string,"
    " created_at timestamp, updated_at timestamp, step int, run_id string",
    "results": "dedup_key string, job_id string, decision string, score int,"
    " confidence double, lead_type string, intent string, business_status string,"
    " contact_status string, is_residential boolean, is_promotional boolean,"
    " requires_manual_review boolean, reasons array<string>,"
    " extracted struct<business_name:string,phone:string,email:string,postcode:string>,"
    " layer string, rules_version string, prompt_version string, model string,"
    " prompt_tokens int, completion_tokens int, ai_cost_usd decimal(10,6), raw string,"
    " validated_at timestamp, run_id string",
    "evidence": "dedup_key string, provider string, post_exists boolean, post_text string,"
    " author string, post_date string, previous_posts array<string>, raw string,"
    " collected_at timestamp, run_id string",
    "exports": "dedup_key string, context string, exported_at timestamp, run_id string",
    "fingerprints": "fingerprint string, least_key string, run_id string",
    "superseded": "dedup_key string, match_key string, superseded_at timestamp, run_id string",
    "runs": "run_id string, kind string, source string, idempotency_key string,"
    " status string, started_at timestamp, finished_at timestamp, received bigint,"
    " inserted bigint, updated bigint, duplicates bigint, errors bigint, omitted bigint,"
    " jobs_created bigint, error_samples array<string>, replaced array<string>",
}


def _fold_sightings(rows: DataFrame) -> DataFrame:
    key = ["dedup_key", "source_record_id", "source"]
    ends = rows.groupBy(*key).agg(F.min("seen_at").alias("a"), F.max("seen_at").alias("b"))
    return ends.select(*key, F.explode(F.array_distinct(F.array("a", "b"))).alias("seen_at"))


# Logs of which readers need less than all rows: their runs are folded whenever they are compacted.
FOLDS = {
    "status": lambda rows: latest_per_key(rows, ["dedup_key"], ["changed_at", "step"]),
    "jobs": lambda rows: current_jobs(rows),
    "sightings": _fold_sightings,
    "fingerprints": least_keys,
}
# Tables of which every row counts: the folders of small runs are merged as they are.
MERGED = ("raw", "masters", "results", "evidence", "exports", "superseded")
#: Folders up to this size count as small; larger ones are never written again.
SMALL_BYTES = 256 << 20
# Ledger rows of runs whose folders are gone keep their history under this name.
_CLEARED = "cleared-"
# Tables split by source below the run, so that base lookups prune the rest.
BY_SOURCE = ("sightings", "masters")


def columns_of(table: str) -> list[str]:
    """Column names of a table (needs a running session)."""
    return T.StructType.fromDDL(SCHEMAS[table]).fieldNames()


def keyed_by(rows: DataFrame, keys: DataFrame | None) -> DataFrame:
    """Rows whose ``dedup_key`` occurs in ``keys``; all rows without ``keys``."""
    return rows if keys is None else rows.join(keys, "dedup_key", "left_semi")


def with_status(masters: DataFrame, log: DataFrame) -> DataFrame:
    """Masters with the last status of the log, INGESTED where it has none."""
    current = current_status(log)
    return masters.join(current, "dedup_key", "left").withColumn(
        "status", F.coalesce("status", F.lit("INGESTED"))
    )


class LeadStore:
    """Paths, schemas and current views of the state tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = prepare(spark)
        self.root = root.rstrip("/")

    # -- tables ------------------------------------------------------------------

    def _all(self, table: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[table])

    def read(self, *tables: str) -> DataFrame | list[DataFrame]:
        """Rows of all finished runs; unfinished runs are pruned as partitions.

        Several tables are read against the same state of the ledger.
        """
        hidden = self._hidden()
        frames = [self._all(t) for t in tables]
        for i, table in enumerate(tables):
            if names := [r for t, r in hidden if t in ("", table)]:
                frames[i] = frames[i].where(~F.col("run_id").isin(names))
        return frames[0] if len(frames) == 1 else frames

    def read_run(self, table: str, run_id: str) -> DataFrame:
        """Rows one run wrote, finished or not."""
        return self._all(table).where(F.col("run_id") == run_id)

    def write_run(self, table: str, run_id: str, rows: DataFrame) -> None:
        """Replace everything this run wrote to a table, whatever the session's
        overwrite mode is."""
        columns = [c for c in columns_of(table) if c != "run_id"]
        writer = rows.select(*columns).write.mode("overwrite")
        writer = writer.option("partitionOverwriteMode", "static")
        if table in BY_SOURCE:
            writer = writer.partitionBy("source")
        writer.parquet(f"{self.root}/{table}/run_id={run_id}")

    def stage(self, run_id: str, rows: DataFrame) -> DataFrame:
        """Write an intermediate table of a run and read it back.

        The batch is parsed and hashed once; later steps read columns of this
        table, on any executor.
        """
        path = f"{self.root}/stage/run_id={run_id}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop_stage(self, run_id: str) -> None:
        """Delete the intermediate table of a finished run."""
        self._delete(f"{self.root}/stage/run_id={run_id}")

    # -- clean-up ----------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def _names(self, table: str) -> list[str]:
        """Names directly below a table's folder."""
        path, fs = self._path(f"{self.root}/{table}")
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _bytes(self, table: str, name: str) -> int:
        path, fs = self._path(f"{self.root}/{table}/{name}")
        return fs.getContentSummary(path).getLength()

    def clear_dead_runs(self) -> int:
        """Delete what unfinished runs left behind; their ledger rows keep the history under another name."""
        dead = [r for t, r in self._hidden() if not t]
        for run_id in dead:
            for table in (*FOLDS, *MERGED, "stage"):
                self._delete(f"{self.root}/{table}/run_id={run_id}")
        for name in self._names("stage"):  # a staged batch outlives its run only if that died
            self._delete(f"{self.root}/stage/{name}")
        if dead:
            rows = self.runs()
            self._rewrite_ledger(rows.withColumn(
                "run_id", F.when(F.col("run_id").isin(dead), F.concat(F.lit(_CLEARED), "run_id")).otherwise(F.col("run_id"))
            ))
        return len(dead)

    def _rewrite_ledger(self, rows: DataFrame) -> int:
        old = [n for n in self._names("runs") if n.endswith(".parquet")]
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/runs")
        for name in old:
            self._delete(f"{self.root}/runs/{name}")
        return len(old)

    def compact(self, as_of: datetime | None = None, *, small_bytes: int = SMALL_BYTES) -> int:
        """Bring every table down to few folders; returns how many folders and files were replaced.

        Status and jobs keep the last state of a key, sightings the first and last of an
        occurrence. Of the other tables the folders of finished runs up to
        ``small_bytes`` become one; a folder that has grown beyond that is not read
        again, so a row is written a few times at most. The new run's ledger row names
        what it replaces, which hides it from readers from then on; it is deleted by the
        next call, so a reader that has listed its files can finish. Unfinished runs are
        cleared, and the ledger keeps the last row of a run.
        """
        as_of = as_of or utc_now()
        self.clear_dead_runs()
        hidden = {(t, f"run_id={r}") for t, r in self._hidden()}
        for table, name in hidden:
            self._delete(f"{self.root}/{table}/{name}")
        run_id = f"compact-{as_of:%Y%m%d%H%M%S%f}"
        log: dict[str, Any] = dict(run_id=run_id, kind="compact", started_at=as_of)
        old = {t: [n for n in self._names(t) if n.startswith("run_id=")] for t in (*FOLDS, *MERGED)}
        for table in MERGED:
            small = [n for n in old[table] if self._bytes(table, n) <= small_bytes]
            old[table] = small if len(small) > 1 else []
        self.log_run(**log, status="RUNNING")
        for table, names in old.items():
            if len(names) > 1:
                rows = self._all(table).where(F.col("run_id").isin([n.removeprefix("run_id=") for n in names]))
                rows = FOLDS[table](rows) if table in FOLDS else self._few_files(rows, sum(self._bytes(table, n) for n in names))
                self.write_run(table, run_id, rows)
        replaced = [f"{t}/{n.removeprefix('run_id=')}" for t, names in old.items() if len(names) > 1 for n in names]
        # What earlier calls replaced is gone, so only this call's list has to be read.
        files = self._rewrite_ledger(self.runs().withColumn("replaced", F.lit(None).cast("array<string>")))
        self.log_run(**log, status="COMPLETED", finished_at=as_of, replaced=replaced)
        return len(replaced) + files

    def _few_files(self, rows: DataFrame, size: int) -> DataFrame:
        """Rows of many small files in files of some hundred megabytes."""
        return rows.coalesce(max(1, -(-size // SMALL_BYTES)))

    # -- ledger ------------------------------------------------------------------

    def runs(self) -> DataFrame:
        """Last ledger row per run."""
        finished = F.struct(F.col("finished_at").isNotNull(), F.col("status") != "RUNNING", "finished_at")
        rows = self._all("runs")
        picked = rows.groupBy("run_id").agg(
            F.max_by(F.struct(*rows.columns), finished).alias("_r")
        )
        return picked.select("_r.*")

    def _hidden(self) -> list[tuple[str, str]]:
        """``(table, run)`` that readers pass over: replaced ones, and unfinished runs in any table ("").

        The list is bounded by what happened since the last :meth:`compact`.
        """
        runs = self._all("runs").where(~F.col("run_id").startswith(_CLEARED))
        ends = runs.groupBy("run_id").agg(F.max("finished_at").alias("f")).where("f is null")
        gone = runs.where("finished_at is not null").select(F.explode("replaced").alias("r")).distinct()
        open_ = ends.select(F.concat(F.lit("/"), "run_id").alias("r"))
        return [tuple(r.r.split("/", 1)) for r in open_.unionAll(gone).collect()]

    @contextmanager
    def running(self, kind: str, run_id: str, started_at: datetime, **fields: Any):
        """A run around a block: RUNNING before it, then COMPLETED with what the block
        puts into the given dict, or FAILED if it raises. Its staged tables go either way."""
        log = dict(run_id=run_id, kind=kind, started_at=started_at, **fields)
        self.log_run(**log, status="RUNNING")
        done: dict[str, Any] = {"status": "COMPLETED", "finished_at": started_at}
        try:
            yield done
        except Exception:
            # Not finished, so nothing of it is visible and it may be tried again.
            self.log_run(**log, status="FAILED")
            raise
        finally:
            for name in self._names("stage"):
                if name.startswith(f"run_id={run_id}"):
                    self._delete(f"{self.root}/stage/{name}")
        self.log_run(**{**log, **done})

    def log_run(self, **fields: Any) -> None:
        """Append one ledger row."""
        row = tuple(_aware(fields.get(n)) for n in columns_of("runs"))
        one = self.spark.createDataFrame([row], SCHEMAS["runs"]).coalesce(1)
        one.write.mode("append").parquet(f"{self.root}/runs")

    def finished_run(self, idempotency_key: str) -> dict[str, Any] | None:
        """Counts of the finished run with this key, if there is one."""
        hits = self._all("runs").where(
            (F.col("idempotency_key") == idempotency_key) & F.col("finished_at").isNotNull()
        )
        rows = hits.limit(1).collect()
        return rows[0].asDict() if rows else None

    # -- current views -------------------------------------------------------------

    def masters(self, only: DataFrame | None = None) -> DataFrame:
        """Masters with their current status.

        ``only`` narrows both tables to the keys of a frame before they are joined;
        give it a broadcast hint when its size is known to be small.
        """
        masters, log = self.read("masters", "status")
        return with_status(keyed_by(masters, only), keyed_by(log, only))

    def links(self, only: DataFrame | None = None) -> DataFrame:
        """One row per master and source with first and last sighting."""
        sightings, masters = self.read("sightings", "masters")
        return source_links(keyed_by(sightings, only), keyed_by(masters, only))

    def jobs(self) -> DataFrame:
        """Current state per job."""
        return current_jobs(self.read("jobs"))

    def raw(self, columns: Sequence[str] = ("source", "source_record_id", "dedup_key", "raw_payload", "received_at")) -> DataFrame:
        """Stored occurrences, one row each, as they first came."""
        return self.read("raw").select(*columns)

    def raw_refreshed(self) -> DataFrame:
        """Stored occurrences with the time and run of their last sighting.

        Sightings are reduced to one row per occurrence before they meet the payloads.
        """
        raw, sightings = self.read("raw", "sightings")
        key = ["source", "source_record_id"]
        last = sightings.groupBy(*key).agg(F.max(F.struct("seen_at", "run_id")).alias("_last"))
        rows = raw.select(*key, "dedup_key", "raw_payload", "received_at", "run_id").join(last, key, "left")
        return rows.select(
            *key, "dedup_key", "raw_payload",
            F.coalesce("_last.seen_at", "received_at").alias("received_at"),
            F.coalesce("_last.run_id", "run_id").alias("run_id"),
        )


def utc_now() -> datetime:
    """Wall clock for callers that give no ``as_of``."""
    return datetime.now(timezone.utc)


def _aware(value: Any) -> Any:
    """Datetimes without zone are meant as UTC."""
    if isinstance(value, datetime) and value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value
