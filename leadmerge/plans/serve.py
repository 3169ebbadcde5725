"""Read side: lists, pages, statistics, export marks, reports."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from leadmerge.contract import EXAMPLES_LIMIT, RUNS_LIMIT_DEFAULT, RUNS_LIMIT_MAX
from leadmerge.functions.times import as_instant
from leadmerge.operators import reports, stats
from leadmerge.operators.canonical import display_rows
from leadmerge.operators.latest import latest_per_key
from leadmerge.operators.listing import lead_list, master_filters, page_after, page_of, page_summary
from leadmerge.operators.onerow import side_by_side
from leadmerge.plans.ingest import Names
from leadmerge.session import cut_lineage
from leadmerge.sources.sinks import write_csv
from leadmerge.sources.store import LeadStore, keyed_by, utc_now, with_status


class LeadReader:
    """Queries over the state tables; pages and marks run jobs, the rest is lazy."""

    def __init__(self, store: LeadStore, names: Names = Names()):
        self.store = store
        self.names = names
        self._pair = {"base": names.base, "secondary": names.secondary}

    def leads(self, **filters) -> DataFrame:
        """All matching masters with sources and export mark."""
        s = self.store
        return lead_list(s.masters(), s.links(), s.read("exports"), known=self._known(), **filters)

    def _known(self) -> tuple[str, str]:
        return (self.names.base, self.names.secondary)

    def page(
        self,
        page: int | None = None,
        page_size: int | None = None,
        *,
        date: str | None = None,
        status: str | None = None,
        **filters,
    ) -> DataFrame:
        """One page of display rows, newest first.

        Without a source or export filter the page is cut from the masters first
        (every master has a link) and written to the checkpoint folder; its keys, at
        most one page, then probe the other tables, which are not shuffled.
        """
        if filters:
            rows = self.leads(date=date, status=status, **filters)
            return display_rows(page_of(rows, page, page_size))
        top = cut_lineage(page_of(self._filtered(date, status), page, page_size))
        keys = F.broadcast(top.select("dedup_key"))
        log, exports = self.store.read("status", "exports")
        rows = with_status(top.drop("status"), keyed_by(log, keys))
        rows = lead_list(rows, self.store.links(keys), keyed_by(exports, keys), known=self._known())
        return display_rows(rows.orderBy(F.desc("created_at"), F.desc("dedup_key")))

    def _filtered(self, date: str | None, status: str | None) -> DataFrame:
        """Masters after their own filters; the status is joined only if asked for."""
        masters = self.store.masters() if status else self.store.read("masters")
        where = master_filters(date, status)
        return masters if where is None else masters.where(where)

    def page_summary(
        self,
        page: int | None = None,
        page_size: int | None = None,
        *,
        date: str | None = None,
        status: str | None = None,
        **filters,
    ) -> DataFrame:
        """Total and number of pages for the same filters."""
        if filters:
            rows = self.leads(date=date, status=status, mark_exported=False, **filters)
        else:
            rows = self._filtered(date, status)
        return page_summary(rows, page, page_size)

    def export_csv(self, path: str, *, limit: int | None = None, **filters) -> None:
        """Write matching display rows as CSV part files, newest first."""
        rows = self.leads(**filters).orderBy(F.desc("created_at"), F.desc("dedup_key"))
        write_csv(display_rows(rows), path, limit=limit)

    def page_after(self, created_at, dedup_key: str, page_size: int | None = None, **filters) -> DataFrame:
        """Display rows behind a known last row, newest first; costs the same at any depth."""
        return display_rows(page_after(self.leads(**filters), created_at, dedup_key, page_size))

    def stats(self, as_of_date: str) -> DataFrame:
        """Overview, source comparison and validation figures in one row."""
        s = self.store
        return side_by_side(
            stats.overview(s.read("masters"), s.read("raw"), s.links(), as_of_date, **self._pair),
            stats.validation_counts(s.masters(), s.jobs(), s.read("results")),
        )

    def pipeline_status(self) -> DataFrame:
        """Latest ingest run per source."""
        runs = self.store.runs().where("kind = 'ingest' and source is not null")
        return latest_per_key(runs, ["source"], ["started_at", "run_id"])

    def totals(self) -> DataFrame:
        """Masters, raw rows and flagged masters in one row."""
        s = self.store
        return side_by_side(
            s.read("masters").agg(
                F.count("*").alias("master_leads"),
                F.count("possible_duplicate_of").alias("flagged_possible_duplicates"),
            ),
            s.read("raw").agg(F.count("*").alias("raw_leads")),
        )

    def recent_runs(self, limit: int | None = None) -> DataFrame:
        """Last ingest runs, newest first."""
        n = min(limit or RUNS_LIMIT_DEFAULT, RUNS_LIMIT_MAX)
        runs = self.store.runs().where("kind = 'ingest'")
        return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)

    def mark_exported(self, keys: DataFrame | list[str], context: str | None = None, *, as_of: datetime | None = None) -> int:
        """Append export marks for masters. Marks may repeat; an empty list is an error."""
        spark, as_of = self.store.spark, as_of or utc_now()
        if not isinstance(keys, DataFrame):
            if not keys:
                raise ValueError("no master keys to mark")
            keys = spark.createDataFrame([(k,) for k in keys], "dedup_key string")
        elif keys.isEmpty():
            raise ValueError("no master keys to mark")
        run_id = f"export-{uuid.uuid4().hex}"
        with self.store.running("export", run_id, as_of) as run:
            rows = keys.select(
                "dedup_key",
                F.lit(context).cast("string").alias("context"),
                as_instant(as_of).alias("exported_at"),
            )
            self.store.write_run("exports", run_id, rows)
            run["received"] = marked = self.store.read_run("exports", run_id).count()
        return marked

    def superseded(self) -> DataFrame:
        """Secondary masters that a base row of a later batch made redundant, and when."""
        return self.store.read("superseded").select("dedup_key", "match_key", "superseded_at")

    def latest_results(self) -> DataFrame:
        """Last stored decision per lead."""
        results = self.store.read("results")
        return latest_per_key(results, ["dedup_key"], ["validated_at", "run_id"])

    def dedup_report(self) -> DataFrame:
        """Occurrences, masters and overlap of the sources in one row."""
        return reports.dedup_report(self.store.read("masters"), self.store.links(), **self._pair)

    def both_examples(self, limit: int = EXAMPLES_LIMIT) -> DataFrame:
        """Some masters both sources found."""
        return reports.both_examples(self.store.read("masters"), self.store.links(), limit, **self._pair)

    def shadow(self, served: DataFrame) -> DataFrame:
        """Rows the sources serve against rows stored, per source."""
        return reports.shadow_delta(served, self.store.links())
