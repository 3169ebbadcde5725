"""End-to-end scenarios on the state tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from leadmerge.operators.incremental import unlinked_raw
from leadmerge.plans.ingest import Names, SourceSpec, ingest, ingest_sources, replay_counts, run_id_for
from leadmerge.plans.serve import LeadReader
from leadmerge.plans.validate import drain, requeue, run_validation
from leadmerge.sources.store import SCHEMAS, LeadStore
from leads import (
    A_BASE, A_SECOND, B_BASE, C_SECOND, D_BASE, D_SECOND, base_row, items, secondary_row,
)

DAY1 = dt.datetime(2025, 3, 4, 10)
DAY2 = dt.datetime(2025, 3, 5, 10)


def test_other_source_names(spark, store):
    names = Names("CRM", "WEB")
    ingest(store, items(spark, "CRM", [A_BASE]), as_of=DAY1, names=names)
    ingest(store, items(spark, "WEB", [A_SECOND, C_SECOND]), as_of=DAY1, names=names)
    reader = LeadReader(store, names)
    s = reader.stats("2025-03-04").first()
    assert (s.base_total, s.secondary_only, s.duplicates_removed) == (1, 1, 1)
    assert [r.source for r in reader.page().orderBy("source").collect()] == ["CRM", "WEB"]
    assert reader.leads(source="web").count() == 1


@pytest.fixture
def store(spark, tmp_path):
    return LeadStore(spark, str(tmp_path / "state"))


def base_items(spark, rows):
    return items(spark, "NFULL", rows)


def second_items(spark, rows):
    return items(spark, "MFULL", rows)


def pick(result, *names):
    return tuple(result[n] for n in names)


def test_ingest_read_and_report(spark, store, tmp_path):
    base = base_items(spark, [A_BASE, B_BASE, D_BASE])
    second = second_items(spark, [A_SECOND, C_SECOND, D_SECOND])

    first = ingest(store, base, source="NFULL", idempotency_key="k1", as_of=DAY1)
    assert pick(first, "received", "inserted", "duplicates", "updated", "errors") == (3, 3, 0, 0, 0)
    then = ingest(store, second, source="MFULL", as_of=DAY1 + dt.timedelta(hours=1))
    assert pick(then, "received", "inserted", "duplicates", "omitted", "status") == (3, 2, 1, 1, "COMPLETED")
    assert store.read("masters").count() == 5

    # The omitted copy stays stored, without a master.
    left = unlinked_raw(store.raw(), store.read("masters")).collect()
    assert [(r.source, r.raw_payload["Company Name"]) for r in left] == [("MFULL", "Florist No 1 Limited")]

    # Again: nothing new, everything refreshed; links keep their first sighting.
    again = [ingest(store, b, source=s, as_of=DAY2) for s, b in (("NFULL", base), ("MFULL", second))]
    assert [pick(r, "inserted", "updated", "omitted") for r in again] == [(0, 3, 0), (0, 3, 1)]
    link = store.links().where("source = 'NFULL'").select("first_seen", "last_seen").distinct().collect()
    assert [(r.first_seen.day, r.last_seen.day) for r in link] == [(4, 5)]
    replayed = ingest(store, base, idempotency_key="k1", as_of=DAY2)
    assert replayed["replayed"] and pick(replayed, "received", "inserted") == (3, 3)

    reader = LeadReader(store)
    count = lambda **f: reader.leads(**f).count()
    assert (count(), count(source="NFULL"), count(source="mfull"), count(source="BOTH")) == (5, 3, 2, 0)
    assert (count(date="2025-03-04"), count(date="2025-03-05"), count(status="ingested")) == (5, 0, 5)

    s = reader.stats("2025-03-04").first()
    assert (s.combined_unique, s.found_by_both, s.base_only, s.secondary_only, s.duplicates_removed) == (5, 0, 3, 2, 1)
    assert (s.base_today, s.secondary_today, s.flagged_possible_duplicates, s.pending) == (3, 2, 0, 5)

    key = store.read("masters").where("business_name = 'Garage No 3'").first().dedup_key
    assert reader.mark_exported([key], "mail") == 1
    assert reader.mark_exported([key]) == 1
    assert (count(exported=True), count(exported=False)) == (1, 4)
    with pytest.raises(ValueError):
        reader.mark_exported([])

    page = reader.page(1, 2)
    assert page.count() == 2 and "Lead Proof URL" in page.columns
    summary = reader.page_summary(1, 2).first()
    assert (summary.total, summary.total_pages) == (5, 3)
    shown = reader.page(status="ingested", date="2025-03-04").collect()
    assert len(shown) == 5 and reader.page_summary(status="rejected").first().total == 0
    key_order = [(r.created_at, r.dedup_key) for r in store.read("masters").collect()]
    assert [r.master_id for r in shown] == [k for _, k in sorted(key_order, reverse=True)]
    filtered = reader.page(source="MFULL", exported=False)
    assert [r["Company Name"] for r in filtered.collect()] == ["Tailor No 4 Ltd"]
    assert reader.page_summary(source="MFULL").first().total == 2
    rows = {r["Company Name"]: r for r in reader.page().collect()}
    assert rows["Garage No 3"]["exported"] and rows["Garage No 3"]["source"] == "MFULL"
    assert rows["Garage No 3"][rows["Garage No 3"].__fields__[5]] == "Leeds, West Yorkshire"

    out = str(tmp_path / "csv")
    reader.export_csv(out)
    text = spark.read.text(out).collect()
    assert sum(r.value.startswith("Doors open") for r in text) == 5

    report = reader.dedup_report().first()
    assert (report.base_total, report.secondary_total, report.masters, report.merged) == (3, 2, 5, 0)
    assert reader.both_examples().count() == 0
    delta = {r.source: r.missing for r in reader.shadow(base.unionByName(second)).collect()}
    assert delta == {"NFULL": 0, "MFULL": 1}
    status = {r.source: r.updated for r in reader.pipeline_status().collect()}
    assert status == {"NFULL": 3, "MFULL": 3}
    assert reader.recent_runs(2).count() == 2
    assert reader.totals().first().raw_leads == 6
    c = replay_counts(store).first()
    assert (c.base, c.secondary_total, c.secondary_omitted, c.merged_total) == (3, 3, 1, 5)


def test_same_source_rows_are_kept(spark, store):
    rows = [
        base_row("One", "01130 100001", "https://x.org/1"),
        base_row("Two", "01130 100001", "https://x.org/2"),
        base_row("Three", "01130 100003", "https://x.org/3"),
    ]
    assert ingest(store, base_items(spark, rows), as_of=DAY1)["inserted"] == 3
    more = [
        secondary_row("Copy", "01130 100001", "https://y.org/1"),
        secondary_row("New", "01130 100009", "https://y.org/2"),
        secondary_row("Mute", "", "https://y.org/3"),
    ]
    result = ingest(store, second_items(spark, more), as_of=DAY1)
    assert pick(result, "inserted", "omitted") == (2, 1)
    assert store.read("masters").count() == 5


def test_order_of_batches_matters_and_replay_does_not(spark, store):
    ingest(store, second_items(spark, [A_SECOND]), as_of=DAY1)
    ingest(store, base_items(spark, [A_BASE]), as_of=DAY1)
    assert store.read("masters").count() == 2
    again = ingest(store, second_items(spark, [A_SECOND, A_SECOND]), as_of=DAY2)
    assert pick(again, "received", "inserted", "updated", "omitted") == (2, 0, 1, 2)
    assert replay_counts(store).first().merged_total == 1


def test_mixed_batch_sees_its_own_base(spark, store):
    mixed = second_items(spark, [A_SECOND, C_SECOND]).unionByName(base_items(spark, [A_BASE]))
    assert pick(ingest(store, mixed, as_of=DAY1), "inserted", "omitted") == (2, 1)


def test_bad_rows_are_counted_one_by_one(spark, store):
    schema = "source string, raw_payload map<string,string>"
    rows = [("NFULL", A_BASE), ("OTHER", B_BASE), ("NFULL", None), (None, B_BASE)]
    result = ingest(store, spark.createDataFrame(rows, schema), as_of=DAY1)
    assert pick(result, "received", "inserted", "errors", "status", "duplicates") == (4, 1, 3, "COMPLETED", 0)
    assert sorted(result["error_samples"]) == ["row is not an object", "unknown source OTHER", "unknown source null"]
    only_bad = ingest(store, spark.createDataFrame(rows[1:2], schema), as_of=DAY1)
    assert only_bad["status"] == "FAILED"
    with pytest.raises(ValueError):
        ingest(store, base_items(spark, [A_BASE, B_BASE]), max_rows=1)


def test_unfinished_run_is_invisible_and_repeated(spark, store, monkeypatch):
    ingest(store, base_items(spark, [B_BASE]), as_of=DAY1)
    real = LeadStore.log_run

    def dies(self, **fields):
        if fields.get("finished_at") is not None:
            raise RuntimeError("driver lost")
        real(self, **fields)

    monkeypatch.setattr(LeadStore, "log_run", dies)
    with pytest.raises(RuntimeError):
        mixed = base_items(spark, [A_BASE]).unionByName(second_items(spark, [C_SECOND]))
        ingest(store, mixed, idempotency_key="once", as_of=DAY1)
    monkeypatch.setattr(LeadStore, "log_run", real)
    assert store.read("masters").count() == 1 and store.read("raw").count() == 1
    result = ingest(store, base_items(spark, [A_BASE]), idempotency_key="once", as_of=DAY1)
    assert pick(result, "inserted", "replayed") == (1, False)
    # Nothing of the dead attempt is left, not even what the retry did not send.
    assert {r.business_name for r in store.read("masters").collect()} == {"Dentist No 2", "Florist No 1"}


def test_outage_of_one_source(spark, store):
    def broken():
        raise OSError("sheet unreachable")

    good = SourceSpec("MFULL", lambda: second_items(spark, [C_SECOND, D_SECOND]))
    bad = SourceSpec("NFULL", broken)
    result = ingest_sources(store, [bad, good], as_of=DAY1)
    assert not result["ok"] and result["errors"] == ["NFULL: sheet unreachable"]
    assert store.read("masters").count() == 2
    with pytest.raises(OSError):
        ingest_sources(store, [bad, good], stop_on_error=True)
    fixed = [SourceSpec("NFULL", lambda: base_items(spark, [])), good]
    for _ in range(2):
        assert ingest_sources(store, fixed, as_of=DAY1)["ok"]
        assert store.read("masters").count() == 2


def test_duplicate_flag_is_optional(spark, store):
    ingest(store, base_items(spark, [D_BASE]), as_of=DAY1)
    ingest(store, second_items(spark, [D_SECOND]), as_of=DAY1, flag_duplicates=True)
    keys = {r.source: r for r in store.read("masters").collect()}
    flags = [r.possible_duplicate_of for r in keys.values() if r.possible_duplicate_of]
    least = min(r.dedup_key for r in keys.values())
    assert flags in ([], [least]) and (keys["MFULL"].dedup_key != least) == bool(flags)


# -- validation -----------------------------------------------------------------------

LEADS = [
    base_row("Mill Cafe", "01130 500001", "https://www.facebook.com/a/posts/71"),
    base_row("Lantern Books", "01130 500002", "https://www.facebook.com/b/posts/72", message="We have moved"),
    base_row("Arch Bistro", "01130 500003", "https://www.facebook.com/c/posts/73", message="See our new menu"),
    base_row("Hill Academy", "01130 500004", "https://www.facebook.com/d/posts/74", message="A new school opens"),
    base_row("No Proof", "01130 500005", ""),
    base_row("Broken Co", "01130 500006", "https://www.facebook.com/f/posts/76"),
]
SCORES = {"Mill Cafe": ("GOOD", 88), "Lantern Books": ("GOOD", 60), "Arch Bistro": ("BAD", 20), "Hill Academy": ("GOOD", 90)}


def scorer(spark, seen):
    table = [
        (name, json.dumps({"content": [{"text": json.dumps({
            "verdict": v, "opportunity_score": s, "confidence": 90, "reasoning": "because",
            "key_factors": ["k"], "red_flags": ["r"],
            "caption_analysis": {"has_opening_keywords": name == "Mill Cafe"},
        })}]}))
        for name, (v, s) in SCORES.items()
    ]
    verdicts = spark.createDataFrame(table, "name string, response_json string")

    def score(rows):
        seen.append({r["Company Name"]: r["fetchResults"] for r in rows.collect()})
        named = rows.select("dedup_key", F.col("`Company Name`").alias("name"))
        return named.join(verdicts, "name", "left").select(
            "dedup_key", "response_json",
            F.when(F.col("response_json").isNull(), F.lit("upstream error")).alias("error"),
        )

    return score


def evidence(rows):
    body = F.to_json(F.struct(F.lit(True).alias("success"), F.col("`Lead Statement`").alias("postText")))
    return rows.select("dedup_key", body.alias("evidence_json"))


def test_validation_life_cycle(spark, store):
    result = ingest(store, base_items(spark, LEADS), as_of=DAY1, cutoff="2020-01-01T00:00:00Z")
    assert pick(result, "inserted", "jobs_created") == (6, 6)
    assert store.masters().where("status = 'READY_FOR_VALIDATION'").count() == 6

    seen = []
    options = dict(evidence=evidence, as_of=DAY1, max_attempts=2, retry_base_minutes=0)
    assert run_validation(store, scorer(spark, seen), limit=2, **options) == 2
    assert drain(store, scorer(spark, seen), **options) >= 4
    assert run_validation(store, scorer(spark, seen), **options) == 0
    assert all("No Proof" not in batch for batch in seen)
    assert all(v is not None for batch in seen for v in batch.values())

    status = {r.business_name: r.status for r in store.masters().collect()}
    assert status == {
        "Mill Cafe": "APPROVED", "Lantern Books": "REVIEW_REQUIRED", "Arch Bistro": "REJECTED",
        "Hill Academy": "REVIEW_REQUIRED", "No Proof": "REJECTED", "Broken Co": "REVIEW_REQUIRED",
    }
    names = store.read("masters").select("dedup_key", "business_name")
    results = {r.business_name: r for r in store.read("results").join(names, "dedup_key").collect()}
    assert results["No Proof"].layer == "deterministic"
    assert results["No Proof"].reasons == ["Deterministic reject: missing_or_invalid_proof"]
    assert (results["Mill Cafe"].score, results["Mill Cafe"].lead_type) == (88, "COMMERCIAL_COT")
    assert results["Mill Cafe"].reasons == ["k", "⚠ r", "because"]
    assert results["Hill Academy"].requires_manual_review
    assert "manual review" in results["Hill Academy"].reasons[-1]
    assert "Broken Co" not in results
    assert LeadReader(store).latest_results().count() == 5
    jobs = {r.business_name: r for r in store.jobs().join(names, "dedup_key").collect()}
    assert (jobs["Broken Co"].status, jobs["Broken Co"].attempt_count) == ("FAILED", 2)
    assert jobs["Broken Co"].last_error == "upstream error"
    assert jobs["Lantern Books"].status == "MANUAL_REVIEW"
    assert store.read("evidence").count() == 5  # fetched once, reused on the retry

    s = LeadReader(store).stats("2025-03-04").first()
    assert (s.approved, s.review_required, s.rejected, s.pending) == (1, 3, 2, 0)
    assert (s.validation_failures, s.rejected_before_ai, s.ai_calls) == (1, 1, 4)
    assert s.avg_validation_seconds == 0 and s.cost_per_approved_lead is None


def test_retry_waits_and_requeue(spark, store):
    ingest(store, base_items(spark, LEADS), as_of=DAY1)
    assert store.jobs().count() == 0
    assert requeue(store, limit=2, as_of=DAY1) == 2
    assert requeue(store, as_of=DAY1) == 4
    assert requeue(store, as_of=DAY1) == 0
    verdicts = spark.createDataFrame([], "dedup_key string, response_json string, error string")
    assert run_validation(store, verdicts, limit=None, as_of=DAY1) == 6
    assert run_validation(store, verdicts, limit=None, as_of=DAY1 + dt.timedelta(minutes=4)) == 0
    assert run_validation(store, verdicts, limit=None, as_of=DAY1 + dt.timedelta(minutes=5)) == 5
    due = store.jobs().where("status = 'RETRY'").select("next_retry_at", "attempt_count").distinct().collect()
    assert [(r.next_retry_at.minute, r.attempt_count) for r in due] == [(15, 2)]


def test_logs_stay_small_over_many_batches(spark, tmp_path):
    import os

    store = LeadStore(spark, str(tmp_path / "state"))
    shown = lambda: sorted((tuple(r) for r in LeadReader(store).leads().drop("run_id").collect()), key=repr)
    for i in range(6):
        at = dt.datetime(2025, 3, 4, i)
        ingest(store, items(spark, "NFULL", [A_BASE, base_row(f"Firm {i}", f"0150 0{i}00 000", "")]), source="NFULL",
               idempotency_key=f"b{i}", as_of=at, cutoff="2020-01-01")
        if i % 2:
            links, before, jobs = sorted(map(tuple, store.links().collect())), shown(), store.jobs().drop("run_id").count()
            listed = store.read("masters")  # a reader from before finishes after
            assert store.compact(at + dt.timedelta(minutes=1)) > 0
            assert listed.count() == store.read("masters").count() == i + 2
            assert (sorted(map(tuple, store.links().collect())), shown(), store.jobs().drop("run_id").count()) == (links, before, jobs)
        folders = {t: len(os.listdir(tmp_path / "state" / t)) for t in SCHEMAS if t != "runs" and (tmp_path / "state" / t).exists()}
        files = [f for f in os.listdir(tmp_path / "state" / "runs") if f.endswith(".parquet")]
        assert max(folders.values()) <= 6 and len(files) <= 8 and not os.listdir(tmp_path / "state" / "stage")
        assert {"raw", "masters", "superseded", "status", "jobs", "sightings"} <= set(folders)
    masters = store.read("masters").count()
    store.compact(at + dt.timedelta(minutes=2))
    assert all(len(os.listdir(tmp_path / "state" / t)) == 1 for t in folders) and store.read("masters").count() == masters
    # A folder that has grown is not written again.
    store.compact(at + dt.timedelta(minutes=3), small_bytes=0)
    assert os.listdir(tmp_path / "state" / "masters") and store.read("masters").count() == masters
    again = ingest(store, items(spark, "NFULL", [A_BASE]), source="NFULL", idempotency_key="b0")
    assert again["replayed"] and again["received"] == 2
    seen = {r.source_record_id: r.received_at for r in store.raw_refreshed().collect()}
    assert max(seen.values()) == dt.datetime(2025, 3, 4, 5) and len(seen) == 7


def test_failed_batch_is_logged_and_can_be_repeated(spark, tmp_path):
    store = LeadStore(spark, str(tmp_path / "state"))
    broken = items(spark, "NFULL", [A_BASE]).withColumn("raw_payload", F.when(F.col("source") == "x", F.col("raw_payload")).otherwise(F.raise_error(F.lit("torn file"))))
    with pytest.raises(Exception, match="torn file"):
        ingest(store, broken, source="NFULL", idempotency_key="k")
    assert [r.status for r in store.runs().collect()] == ["FAILED"] and store.read("masters").count() == 0
    # What it left behind goes, its history stays and is no longer looked out for.
    store.write_run("masters", run_id_for("k"), store.read("masters"))
    assert store.clear_dead_runs() == 1 and store.clear_dead_runs() == 0
    assert [(r.status, r.run_id) for r in store.runs().collect()] == [("FAILED", "cleared-" + run_id_for("k"))]
    assert not (tmp_path / "state" / "masters" / f"run_id={run_id_for('k')}").exists()
    done = ingest(store, items(spark, "NFULL", [A_BASE]), source="NFULL", idempotency_key="k")
    assert (done["replayed"], done["inserted"]) == (False, 1)
    with pytest.raises(ValueError, match="too large"):
        ingest(store, items(spark, "NFULL", [A_BASE, B_BASE]), source="NFULL", max_rows=1)
    assert store.runs().where("not startswith(run_id, 'cleared-')").count() == 1
    with pytest.raises(ZeroDivisionError):
        run_validation(store, lambda rows: 1 / 0, as_of=DAY1) if requeue(store, as_of=DAY1) else None
    assert {r.kind for r in store.runs().where("status = 'FAILED' and not startswith(run_id, 'cleared-')").collect()} == {"validate"}
    assert run_validation(store, spark.createDataFrame([], "dedup_key string, response_json string, error string"), as_of=dt.datetime(2020, 1, 1)) >= 0
    assert not [n for n in store._names("stage")]


def test_a_batch_of_one_scan_task_is_parsed_by_all_cores(spark, store, monkeypatch):
    staged, stage = [], LeadStore.stage
    monkeypatch.setattr(LeadStore, "stage", lambda self, run, rows: staged.append(rows.rdd.getNumPartitions()) or stage(self, run, rows))
    batch = base_items(spark, [A_BASE, B_BASE, D_BASE, {**A_BASE}]).coalesce(1)
    done = ingest(store, batch, as_of=DAY1)
    assert (done["received"], done["inserted"]) == (4, 3)
    assert staged[0] >= spark.sparkContext.defaultParallelism > 1
