"""Queries that go through files and state tables: what they write is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadmerge.contract import ERROR_SAMPLES
from leadmerge.functions import tolerant_timestamp
from leadmerge.plans.catalog.leads import ADDRESS1, CANONICAL_SQL, base_payloads, order_phone, secondary_payloads
from leadmerge.plans.catalog.registry import Tables, query, text_time
from leadmerge.plans.ingest import SourceSpec, ingest, ingest_sources, replay_counts
from leadmerge.plans.serve import LeadReader
from leadmerge.plans.validate import drain
from leadmerge.session import cut_lineage, work_path
from leadmerge.sources import files, intake
from leadmerge.sources.sinks import write_csv
from leadmerge.sources.store import LeadStore

AS_OF = "2025-03-04 12:00:00"


def _store(t: Tables, label: str) -> LeadStore:
    return LeadStore(t.spark, work_path(t.spark, label))


def _at(text: str):
    from datetime import datetime, timezone

    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


# -- delimited files ---------------------------------------------------------------------

def _quoted(c):
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def order_lines(t: Tables, breaks: bool, *more) -> DataFrame:
    """Rows of a file as they come: empty cells anywhere, quotes, short, long and blank rows."""
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    note = F.concat(F.lit('said "'), F.col("o_orderpriority"), F.lit("\n" if breaks else " "), F.lit('", left'))
    cells = F.concat_ws(
        ",", text, F.when(key % 3 == 0, F.lit("")).otherwise(order_phone()),
        F.when(key % 2 == 0, _quoted(note)).otherwise(F.lit("")), F.col("o_orderstatus"),
    )
    line = (
        F.when(key % 7 == 1, text).when(key % 7 == 2, F.concat(cells, F.lit(",more,and more")))
        .when(key % 7 == 3, F.concat(cells, F.lit("\n,,,"))).otherwise(cells)
    )
    return t.orders.select(line.alias("value"), *more)


HEADER = "Key,Phone, Note,Status"


def _headed_files(t: Tables, breaks: bool) -> str:
    """A file with the header for every 5,000 order keys."""
    path, part = work_path(t.spark, "lines"), F.floor(F.col("o_orderkey") / 5000).alias("part")
    lines = order_lines(t, breaks, part).withColumn("first", F.lit(1))
    heads = t.orders.select(part).distinct().select("part", F.lit(HEADER).alias("value"), F.lit(0).alias("first"))
    dealt = lines.unionByName(heads).repartition("part").sortWithinPartitions("part", "first")
    dealt.drop("first").write.partitionBy("part").text(path)
    return path


# Keys per large file: as many blocks each, written by a task of its own.
LARGE_KEYS = 1_000_000


def _large_part():
    return F.floor(F.col("o_orderkey") / LARGE_KEYS).alias("part")


def _large_files(t: Tables, lines: list[DataFrame]) -> str:
    """Large files of all lines ``(part, value)``, one per part, in the order of the frames."""
    path = work_path(t.spark, "large")
    whole = lines[0].withColumn("place", F.lit(0))
    for i, more in enumerate(lines[1:], 1):
        whole = whole.unionByName(more.withColumn("place", F.lit(i)))
    dealt = whole.repartition("part").sortWithinPartitions("part", "place")
    dealt.select("part", "value").write.partitionBy("part").text(path)
    return path


def _in_blocks(t: Tables, path: str, read) -> DataFrame:
    """``read()`` with the files cut into 32 blocks or more, computed while that holds."""
    setting = "spark.sql.files.maxPartitionBytes"
    size = t.spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    before = t.spark.conf.get(setting, None)
    t.spark.conf.set(setting, str(max(4096, min(size // 32, 128 << 20))))
    try:
        return cut_lineage(read())
    finally:
        t.spark.conf.unset(setting) if before is None else t.spark.conf.set(setting, before)


def _line_cells(rows: DataFrame) -> DataFrame:
    cell = lambda name: F.col("raw_payload").getItem(name)
    return rows.select(
        "source", cell("Key").alias("key"), cell("Phone").alias("phone"), F.replace(cell(" Note"), F.lit("\n"), F.lit(" ")).alias("note"),
        cell("Status").alias("status"),
    )


LINES_SQL = """
select 'MFULL' as source, cast(o_orderkey as varchar) as key,
  case when o_orderkey % 7 = 1 or o_orderkey % 3 = 0 then '' else case o_orderkey % 5
    when 0 then '+44 (0)' || cast(1000000000 + 2 * o_custkey as varchar)
    when 1 then '0044 ' || cast(1000000000 + 2 * o_custkey as varchar)
    when 2 then '44' || cast(1000000000 + 2 * o_custkey as varchar)
    when 3 then '0' || cast(1000000000 + 2 * o_custkey as varchar)
    else 'N/A' end end as phone,
  case when o_orderkey % 7 <> 1 and o_orderkey % 2 = 0 then 'said "' || o_orderpriority || ' ", left' else '' end as note,
  case when o_orderkey % 7 = 1 then '' else o_orderstatus end as status
from orders"""


@query(LINES_SQL)
def csv_scan(t: Tables):
    """Many files with line breaks in cells."""
    return _line_cells(files.read_rows(t.spark, _headed_files(t, True), "MFULL"))


@query(LINES_SQL)
def csv_scan_split(t: Tables):
    """Many files without line breaks in cells, by Spark's own reader."""
    return _line_cells(files.read_rows(t.spark, _headed_files(t, False), "MFULL", multiline=False))


@query(LINES_SQL)
def csv_scan_large(t: Tables):
    """Large files with line breaks in cells, read block by block."""
    part = _large_part()
    path = _large_files(t, [t.orders.select(part).distinct().withColumn("value", F.lit(HEADER)), order_lines(t, True, part)])
    return _line_cells(_in_blocks(t, path, lambda: files.read_rows(t.spark, path, "MFULL")))


@query("""
select row_number() over (order by c_custkey desc) as place, c_name as company, c_custkey || ' Mill Lane' as address
from customer order by c_custkey desc limit 100""")
def csv_export(t: Tables):
    """The newest hundred leads through the CSV sink."""
    path = work_path(t.spark, "csv")
    rows = t.customer.orderBy(F.desc("c_custkey")).select(
        F.col("c_custkey").alias("place"), F.col("c_name").alias("Company Name"),
        F.concat(F.col("c_custkey").cast("string"), F.lit("\r\nMill Lane")).alias(ADDRESS1),
    )
    write_csv(rows, path, columns=("place", "Company Name", ADDRESS1), limit=100)
    back = t.spark.read.option("header", True).csv(path)
    from pyspark.sql import Window

    order = Window.orderBy(F.desc(F.col("place").cast("bigint")))  # at most a hundred rows
    return back.select(
        F.row_number().over(order).cast("bigint").alias("place"), F.col("Company Name").alias("company"), F.col(ADDRESS1).alias("address")
    )


@query("select 'first' as run, count(*) as received, count(*) as inserted, 0 as duplicates from customer"
       " union all select 'second', count(*), 0, count(*) from customer")
def file_reconcile(t: Tables):
    """The same whole file of base rows ingested twice."""
    store, path = _store(t, "reconcile"), work_path(t.spark, "base")
    cells = base_payloads(t).select("raw_payload")
    names = [r[0] for r in cells.limit(1).select(F.explode(F.map_keys("raw_payload"))).collect()]
    flat = cells.select(*[F.col("raw_payload").getItem(n).alias(n) for n in names])
    flat.write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
    spec = [SourceSpec("NFULL", lambda: files.read_rows(t.spark, path, "NFULL"))]
    return _counts(t, {"first": ingest_sources(store, spec)["totals"], "second": ingest_sources(store, spec)["totals"]})


def _counts(t: Tables, runs: dict[str, dict], names=("received", "inserted", "duplicates")) -> DataFrame:
    rows = [(run, *[int(c[n]) for n in names]) for run, c in runs.items()]
    return t.spark.createDataFrame(rows, "run string, " + ", ".join(f"{n} bigint" for n in names))


# -- pushed batches ------------------------------------------------------------------------

@query("select 'NFULL' as source, c_custkey as rec_id, c_name as name from customer"
       " union all select case o_orderkey % 2 when 0 then 'NFULL' else 'MFULL' end, o_orderkey, o_orderpriority from orders")
def pushed_batches(t: Tables):
    """Bodies of one source, and large mixed bodies of a whole table, read block by block."""
    one, key = work_path(t.spark, "one"), F.floor(F.col("c_custkey") / 5000).alias("part")
    bodies = t.customer.groupBy(key).agg(F.collect_list(_json_row("c_custkey", "c_name")).alias("rows"))
    bodies.select("part", F.to_json(F.struct("rows")).alias("value")).write.partitionBy("part").text(one)
    single = intake.read_source_batch(t.spark, one, "NFULL")
    path = _mixed_body(t, t.orders)
    both = _in_blocks(t, path, lambda: intake.read_mixed_batch(t.spark, path))
    cells = lambda df: df.select("source", F.col("raw_payload")["id"].cast("bigint").alias("rec_id"), F.col("raw_payload")["name"].alias("name"))
    return cells(single).unionAll(cells(both))


def _json_row(key: str, name: str):
    return F.struct(F.col(key).cast("string").alias("id"), F.col(name).alias("name"))


def _mixed_body(t: Tables, orders: DataFrame, source=None) -> str:
    """Large bodies with an entry per order; the smallest key of a body comes first."""
    source = F.when(F.col("o_orderkey") % 2 == 0, "NFULL").otherwise("MFULL") if source is None else source
    entry = F.to_json(F.struct(source.alias("source"), _json_row("o_orderkey", "o_orderpriority").alias("row")))
    part = _large_part()
    firsts = orders.where("o_orderkey is not null").groupBy(part).agg(F.min("o_orderkey").alias("first"))
    entries = orders.select(part, "o_orderkey", entry.alias("value")).join(F.broadcast(firsts), "part")
    is_first = F.col("o_orderkey") == F.col("first")
    head = entries.where(is_first).select("part", F.concat(F.lit('{"pushed": "now", "rows": ['), "value").alias("value"))
    rest = entries.where(~is_first).select("part", F.concat(F.lit(","), "value").alias("value"))
    return _large_files(t, [head, rest, firsts.select("part", F.lit("]}").alias("value"))])


@query("select 'none' as bad, false as rejected, count(*) as entries from orders union all select 'source', true, 0 union all select 'cells', true, 0")
def rejected_batches(t: Tables):
    """One entry of an unknown source, or without cells, rejects the bodies of a whole table."""
    last = t.orders.agg(F.max("o_orderkey")).first()[0]
    is_last, rows = F.col("o_orderkey") == last, []
    for bad, source, orders in (
        ("none", F.lit("NFULL"), t.orders), ("source", F.when(is_last, "OTHER").otherwise("NFULL"), t.orders), ("cells", F.when(~is_last, "NFULL"), t.orders),
    ):
        path = _mixed_body(t, orders, source)
        try:
            rows.append((bad, False, intake.read_mixed_batch(t.spark, path).count()))
        except intake.BatchRejected:
            rows.append((bad, True, 0))
    return t.spark.createDataFrame(rows, "bad string, rejected boolean, entries bigint")


# -- runs ------------------------------------------------------------------------------------

@query("select 'NFULL' as source, count(*) as received, count(*) as inserted, 1 as failed_sources, false as ok from customer")
def source_outage(t: Tables):
    """One source cannot be read; the other is ingested all the same."""
    store = _store(t, "outage")

    def broken() -> DataFrame:
        raise OSError("source is down")

    done = ingest_sources(store, [SourceSpec("MFULL", broken), SourceSpec("NFULL", lambda: base_payloads(t))])
    rows = [(r["source"], int(r["received"]), int(r["inserted"]), len(done["errors"]), done["ok"]) for r in done["ingest"]]
    return t.spark.createDataFrame(rows, "source string, received bigint, inserted bigint, failed_sources int, ok boolean")


@query("select 'first' as run, count(*) as received, count(*) as inserted, 0 as duplicates, false as replayed from customer"
       " union all select 'again', count(*), count(*), 0, true from customer")
def idempotent_ingest(t: Tables):
    """The same key twice: the second call is answered from the ledger, masters stay."""
    store = _store(t, "idem")
    runs = {n: ingest(store, base_payloads(t), source="NFULL", idempotency_key="k", as_of=_at(AS_OF)) for n in ("first", "again")}
    stored = store.read("masters").count()
    rows = [(n, int(r["received"]), stored, int(r["duplicates"]), r["replayed"]) for n, r in runs.items()]
    return t.spark.createDataFrame(rows, "run string, received bigint, inserted bigint, duplicates bigint, replayed boolean")


@query(f"""
with c as (
  select count(*) as received, count(*) filter (where o_orderkey % 3 = 0) as errors, count(*) filter (where o_orderkey % 3 <> 0) as inserted,
         least(count(*) filter (where o_orderkey % 3 = 0), {ERROR_SAMPLES}) as samples from orders)
select received, errors, inserted, 'row is not an object' as problem, true as sampled from c
union all select received, errors, inserted, 'unknown source OTHER', true from c
union all select received, errors, inserted, 'number of samples: ' || samples, true from c""")
def error_rows(t: Tables):
    """Rows without cells or with an unknown source are counted and sampled, the rest goes in."""
    store, key = _store(t, "errors"), F.col("o_orderkey")
    cells = F.create_map(F.lit("Company Name"), F.concat(F.lit("Order "), key.cast("string")))
    items = t.orders.select(
        F.when(key % 6 == 0, "OTHER").otherwise("NFULL").alias("source"), F.when(key % 6 != 3, cells).alias("raw_payload")
    )
    # One kind of error at a time, so that the samples cannot hide one behind the other.
    alone = {k: ingest(_store(t, f"errors{k}"), items.where(f"source is not null and (raw_payload is null) = {k}"), as_of=_at(AS_OF)) for k in ("true", "false")}
    done = ingest(store, items, as_of=_at(AS_OF))
    kinds = {"row is not an object": set(alone["true"]["error_samples"]), "unknown source OTHER": set(alone["false"]["error_samples"])}
    rows = [(int(done["received"]), int(done["errors"]), int(done["inserted"]), k, found == {k}) for k, found in kinds.items()]
    rows.append((*rows[0][:3], f"number of samples: {len(done['error_samples'])}", set(done["error_samples"]) <= set(kinds)))
    return t.spark.createDataFrame(rows, "received bigint, errors bigint, inserted bigint, problem string, sampled boolean")


@query(f"""
with {CANONICAL_SQL}, c as (select distinct source, dedup_key, match_key from canonical),
hit as (select match_key from c where source = 'NFULL' and match_key is not null)
select count(*) filter (where source = 'NFULL') as base, count(*) filter (where source = 'MFULL') as secondary_total,
       count(*) filter (where source = 'MFULL' and match_key in (select match_key from hit)) as secondary_omitted,
       count(*) filter (where source = 'MFULL' and (match_key is null or match_key not in (select match_key from hit))) as secondary_only,
       count(*) filter (where source = 'NFULL' or match_key is null or match_key not in (select match_key from hit)) as merged_total
from c""")
def replay_merge(t: Tables):
    """Merge counts recomputed from the stored payloads; the secondary rows were stored first."""
    store = _store(t, "replay")
    ingest(store, secondary_payloads(t), source="MFULL", as_of=_at(AS_OF))
    ingest(store, base_payloads(t), source="NFULL", as_of=_at("2025-03-04 13:00:00"))
    return replay_counts(store)


@query("""
select 'stopped' as way, true as raised, 'NFULL' as source, count(*) as masters from customer union all
select 'went on', false, 'NFULL', count(*) from customer""")
def backfill_stops(t: Tables):
    """A one-shot backfill ends at the first source that fails, what came before it stays."""
    def broken() -> DataFrame:
        raise OSError("source is down")

    rows, specs = [], [SourceSpec("NFULL", lambda: base_payloads(t)), SourceSpec("OTHER", broken), SourceSpec("MFULL", lambda: secondary_payloads(t).limit(0))]
    for way, stop in (("stopped", True), ("went on", False)):
        store, raised = _store(t, "backfill"), False
        try:
            ingest_sources(store, specs, stop_on_error=stop, as_of=_at(AS_OF))
        except OSError:
            raised = True
        counts = store.read("masters").groupBy("source").count().collect()
        rows += [(way, raised, r["source"], r["count"]) for r in counts]
        assert store.runs().where("source = 'MFULL'").isEmpty() == stop
    return t.spark.createDataFrame(rows, "way string, raised boolean, source string, masters bigint")


@query("select 3 as n, 'NFULL' as source, count(*) as received from customer union all select 2, 'NFULL', count(*) from customer")
def recent_runs(t: Tables):
    """The two newest of three runs, by the reader."""
    store = _store(t, "runs")
    for n in (1, 2, 3):
        ingest(store, base_payloads(t), source="NFULL", as_of=_at(f"2025-03-04 1{n}:00:00"))
    runs = LeadReader(store).recent_runs(2)
    return runs.select((F.hour("started_at") - 10).alias("n"), "source", "received")


@query("select 'pending' as part, 0 as leads union all select 'decided', count(*) from customer where c_custkey % 4 < 2"
       " union all select 'rejected', count(*) from customer where c_custkey % 4 >= 2"
       " union all select 'exported', count(*) from customer where c_custkey % 2 = 0")
def drained_queue(t: Tables):
    """Every queued lead is handled, by screen or verdict; half of the leads are marked as exported."""
    store, as_of = _store(t, "drain"), _at("2023-11-15 00:00:00")
    ingest(store, base_payloads(t), source="NFULL", as_of=as_of, cutoff="2020-01-01")
    answer = '{"verdict": "GOOD", "opportunity_score": 90, "confidence": 0.9}'
    verdicts = store.read("masters").select("dedup_key", F.lit(answer).alias("response_json"), F.lit(None).cast("string").alias("error"))
    drain(store, verdicts, as_of=as_of)
    reader, even = LeadReader(store), F.regexp_extract("address1", r"^(\d+)", 1).cast("bigint") % 2 == 0
    reader.mark_exported(store.read("masters").where(even).select("dedup_key"), as_of=as_of)
    layer = store.read("results").select(F.when(F.col("layer") == "deterministic", "rejected").otherwise("decided").alias("part"))
    waiting = store.jobs().where(F.col("status").isin("PENDING", "RETRY", "PROCESSING"))
    one = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("leads"))
    parts = [one("pending", waiting), one("decided", layer.where("part = 'decided'")), one("rejected", layer.where("part = 'rejected'")),
             one("exported", store.read("exports"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("""
select cast(user_id as varchar) as dedup_key, event_type as source, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen
from events where user_id in (select c_custkey from customer) group by all""")
def source_links_of_masters(t: Tables):
    from leadmerge.operators.incremental import source_links

    seen = t.events.select(F.col("user_id").cast("string").alias("dedup_key"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("seen_at"))
    masters = t.customer.select(F.col("c_custkey").cast("string").alias("dedup_key"))
    return source_links(seen, masters).select("dedup_key", "source", text_time(F.col("first_seen")).alias("first_seen"))


# -- times -----------------------------------------------------------------------------------

@query("""
with t as (select o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) as ts from orders),
raw as (select o_orderkey, case o_orderkey % 8
    when 0 then strftime(ts, '%-m/%-d/%y') when 1 then strftime(ts, '%-m/%-d/%Y %-I:%M %p')
    when 2 then strftime(ts, '%b %-d %Y %-I:%M %p') when 3 then upper(strftime(ts, '%b %-d %Y'))
    when 4 then strftime(ts, '%-d-%b-%Y') when 5 then strftime(ts, '%-m/%-d/%Y %H:%M:%S') || '.456'
    when 6 then strftime(ts, '%-m/%-d/%Y %H:%M') || ' GMT+1'
    else strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0100' end as raw_time,
  case when o_orderkey % 8 in (0, 3, 4) then date_trunc('day', ts)
       when o_orderkey % 8 in (1, 2) then date_trunc('minute', ts)
       when o_orderkey % 8 = 5 then date_trunc('second', ts)
       when o_orderkey % 8 = 6 then date_trunc('minute', ts) - interval 1 hour
       else date_trunc('second', ts) - interval 1 hour end as parsed from t)
select o_orderkey, raw_time, strftime(parsed, '%Y-%m-%d %H:%M:%S') as parsed from raw""")
def spelled_times(t: Tables):
    ts = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 86400) * 1000000)
    kind = F.col("o_orderkey") % 8
    shown = lambda shape, tail="": F.concat(F.date_format(ts, shape), F.lit(tail))
    raw = (
        F.when(kind == 0, shown("M/d/yy")).when(kind == 1, shown("M/d/yyyy h:mm a")).when(kind == 2, shown("MMM d yyyy h:mm a"))
        .when(kind == 3, F.upper(shown("MMM d yyyy"))).when(kind == 4, shown("d-MMM-yyyy"))
        .when(kind == 5, shown("M/d/yyyy HH:mm:ss", ".456")).when(kind == 6, shown("M/d/yyyy HH:mm", " GMT+1"))
        .otherwise(shown("EEE, dd MMM yyyy HH:mm:ss", " +0100"))
    )
    rows = t.orders.select("o_orderkey", raw.alias("raw_time"))
    return rows.withColumn("parsed", text_time(tolerant_timestamp(F.col("raw_time"))))


@query("select c_custkey as rec_id, '+44' || (1000000000 + c_custkey) as match_key from customer")
def ingest_base(t: Tables):
    """All base rows through the whole ingest; the masters as stored."""
    store = _store(t, "ingest")
    ingest(store, base_payloads(t), source="NFULL", as_of=_at(AS_OF))
    number = F.regexp_extract("address1", r"^(\d+)", 1).cast("bigint")
    return store.read("masters").select(number.alias("rec_id"), "match_key")
