"""Files, pushed batches, CSV output and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leadmerge.contract import DISPLAY_HEADERS
from leadmerge.plans.ingest import SourceSpec, ingest, ingest_sources
from leadmerge.sources import files, grids, intake
from leadmerge.sources.sinks import csv_lines, write_csv
from leadmerge.sources.store import LeadStore
from leadmerge.streaming.ingest import item_stream, start_ingest
from leads import A_BASE, A_SECOND, B_BASE, C_SECOND


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def payloads(df):
    return [r.raw_payload for r in df.collect()]


def test_delimited_file(spark, tmp_path):
    text = (
        ",,\r\n"
        'Company Name  ,"Note, long",Key,Key\r\n'
        '"ABC ""x"", Ltd","two\nlines",1,2,surplus\r\n'
        " ,,\r\n"
        "Short\r\n"
    )
    path = write(tmp_path / "a.csv", text)
    got = payloads(files.read_rows(spark, path, "S"))
    assert got == [
        {"Company Name  ": 'ABC "x", Ltd', "Note, long": "two\nlines", "Key": "2"},
        {"Company Name  ": "Short", "Note, long": "", "Key": ""},
    ]


def test_every_file_has_its_own_header(spark, tmp_path):
    write(tmp_path / "a.csv", "A,B\n1,2\n")
    write(tmp_path / "b.csv", "Title\n\nB,A\n3,4\n5,6\n")
    write(tmp_path / "c.csv", "\n\n")
    write(tmp_path / "d.csv", "A,B\n")
    got = payloads(files.read_rows(spark, str(tmp_path), "S", min_cells=2))
    assert sorted(got, key=repr) == sorted([{"A": "1", "B": "2"}, {"B": "3", "A": "4"}, {"B": "5", "A": "6"}], key=repr)
    first = payloads(files.read_rows(spark, str(tmp_path / "b.csv"), "S"))
    assert {"Title": "B"} in first and {"Title": "3"} in first


def test_split_files_without_line_breaks_in_cells(spark, tmp_path):
    lines = "\n".join(f"{i},v{i}" for i in range(3000))
    path = write(tmp_path / "big.csv", "Key,Value\n" + lines + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        cells = files.read_cells(spark, path, multiline=False)
        assert cells.rdd.getNumPartitions() > 1
        got = payloads(files.read_rows(spark, path, "S", multiline=False))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3000 and all(r["Value"] == "v" + r["Key"] for r in got)


def test_wide_header_fails_and_wide_row_is_cut(spark, tmp_path):
    path = write(tmp_path / "w.csv", "a,b\n1,2,3,4,5\n")
    assert payloads(files.read_rows(spark, path, "S", max_columns=2)) == [{"a": "1", "b": "2"}]
    path = write(tmp_path / "x.csv", "a,b,c\n1,2\n")
    with pytest.raises(Exception, match="more than 2 columns"):
        files.read_rows(spark, path, "S", max_columns=2).collect()


def test_empty_cells_keep_their_place(spark, tmp_path):
    path = write(tmp_path / "e.csv", 'a,b,c,d\n1,,"",4\n,2,,\n,,3\n')
    got = payloads(files.read_rows(spark, path, "S"))
    assert [list(r.values()) for r in got] == [["1", "", "", "4"], ["", "2", "", ""], ["", "", "3", ""]]


def test_grid_counts(spark):
    rows = [("g", i, c) for i, c in enumerate([["", "", "", "x"], ["h"], [None, " ", "y"]])] + [("e", 0, [""])]
    df = spark.createDataFrame(rows, "grid_id string, row_idx long, cells array<string>")
    assert {r.grid_id: (r.populated_rows, r.data_rows) for r in grids.grid_counts(df).collect()} == {"g": (2, 1), "e": (0, 0)}


def test_pushed_batches(spark, tmp_path):
    one = write(tmp_path / "one.json", json.dumps({"rows": [A_BASE, {"n": 5, "t": True, "x": None}]}))
    got = intake.read_source_batch(spark, one, "NFULL").collect()
    assert [r.source for r in got] == ["NFULL"] * 2 and got[1].raw_payload == {"n": "5", "t": "true", "x": None}
    for i, body in enumerate(['{"rows": {}}', "{}", "nonsense"]):
        with pytest.raises(intake.BatchRejected):
            intake.read_source_batch(spark, write(tmp_path / f"bad{i}.json", body), "NFULL")

    good = {"rows": [{"source": "NFULL", "row": A_BASE}, {"source": "MFULL", "row": A_SECOND}]}
    path = write(tmp_path / "mixed.json", json.dumps(good))
    assert {r.source for r in intake.read_mixed_batch(spark, path).collect()} == {"NFULL", "MFULL"}
    bad = [[{"source": "OTHER", "row": A_BASE}], [{"source": "NFULL", "row": None}], [{"source": "NFULL", "row": 5}], [{"row": A_BASE}]]
    for i, rows in enumerate(bad):
        path = write(tmp_path / f"mixed{i}.json", json.dumps({"rows": good["rows"] + rows}))
        with pytest.raises(intake.BatchRejected):
            intake.read_mixed_batch(spark, path)

    lines = write(tmp_path / "rows.jsonl", json.dumps(A_BASE) + "\n\n" + "broken\n")
    got = payloads(intake.read_json_lines(spark, lines, "NFULL"))
    assert got[0] == A_BASE and not got[1]


def test_whole_file_reconcile_is_idempotent(spark, tmp_path):
    header = list(A_BASE)
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    body = "\n".join(",".join(quote(r[h]) for h in header) for r in (A_BASE, B_BASE))
    path = write(tmp_path / "base.csv", "\n" + ",".join(quote(h) for h in header) + "\n" + body)
    store = LeadStore(spark, str(tmp_path / "state"))
    spec = [SourceSpec("NFULL", lambda: files.read_rows(spark, path, "NFULL"))]
    first, second = ingest_sources(store, spec)["totals"], ingest_sources(store, spec)["totals"]
    assert (first["received"], first["inserted"]) == (2, 2)
    assert (second["received"], second["inserted"], second["duplicates"]) == (2, 0, 2)


def test_csv_output(spark, tmp_path):
    values = {h: f"v{i}" for i, h in enumerate(DISPLAY_HEADERS)} | {"source": "BOTH"}
    values["Lead Statement"] = 'a\r\nb "q", c '
    values["Phone 2"] = ""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` string" for k in values))
    line = csv_lines(df).first().line
    assert line.startswith('"a b ""q"", c",v1,') and ",,v7," in line
    out = str(tmp_path / "out")
    write_csv(df.unionByName(df), out)
    text = [r.value for r in spark.read.text(out).collect()]
    assert text.count(line) == 2 and any(t.startswith("Lead Statement,Timestamp,") for t in text)
    write_csv(df.unionByName(df), out, limit=1)
    assert [r.value for r in spark.read.text(out).collect()].count(line) == 1


def test_stream_of_landed_files(spark, tmp_path):
    def land(name, source, rows):
        body = "\n".join(json.dumps({"source": source, "raw_payload": r}) for r in rows)
        write(tmp_path / "land" / name, body + "\n")

    (tmp_path / "land").mkdir()
    store = LeadStore(spark, str(tmp_path / "state"))

    def run():
        stream = item_stream(spark, str(tmp_path / "land"), max_files=1)
        start_ingest(stream, store, str(tmp_path / "ckpt"), name="t").awaitTermination()

    land("1.json", "NFULL", [A_BASE, B_BASE])
    run()
    land("2.json", "MFULL", [A_SECOND, C_SECOND])
    run()
    run()
    assert store.read("masters").count() == 3
    runs = {r.idempotency_key: (r.received, r.inserted) for r in store.runs().collect()}
    assert runs == {"t:0": (2, 2), "t:1": (2, 1)}
    # A batch delivered again is answered from the ledger.
    items = spark.createDataFrame([("MFULL", C_SECOND)], "source string, raw_payload map<string,string>")
    again = ingest(store, items, idempotency_key="t:1")
    assert again["replayed"] and store.read("masters").count() == 3
    assert store.read("sightings").select(F.countDistinct("run_id")).first()[0] == 2


def strict_cells(text):
    """A character reader: quotes toggle anywhere, doubled ones inside are one."""
    rows, row, field, inside, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if inside and c == '"' and text[i + 1 : i + 2] == '"':
            field, i = field + '"', i + 1
        elif c == '"':
            inside = not inside
        elif inside or c not in ",\n\r":
            field += c
        elif c == ",":
            row, field = [*row, field], ""
        elif c == "\n":
            rows, row, field = [*rows, [*row, field]], [], ""
        i += 1
    return rows + ([[*row, field]] if row or field else [])


def cells_of(spark, path, block_bytes):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    try:
        found = files.read_cells(spark, path)
        assert found.rdd.getNumPartitions() >= 1
        rows = found.orderBy("grid_id", "row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    return [r.cells for r in rows]


@pytest.mark.parametrize("block_bytes", [7, 64, 1 << 20])
def test_blocks_cut_quoted_records(spark, tmp_path, block_bytes):
    rng = random.Random(block_bytes)
    parts = ["a", "bb", ",", ",", "\n", "\r\n", '"', '""', '"x\ny"', '",\n,"', "é", '"\r\n"', "\n\n"]
    for n in range(4):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 120 if block_bytes < 1000 else 4000)))
        text += '"' * (text.count('"') % 2)  # the line break at the end of a file ends an open cell, too
        path = write(tmp_path / f"{n}.csv", text)
        assert cells_of(spark, path, block_bytes) == strict_cells(text), repr(text)


def test_one_cell_over_many_blocks(spark, tmp_path):
    text = 'k,v\n1,"' + "\n".join(f"line {i}, of one" for i in range(200)) + '"\n2,x\n3,"open\nto the end'
    path = write(tmp_path / "long.csv", text)
    got = cells_of(spark, path, 64)
    assert got == strict_cells(text) and len(got) == 4


def test_many_tasks_read_one_quoted_file(spark, tmp_path):
    lines = "\n".join(f'{i},"first\nsecond ""{i}""",x' for i in range(2000))
    path = write(tmp_path / "big.csv", "Key,Value,More\n" + lines + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_rows(spark, path, "S")
        assert files.read_cells(spark, path).rdd.getNumPartitions() > 8
        got = payloads(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = spark.read.csv(path, header=True, multiLine=True, escape='"').collect()
    assert sorted((r["Key"], r["Value"], r["More"]) for r in got) == sorted(map(tuple, whole))


def test_block_states_without_broadcast(spark, tmp_path, monkeypatch):
    from leadmerge.sources import blocks

    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    text = 'a,"b\nc",d\n' * 40
    assert cells_of(spark, write(tmp_path / "s.csv", text), 50) == strict_cells(text)


def bodies(rng, n):
    """Rows with all that may look like a separator, and the body that holds them."""
    text = lambda: "".join(rng.choice(['a', ',', '"', '\\', ']', '}', '[', '{', '"rows":[', ' ', 'é', '\n']) for _ in range(rng.randint(0, 12)))
    return [{text() or "k": text() for _ in range(rng.randint(0, 3))} for _ in range(n)]


@pytest.mark.parametrize("block_bytes", [11, 200, 1 << 20])
def test_bodies_are_cut_between_entries(spark, tmp_path, block_bytes):
    rng = random.Random(block_bytes)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    try:
        for k, (shape, n) in enumerate([(None, 9), (1, 40), (None, 0), (None, 1), ("\t", 5)]):
            rows = bodies(rng, n)
            wrapped = [{"rows": rows}, {"source": "x, [", "rows": rows, "n": 1}][k % 2]
            path = write(tmp_path / f"{k}.json", json.dumps(wrapped, indent=shape, ensure_ascii=bool(k % 2)) + "\n" * k)
            assert intake.body_entries(spark, path) is not None
            got = payloads(intake.read_source_batch(spark, path, "NFULL"))
            assert sorted(json.dumps(r, sort_keys=True) for r in got) == sorted(json.dumps(r, sort_keys=True) for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bodies_that_are_rejected_or_read_whole(spark, tmp_path):
    beside = write(tmp_path / "beside.json", '{"meta": {"a": 1, "b": [2, 3]}, "rows": [{"x": "1"}, {"x": "2"}]}')
    assert intake.body_entries(spark, beside) is None
    assert sorted(r["x"] for r in payloads(intake.read_source_batch(spark, beside, "NFULL"))) == ["1", "2"]
    assert payloads(intake.read_source_batch(spark, write(tmp_path / "empty.json", ""), "NFULL")) == []
    bad = [" ", "{}", "[]", '{"rows": 5}', '{"rows": {"a": 1}}', '{"rows": [{"a": "1"}', '"rows": [{"a": "1"}]', '{"rows": [{"a": "1"}]}, 5',
           '{"rows": [{"a": "1"},, {"a": "1"}]}', '{"rows": [5, {"a": "1"}]}', '{"rows": [{"a": }]}', '{"rows": [{"a": "1"}]]}', '{"rows": [{"a": "1}]}']
    for k, body in enumerate(bad):
        path = write(tmp_path / f"bad{k}.json", body)
        with pytest.raises(intake.BatchRejected):
            intake.read_source_batch(spark, path, "NFULL")
    good = write(tmp_path / "z.json", '{"rows": [{"source": "NFULL", "row": {"a": "1"}}]}')
    with pytest.raises(intake.BatchRejected):
        intake.read_mixed_batch(spark, [good, write(tmp_path / "y.json", '{"rows": [{"source": "NFULL", "row": {"a": "1"}}, {"source": "OTHER", "row": {}}]}')])


def test_pieces_are_counted_as_json_text_says():
    import random
    import re

    import pyarrow as pa

    from leadmerge.sources.blocks import _counts

    def depth(text):
        bare = re.sub(r'"[^"]*(?:"|$)', "", text)
        return sum(bare.count(c) for c in "[{") - sum(bare.count(c) for c in "]}")

    random.seed(5)
    for _ in range(300):
        values = ["".join(random.choice('ab"\\\\[]{}\u00e9\n') for _ in range(random.randrange(10))) for _ in range(random.randrange(1, 9))]
        skip = random.randrange(len(values))
        plain = [re.sub(r"(?s)\\.", "", v) for v in values[skip:]]
        want = [(v.count('"'), depth(v), depth(re.sub(r'^[^"]*(?:"|$)', "", v))) for v in plain]
        part = pa.array(values, pa.string()).slice(skip)
        assert list(zip(*(c.tolist() for c in _counts(part, True)))) == want
        assert _counts(part, False)[0].tolist() == [v.count('"') for v in values[skip:]]


def test_the_check_of_a_body_makes_no_text_of_its_entries(spark, tmp_path):
    path = tmp_path / "body"
    path.write_text('{"pushed": "now", "rows": [' + ", ".join(f'{{"a": "{i}"}}' for i in range(500)) + "]}")
    from leadmerge.sources.blocks import pieces, records

    every, outer, _ = records(pieces(spark, str(path), ","), ",", limit=2, nested=True)
    assert every.count() == 501 and outer.count() == 2


def test_short_rows_are_no_malformed_records_of_the_reader(spark, tmp_path):
    path = write(tmp_path / "short.csv", 'Key,Note\n1\n\n2,"a, b",c\n,,\n3,x"y\n')
    cells = files.read_cells(spark, path, multiline=False, max_columns=2)
    scan = cells._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.requiredSchema().size() == 3 < scan.relation().dataSchema().size()
    want = [["Key", "Note"], ["1"], ["2", "a, b", "c"], [], ["3", 'x"y']]
    assert [r.cells for r in cells.orderBy("row_idx").collect()] == want
