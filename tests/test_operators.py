"""Operators on small fixtures, with brute force where a rule is hard to see."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadmerge import contract
from leadmerge.operators import canonical as cn, incremental as inc, latest, listing, membership, merge, stats, validation as vl
from leadmerge.operators.payloads import merge_payloads
from leads import A_BASE, A_SECOND, B_BASE, C_SECOND, D_BASE, D_SECOND, firm, items, number, post, secondary_row_spaced


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def skewed(spark):
    """A third of the rows has one key, a fifth has none; copies included."""
    rng = random.Random(3)
    rows = [
        (i % 40, "hot" if i % 3 == 0 else None if i % 5 == 0 else f"k{rng.randint(0, 60)}") for i in range(900)
    ]
    keys = [("hot",), ("hot",), (None,), *[(f"k{i}",) for i in range(0, 60, 2)], ("other",)]
    return spark.createDataFrame(rows, "id int, k string"), spark.createDataFrame(keys, "k string"), rows, {k for (k,) in keys}


@pytest.mark.parametrize("skew_rows", ["1b", "256m"])
def test_membership_with_heavy_and_missing_keys(spark, skewed, skew_rows):
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", skew_rows)
    df, keys, rows, present = skewed
    marked = membership.mark_members(df, keys, "k", "m")
    assert rows_of(marked) == sorted([(i, k, k is not None and k in present) for i, k in rows], key=repr)
    kept = membership.drop_members(df, keys, "k")
    assert kept.count() == sum(k is None or k not in present for _, k in rows)
    lookup = df.where("k is not null").groupBy("k").agg(F.min("id").alias("least")).where("k <> 'k1'")
    least = {r.k: r.least for r in lookup.collect()}
    attached = membership.attach(df, lookup, "k")
    assert rows_of(attached) == sorted([(i, k, least.get(k)) for i, k in rows], key=repr)


def test_left_side_is_read_once(skewed):
    df, keys, *_ = skewed
    plan = membership.mark_members(df, keys, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2


def test_small_batch_probes_without_shuffling_the_store(spark, skewed):
    df, keys, _, present = skewed
    probed = membership.stored_keys(keys, df, "k", batch_rows=900)
    assert {r.k for r in probed.collect()} == {r.k for r in df.collect()} & (present - {None})
    text = probed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    unprobed = membership.stored_keys(keys, df, "k", batch_rows=10**9)
    assert unprobed.count() == keys.where("k is not null").count()


def leads(spark):
    base = cn.canonical(items(spark, "NFULL", [A_BASE, B_BASE, D_BASE]))
    second = cn.canonical(items(spark, "MFULL", [A_SECOND, C_SECOND, D_SECOND]))
    return base, second


def test_canonical_of_both_vocabularies(spark):
    base, second = leads(spark)
    assert tuple(base.columns) == contract.CANONICAL_COLUMNS == tuple(second.columns)
    a, s = base.where("business_name like 'Florist%'").first(), second.where("business_name like 'Florist%'").first()
    assert a.norm_permalink == s.norm_permalink == "www.facebook.com/firm1/posts/900001"
    assert a.post_id == s.post_id == "900001" and a.match_key == s.match_key == "+441001200001"
    assert a.source_record_id != s.source_record_id and a.dedup_key == a.source_record_id
    assert a.post_timestamp is None and s.post_timestamp == dt.datetime(2025, 3, 4, 8)
    assert s.location == "Leeds, West Yorkshire" and a.location == "Leeds"
    assert a.raw_payload == A_BASE

    row = secondary_row_spaced(firm(1), "0" + number(1), post(1, host="m.facebook.com"))
    r = cn.canonical(items(spark, "MFULL", [row])).first()
    assert (r.business_name, r.postcode, r.message, r.email) == (firm(1), "LS1 4AP", "Doors open!", None)
    assert r.norm_permalink == a.norm_permalink and r.scrape_timestamp == dt.datetime(2025, 3, 4, 8, 40)
    shown = cn.lead_rows(cn.canonical(items(spark, "MFULL", [row])), "raw_payload").first()
    assert shown["Address 2 (Village/Town/City)"] == "Leeds" and shown["Industry Type"] == "Food"


def test_alias_rules(spark):
    rows = [{"post code": "A", "Postal Code": "B"}, {"Post Code": " ", "Postal Code": "B"}, {"postal code ": "1", "Postal Code": "2"}]
    df = items(spark, "S", rows).select(cn.header_lookup(F.col("raw_payload")).alias("m"))
    got = [r.v for r in df.select(cn.alias_value(F.col("m"), "postcode").alias("v")).collect()]
    assert got[:2] == ["A", "B"] and got[2] in ("1", "2")
    assert df.select(cn.alias_value(F.col("m"), "no such field").alias("v")).first().v is None


def test_merge_rules(spark):
    base, second = leads(spark)
    c = merge.merge_counts(base, second).first()
    assert tuple(c) == (3, 3, 1, 2, 5)
    omitted = merge.omitted_secondary(base, second).collect()
    assert [r.business_name for r in omitted] == ["Florist No 1 Limited"]
    # No source is deduplicated against itself, and keyless rows stay.
    assert merge.asymmetric_merge(base.unionByName(base), second.limit(0)).count() == 6
    only = second.where("business_name like 'Garage%'")
    assert merge.asymmetric_merge(base.limit(0), only.unionByName(only)).count() == 2
    ghost = cn.canonical(items(spark, "MFULL", [{"Company Name": "Ghost"}]))
    assert merge.asymmetric_merge(base, ghost).count() == 4
    empty = merge.merge_counts(base.limit(0), second.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0, 0)


def test_split_of_batches_does_not_change_the_merge(spark):
    rng = random.Random(5)
    rows = [(s, f"{s}{i}", rng.choice([None, *"abcdefgh"])) for s in ("NFULL", "MFULL") for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, dedup_key string, match_key string")
    base, second = df.where("source = 'NFULL'"), df.where("source = 'MFULL'")
    keys = {k for s, _, k in rows if s == "NFULL" and k}
    expected = {d for s, d, k in rows if s == "NFULL" or k not in keys}
    assert {r.dedup_key for r in merge.asymmetric_merge(base, second).collect()} == expected
    # Base first, then the secondary in two parts: the incremental result is the same.
    first = inc.new_masters(base, df.limit(0))
    half = F.col("dedup_key") < "MFULL3"
    later = inc.new_masters(second.where(half), first).unionByName(inc.new_masters(second.where(~half), first))
    assert {r.dedup_key for r in first.unionByName(later).collect()} == expected
    for known in (1, 10**9):
        assert inc.new_masters(df, first, known).count() == len(expected) - first.count()


def test_payload_merge(spark):
    rows = [("m", 1, {"a": "", "b": "1"}), ("m", 2, {"a": "2", "b": "3", "c": None}), ("n", 1, {"a": " "})]
    df = spark.createDataFrame(rows, "dedup_key string, n int, raw_payload map<string,string>")
    merged = merge_payloads(df, order=("n",)).collect()
    assert [(r.dedup_key, r.merged_payload) for r in merged] == [("m", {"a": "2", "b": "1"})]


def test_latest_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, None)], "k string, t int, v string")
    assert rows_of(latest.latest_per_key(df, ["k"], ["t"])) == [("a", 2, "y"), ("b", 5, None)]
    assert rows_of(latest.first_per_key(df, ["k"], ["t"])) == [("a", 1, "x"), ("b", 5, None)]


def test_screen(spark):
    as_of = "2025-03-04 12:00:00"
    t = lambda s: dt.datetime.fromisoformat(s)
    rows = [
        (None, "m", None, "", None), ("u", " ", None, "", None), ("u", "m", t("2025-03-03 11:00:00"), "", None),
        ("u", "m", t("2025-03-05 00:00:00"), "", None), ("u", "A new SCHOOL menu", None, "Jersey", None),
        ("u", "m", t("2025-03-03 12:00:00"), None, None),
    ]
    df = spark.createDataFrame(rows, "norm_permalink string, message string, post_timestamp timestamp, location string, x string")
    got = vl.screen(df, as_of).select("reject_reason", "flags").collect()
    assert [r.reject_reason for r in got] == ["missing_or_invalid_proof", "missing_message", "stale_25h", None, None, None]
    assert got[4].flags == ["education", "banned_location"] and got[3].flags == []


def test_evidence_rules(spark):
    bodies = ['{"success":false}', '{"status":"not_found"}', "{}", '{"success":true,"rawData":{"author":"x"}}', "broken"]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "dedup_key string, evidence_json string")
    got = vl.evidence_records(df).orderBy("dedup_key").collect()
    assert [r.post_exists for r in got] == [False, False, True, True]
    assert got[3].author == "x" and got[2].previous_posts == []


def test_pages(spark):
    assert listing.page_bounds() == (1, 100)
    assert listing.page_bounds(0, 0) == (1, 100) and listing.page_bounds(-3, 9999) == (1, 500)
    df = spark.range(25).select(
        F.col("id").cast("string").alias("dedup_key"), F.timestamp_seconds(F.col("id") % 5).alias("created_at")
    )
    every = [r.dedup_key for r in df.orderBy(F.desc("created_at"), F.desc("dedup_key")).collect()]
    paged, last = [], None
    for n in (1, 2, 3):
        got = listing.page_of(df, n, 10).collect()
        if last is not None:
            assert listing.page_after(df, last.created_at, last.dedup_key, 10).collect() == got
        paged += [r.dedup_key for r in got]
        last = got[-1]
    assert paged == every
    text = listing.page_of(df, 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text


def test_cost_is_null_without_cost_or_approval(spark):
    df = spark.createDataFrame([(0.0, 3), (5.0, 0), (6.0, 3)], "c double, a int")
    got = [r.v for r in df.select(stats.cost_per_approved(F.col("c"), F.col("a")).alias("v")).collect()]
    assert got == [None, None, 2.0]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.range(5).select(
        F.col("id").cast("string").alias("dedup_key"), F.lit("INGESTED").alias("status"),
        F.timestamp_seconds("id").alias("created_at"), F.lit("x").alias("wide"),
    ).write.parquet(path)
    where = listing.master_filters("1970-01-01", "ingested")
    df = spark.read.parquet(path).where(where).select("dedup_key")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = text[text.index("PushedFilters"):]
    assert "EqualTo(status,INGESTED)" in pushed and "GreaterThanOrEqual(created_at" in pushed
    assert "wide" not in text and df.count() == 5
