"""Jaccard join, embedding duplicates, substring dedup, decontamination, mixing, components, pipeline."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cases import hard_docs, no_docs, prose, words
from leadmerge.llm import decontamination, embeddings, jaccard, mixing, substrings
from leadmerge.llm.common import Bits, components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return hard_docs(spark).cache()


def grouped(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    loose = [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(120)]
    edges = chain + star + loose + [(5, 5), (7, 6)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = grouped({x for e in edges for x in e}, edges)
    by = defaultdict(set)
    for r in got:
        by[r.root].add(r.node)
    linked = defaultdict(set)
    for x, r in want.items():
        linked[r].add(x)
    assert sorted(map(sorted, by.values())) == sorted(sorted(s) for s in linked.values() if len(s) > 1)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bits(spark):
    values = np.array([0, -1, 5, 2**62, -(2**63)], np.int64)
    bits = Bits.collect(spark.createDataFrame([(int(v),) for v in values], "x long"), "x")
    assert bits.has(values).all() and not bits.has(np.arange(100, 200)).any()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("frequent", [16, 3])
def test_jaccard_against_all_pairs(spark, docs, monkeypatch, frequent):
    """Also where most n-grams count as frequent, and groups chain."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = random.Random(8)
    rows = []
    for g in range(6):
        text = words(rng, rng.choice((6, 30, 80)))
        for _ in range(12):  # a walk: neighbours are alike, ends are not
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = "w" + str(rng.randrange(10**6))
    passage = " ".join(words(rng, 30))
    rows += [f"{' '.join(words(rng, 25))} {passage} {' '.join(words(rng, 25))}" for _ in range(20)]
    made = spark.createDataFrame([(100 + i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    both = made.unionAll(docs.select("doc_id", "text")).unionAll(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 5000, "text"))
    sets = [(r.doc_id, shingles(r.text)) for r in both.collect()]
    known = dict((i, s) for i, s in sets if i is not None)
    links = [
        (a, b) for a in known for b in known
        if a < b and known[a] and 100 * len(known[a] & known[b]) >= 75 * len(known[a] | known[b])
    ]
    want = grouped(known, links)
    got = jaccard.jaccard_components(both).collect()
    assert sorted(((r.doc_id, r.n_shingles) for r in got), key=repr) == sorted(((i, len(s)) for i, s in sets), key=repr)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(no_docs(spark)).count() == 0
    empty = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, None, 3)], "doc_id long, text string, sig int")
    got = jaccard.jaccard_components(empty).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted([(1, 0, 1), (2, 0, 2), (None, 0, None)], key=repr)


def test_jaccard_of_rows_without_id(spark):
    """Copies without an id belong to their own group only; unrelated groups stay apart."""
    rng = random.Random(21)
    one, two, three = (" ".join(words(rng, 40)) for _ in range(3))
    rows = [(7, one), (None, one), (9, one + " more"), (10, two), (None, two + " x"), (None, two), (None, three), (None, three + " y"), (3, "short")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.component_id) for r in got], key=repr) == sorted(
        [(7, 7), (None, 7), (9, 7), (10, 10), (None, 10), (None, 10), (None, None), (None, None), (3, 3)], key=repr
    )


def test_frequent_grams_are_counted_over_all_sets(spark, monkeypatch):
    """A passage that stands once in each of many batches is frequent, and makes few pairs."""
    monkeypatch.setattr(jaccard, "COUNT_ROWS", 1)  # parts are cut further
    rng = random.Random(22)
    passage = " ".join(words(rng, 40))
    rows = [(i, f"{' '.join(words(rng, 50))} {passage} {' '.join(words(rng, 50))}") for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        frame = spark.createDataFrame(rows, "id long, text string").repartition(6)
        made = jaccard.set_table(frame, 5).cache()
        total = made.agg(F.sum("n")).first()[0]
        often = {r.gram: r.sets for r in jaccard.frequent_grams(made.filter("part is not null").select("part", "grams"), total * 4096).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(often) == 36 and set(often.values()) == {60}
    got = jaccard.jaccard_components(frame.withColumnRenamed("id", "doc_id")).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_embeddings_without_id_and_beyond_squares(spark):
    v = [3.0, 1.0, 2.0, 0.5]
    big = [x * 1e200 for x in v]
    rows = [(4, v), (None, v), (None, [-1.0, 5.0, 0.0, 0.0]), (None, [-1.0, 5.0, 0.0, 0.0]), (6, big), (8, None), (None, None)]
    rows += [(20, [1e200, 0.0, 0.0, 0.0]), (21, [0.9e200, math.sqrt(1 - 0.81) * 1e200 * (1 - 1e-9), 0.0, 0.0])]
    got = embeddings.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.9999).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in got], key=repr) == sorted(
        [(4, 2, 4, True), (None, 2, 4, False), (6, 2, 4, False), (None, 1, None, True), (None, 1, None, True), (8, 0, 8, True), (None, 0, None, True),
         (20, 1, 20, True), (21, 1, 20, False)], key=repr
    )


@pytest.mark.parametrize("block", [4096, 40])
def test_embedding_links_and_recall(spark, block):
    """Against all pairs; a small block size splits every bucket and changes nothing."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 32))
    x = [c + rng.standard_normal(32) * s for c in centres for s in (0.0, 0.0, 0.2, 0.3, 0.33, 0.36)] + list(rng.standard_normal((300, 32)))
    x = np.array(x) * rng.uniform(0.1, 9, (len(x), 1))
    x[1::6][:60] = x[0::6][:60]  # exact copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] * 32, [None] + [1.0] * 31, [1.0] * 7]
    rows += [(5000 + i, v, None) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.embedding_duplicates(df, block=block).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum()
    assert all(got[i].component_id == min(got[j].component_id for j in np.flatnonzero(near[i]).tolist() + [i]) for i in range(0, 360, 6))
    for i, _ in enumerate(odd):
        r = got[5000 + i]
        assert (r.n_links, r.component_id, r.kept) == (0, 5000 + i, True)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embeddings.embedding_duplicates(df.limit(0)).count() == 0
    again = {r.vec_id: r.n_links for r in embeddings.embedding_duplicates(df.repartition(5)).collect()}
    assert again == {i: r.n_links for i, r in got.items()}


def repeats_by_hand(texts, min_sentences=2, min_words=20):
    places, pieces = defaultdict(set), {i: substrings.sentences(t or "") for i, t in texts.items()}
    for i, part in pieces.items():
        size, plain = [len(p.split()) for p in part], [" ".join(p.lower().split()) for p in part]
        for a in range(len(part)):
            for run in (range(a + min_sentences, len(part) + 1), range(a - min_sentences + 1, -1, -1)):
                for b in run:
                    lo, hi = (a, b) if b > a else (b, a + 1)
                    if sum(size[lo:hi]) >= min_words:
                        places["\0".join(plain[lo:hi])].add((i, lo, hi))
                        break
    gone = defaultdict(set)
    for found in places.values():
        first = min((i, lo) for i, lo, _ in found)
        for i, lo, hi in found:
            if (i, lo) > first:
                gone[i].update(range(lo, hi))
    return {i: ("".join(p for j, p in enumerate(part) if j not in gone[i]), len(part), len(gone[i])) for i, part in pieces.items()}


def test_substrings_against_all_spans(spark, docs, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_CHARS", 20_000)
    rng = random.Random(6)
    passage = prose(rng, 64)
    rows = [(100 + i, f"{prose(rng, rng.randint(0, 40))} {passage} {prose(rng, rng.randint(0, 40))}") for i in range(30)]
    rows += [(200, passage + " " + passage), (201, prose(rng, 16)), (202, prose(rng, 64) + "\n" + passage.upper())]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("x"))
    both = made.unionByName(docs.where("doc_id is not null").select("doc_id", "text", "n_removed")).repartition(5)
    want = repeats_by_hand({r.doc_id: r.text for r in both.collect()})
    got = substrings.substring_dedup(both).collect()
    assert len(got) == both.count() and substrings.substring_dedup(both).columns == ["doc_id", "text", "n_sentences", "n_removed"]
    for r in got:
        text, n, gone = want[r.doc_id]
        assert (r.text or "", r.n_sentences, r.n_removed) == (text, n, gone)
    assert sum(passage[:50].lower() in r.text.lower() for r in got if r.text) == 1


def test_passages_without_marks_are_found(spark):
    """Sixty words in the middle of running text, under other words each time."""
    rng = random.Random(12)
    passage = " ".join(words(rng, 60))
    rows = [(i, f"{' '.join(words(rng, 33 + i))} {passage} {' '.join(words(rng, 45))}") for i in range(10)]
    got = {r.doc_id: r.text for r in substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 10):
        left = [w for w in passage.split() if f" {w} " in got[i]]
        assert len(left) < 30 and len(got[i].split()) >= 33 + i + 45


def test_substrings_keep_odd_rows(spark, docs):
    got = substrings.substring_dedup(docs)
    assert set(docs.columns) - {"n_removed"} < set(got.columns) and got.count() == docs.count()
    assert {r.text for r in got.where("doc_id in (16, 17)").collect()} == {None, ""}
    assert substrings.substring_dedup(no_docs(spark)).count() == 0


def test_decontamination_finds_edited_items_only(spark, docs):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, rng.randint(15, 60)))) for i in range(20)] + [(98, None), (99, ""), (None, "a b")]
    rows, want = [], {}
    for k in range(400):
        i = k % 20
        text, share = items[i][1].split(), (0, 0.05, 0.1, 0.2, 0.25)[k // 20 % 5]
        for _ in range(int(len(text) * share)):
            at, way = rng.randrange(len(text)), rng.random()
            if way < 0.5:
                text[at] = "zz" + str(k)
            elif way < 0.75:
                del text[at]
            else:
                text.insert(at, "zz" + str(k))
        around = words(rng, rng.randint(0, 60))
        rows.append((1000 + k, " ".join(around) + " " + ", ".join(text).upper() + ". " + " ".join(around)))
        want[1000 + k] = i
    rows += [(2000 + k, " ".join(words(rng, 200))) for k in range(100)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(made.unionAll(docs.select("doc_id", "text")), bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    hit = sum((d, i) in found for d, i in want.items())
    assert hit / len(want) >= 0.95 and all(d in want for d, _ in found)
    for r in got:  # verified exactly
        item = items[r.item_id][1].split()
        text = re.sub(r"[^a-z0-9]+", " ", dict(rows)[r.doc_id].lower()).split()
        assert r.distance == decontamination.edit_in(item, text)[0] <= len(item) // 4
    assert decontamination.contaminated(no_docs(spark), bench).count() == 0
    assert decontamination.contaminated(made, bench.limit(0)).count() == 0


def test_decontamination_finds_items_of_every_length(spark, monkeypatch):
    """Every item of three words and more, exact or edited as far as allowed, at any place of a text, in several passes."""
    monkeypatch.setattr(decontamination, "PASS_BYTES", 4000)
    monkeypatch.setattr(decontamination, "BLOCK", 500)
    rng = random.Random(12)
    items = [(n * 10 + k, " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))) for n in (3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 20, 21, 30, 60) for k in range(3)]
    items += [(5, "two words"), (6, "two words"), (900, items[30][1])]
    rows, want = [], set()
    for i, text in items[:-3]:
        for edits in {0, (n := len(text.split())) // 4}:
            for way in "sid":
                run = text.split()
                # Edits at even distances leave the shortest pieces.
                for place in sorted((int((e + 0.5) * n / edits) for e in range(edits)), reverse=True):
                    run[place : place + (way != "i")] = [] if way == "d" else ["zz"]
                want.add((len(rows), i))
                rows.append((len(rows), " ".join([*["around"] * rng.randint(0, 30), *run, *["around"] * rng.randint(0, 30)])))
    whole = len(rows)
    rows += [(whole, "Two words"), (whole + 1, "and two words"), (whole + 2, "two"), (whole + 3, items[0][1].split()[0])]
    got = decontamination.contaminated(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    assert want | {(whole, 5), (whole, 6)} <= set(found) and len(found) == len(got)
    # All pairs by hand: nothing is missing, no distance is other than the least.
    for d, text in rows[:whole]:
        for i, item in items[:-3]:
            least = decontamination.edit_in(item.split(), text.split())[0]
            assert ((d, i) in found) == (least <= len(item.split()) // 4)
            assert (d, i) not in found or found[d, i].distance == least
    assert not {whole + 1, whole + 2, whole + 3} & {r.doc_id for r in got}


def test_edit_distance_against_plain_table():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 7))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        assert decontamination.edit_in(a, b)[0] == min(row)


def targets_by_hand(sizes, share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(cap * sizes[s] for s in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark, docs):
    extra = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    both = docs.select("doc_id", "text", "source").unionAll(extra).repartition(3)
    got = mixing.mix_sources(both).collect()
    source = defaultdict(int)
    for r in both.collect():
        source[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = targets_by_hand(source)
    assert len(got) == both.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in want.values()}
    by = defaultdict(int)
    for r in got:
        by[round(r.target, 6), r.source_size] += r.taken
    assert all(abs(taken - target) <= 2 for (target, _), taken in by.items())
    rows = lambda x: sorted((tuple(r) for r in x), key=repr)
    assert rows(got) == rows(mixing.mix_sources(both.repartition(7)).collect())
    assert mixing.mix_sources(no_docs(spark)).count() == 0


def test_mixing_is_unbiased_and_spreads_hot_sources(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"),
    )
    got = mixing.mix_sources(df).withColumn("copies", F.col("taken") / F.col("size"))
    fractional = got.where("copies <> floor(copies)").count()
    assert fractional <= 8  # at most one per source
    rate = got.where("source_size > 5000").groupBy("size").agg(F.avg("copies").alias("c"), F.first(F.col("target") / F.col("source_size")).alias("t")).collect()
    assert all(abs(r.c - r.t) < 0.12 for r in rate)


def test_pipeline_stages(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), None
    before = docs
    for name, step in corpus_pipeline.STAGES:
        after = corpus_pipeline.stage(step(spark, before, SF), name)
        if name != "mixing":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
            ids = {r.doc_id for r in after.select("doc_id").collect()}
            assert ids <= (kept if kept is not None else ids) and len(ids) > 100
            kept = ids
        if name == "ngram_jaccard_join":
            sets = {r.doc_id: shingles(r.text) for r in after.collect()}
            pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            assert not pairs
        if name == "substring_dedup":
            want = repeats_by_hand({r.doc_id: r.text for r in before.collect()})
            assert {r.doc_id: r.text or "" for r in after.collect()} == {i: t for i, (t, n, gone) in want.items() if not gone or gone < n}
        before = after
    assert {r.doc_id for r in before.collect()} == kept
    assert before.columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_mixing_of_many_equal_rows(spark):
    """Equal rows are counted, not gathered; the words of their source are kept."""
    import time

    text = "w " * 9
    docs = spark.range(30_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("a").alias("source"))
    others = spark.range(50).select((F.col("id") + 10).alias("doc_id"), F.concat(F.lit("x "), F.repeat(F.lit("y "), (F.col("id") % 7).cast("int"))).alias("text"), F.lit("b").alias("source"))
    start = time.time()
    got = mixing.mix_sources(docs.unionAll(others)).groupBy("source_size", "doc_id", "size", "target", "taken").count().collect()
    assert time.time() - start < 60
    equal = {r.taken: r["count"] for r in got if r.doc_id == 5}
    target = next(r.target for r in got if r.doc_id == 5)
    assert sum(equal.values()) == 30_000 and len(equal) <= 3
    assert abs(sum(t * n for t, n in equal.items()) - target) <= 9
    again = mixing.mix_sources(docs.unionAll(others).repartition(7)).groupBy("source_size", "doc_id", "size", "target", "taken").count().collect()
    assert sorted(got) == sorted(again)


def test_pipeline_without_ids(spark):
    """Rows without an id are judged like others; one copy of a group stays."""
    rng = random.Random(33)
    one, two, item = (" ".join(words(rng, 40)) for _ in range(3))
    rows = [(7, one), (None, one), (9, one + " more"), (None, two), (None, two + " x"), (None, None), (4, ""), (11, f"x {item} y"), (None, f"{item} z")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.one_per_group(spark, docs, SF)
    got = sorted([(r.doc_id, r.text) for r in left.collect()], key=repr)
    assert [g for g in got if g[0] is not None] == [(11, f"x {item} y"), (4, ""), (7, one)]
    assert len([g for g in got if g[0] is None and g[1] and g[1].startswith(two)]) == 1 and (None, None) in got
    assert left.columns == docs.columns
    assert corpus_pipeline.one_per_group(spark, docs.limit(0), SF).count() == 0
