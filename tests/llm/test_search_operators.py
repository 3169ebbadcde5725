"""Ranked search, nearest neighbours and spelling variants against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import hard_docs, hard_rows, no_docs
from leadmerge.llm import neighbours, search, variants
from leadmerge.llm.common import table

SF = "/root/testdata/sf0.01"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


def ranked(docs, items, top):
    """Every document scored for every item, straight from the definition."""
    split = [(i, terms(t)) for i, t in docs]
    split = [(i, w, Counter(w)) for i, w in split if w]
    total, length = len(split), sum(len(w) for _, w, _ in split)
    df = Counter(t for _, _, c in split for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, w, c in split:
            m = 50 + 50 * len(w) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def test_search_equals_scoring_every_document(spark, monkeypatch):
    monkeypatch.setattr(search, "WINDOW", 16)
    rng = random.Random(3)
    names = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(names) for _ in range(rng.randint(1, 60)))) for i in range(600)]
    docs += [(1000 + i, "w1 W2 w3") for i in range(40)] + [(1000, "w1 w2 w3"), (None, "w1 w2 w3 w7"), (None, None), (5000, "")]
    items = [(i, " ".join(rng.choice(names) for _ in range(rng.randint(1, 12)))) for i in range(25)]
    items += [(3, "w1 w9"), (None, "W2-w3"), (70, None), (71, ""), (72, "unheard of"), (73, "w1"), (73, "w1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for shard, size in ((300, 1 << 20), (10**6, 700)):
        got = search.lexical_search(frame, asked, top=7, shard_postings=shard, item_bytes=size)
        assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items, 7)


def test_search_bears_hard_rows(spark):
    rows = [(r[0], r[1]) for r in hard_rows()]
    asked = [(i, t) for i, t in rows if i is not None and t and len(t) < 500][:8] + [(99, "你好 Two words"), (98, "É́ nul\x00idiot")]
    items = spark.createDataFrame([(i, t, "x", 5) for i, t in asked], "item_id long, text string, score string, rank int")
    got = search.lexical_search(hard_docs(spark), items)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(rows, asked, 50)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert search.lexical_search(no_docs(spark), items).collect() == []
    assert search.lexical_search(hard_docs(spark), items.limit(0)).collect() == []


def nearest(rows, top, every):
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, v in sound:
        if i % every == 0:
            near = sorted((math.dist(v, w), j) for j, w in sound if j != i)[:top]
            out += [(i, r, j, d) for r, (d, j) in enumerate(near, 1)]
    return sorted(out)


def test_neighbours_of_hard_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(300)] + [(500, None), (600, []), (700, [0.0] * 4), (800, [1.0, None, 0.0, 2.0])]
    rows += [(900, [float("nan"), 1.0, 1.0, 1.0]), (1000, [float("inf"), 1.0, 1.0, 1.0]), (None, rows[0][1])]
    rows += [(1100, [1e200, 0.0, 1e199, 0.0]), (1101, [1e200, 2e199, 1e199, 0.0]), (1102, rows[0][1])]
    schema = "vec_id long, embedding array<double>, rank int, score string, query_id long, cell long"
    frame = spark.createDataFrame([(*r, 1, "s", 2, 3) for r in rows], schema).repartition(4)
    got = neighbours.nearest_neighbours(frame, every=10, cell_rows=1000, row_block=16, query_block=4, target=1.0)
    got = sorted(map(tuple, got.collect()))
    # As few as these are compared completely if all parts are visited.
    parts = len({q for q, *_ in got})
    assert parts == len({i for i, v in rows if i is not None and i % 10 == 0 and i not in (500, 600, 700, 800, 900, 1000)})
    assert [r for _, r, _, _ in got[:10]] == list(range(1, 11))
    every_score = {(i, j): s for i, _, j, s in nearest(rows, 10**6, 10)}
    for q, _, j, s in got:
        assert s == pytest.approx(every_score[q, j], rel=1e-9)
    copies = [(j, s) for q, _, j, s in got if q == 100]
    assert copies == [(j, 0.0) for j in (3, 101, 102, 103, 104, 105, 106, 107, 108, 109)]
    assert neighbours.nearest_neighbours(frame.limit(0)).collect() == []
    alone = neighbours.nearest_neighbours(frame.filter("vec_id = 0")).collect()
    assert alone == []
    few = neighbours.nearest_neighbours(frame.filter("vec_id in (0, 1, 2)")).collect()
    assert [r["rank"] for r in sorted(few)] == [1, 2]


def test_neighbours_without_parts_are_exact(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").limit(90).collect()]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=7, cell_rows=10**6)
    want = nearest(rows, 10, 7)
    got = sorted(map(tuple, got.collect()))
    assert [(q, r) for q, r, *_ in got] == [(q, r) for q, r, *_ in want]


def test_neighbour_recall(spark):
    """Clustered vectors in many parts: nine of ten neighbours are found, and most parts are not visited."""
    rng = np.random.default_rng(9)
    centers = rng.standard_normal((60, 16)) * 2
    x = centers[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 16)) * 0.5
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    seen = []
    learn = neighbours.learn
    try:
        neighbours.learn = lambda *a: seen.append((a[2], *learn(*a)[1:])) or learn(*a)
        got = neighbours.nearest_neighbours(frame, every=50, cell_rows=400).collect()
    finally:
        neighbours.learn = learn
    cells, visits = seen[0]
    assert cells >= 8 and visits <= cells // 2
    hits = 0
    for q in range(0, 6000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [j for j in np.lexsort((np.arange(6000), d)) if j != q][:10]
        hits += len(set(best) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * 10 * 120
    assert len(got) == 1200


def test_cut_is_balanced_and_follows_the_graph():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((64, 3)) * 0.2 + c for c in np.eye(3).tolist() + [[0, 0, 0]]]) * 1.0
    d = neighbours._squares(x, x)
    np.fill_diagonal(d, np.inf)
    graph = np.argsort(d, axis=1)[:, :8]
    part = neighbours.balanced_cut(graph, 4, 1)
    assert np.bincount(part).tolist() == [64] * 4
    inside = (part[graph] == part[:, None]).mean()
    assert inside > 0.9


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def spelled(docs):
    counts = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def grouped(docs):
    words = spelled(docs)
    out = {}
    for w, n in words.items():
        near = [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)]
        form = min(near, key=lambda v: (-words[v], v), default=None)
        form = form if form is not None and words[form] >= 10 * n else None
        out[w] = (n, len(near), form, words.get(form))
    roots = {}
    for w in out:
        r = w
        while out[r][2] is not None:
            r = out[r][2]
        roots[w] = r
    return sorted((w, n, k, f, fn, roots[w]) for w, (n, k, f, fn) in out.items())


def plain(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[0])


def varied(rng, stems, size):
    """Texts of stems with misspelled ones among them; some of one misspelling only."""
    letters = "abcdefgéß"
    out = []
    for _ in range(size):
        w = rng.choice(stems)
        if rng.random() < 0.2:
            k, c = rng.randrange(len(w)), rng.choice(letters)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
        out.append(w if rng.random() < 0.9 else w.upper())
    return " ".join(out)


@pytest.mark.parametrize("block", [5, 4096])
def test_variants_equal_brute_force(spark, block):
    rng = random.Random(block)
    stems = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(6, 10))) for _ in range(25)] + ["abcdefgh" * 30]
    docs = [(i, varied(rng, stems, rng.randint(0, 150))) for i in range(120)] + [(None, stems[0] + " " + stems[0]), (7, None), (8, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = plain(variants.variant_groups(frame, block=block))
    assert got == grouped(docs)
    assert any(r[3] for r in got) and any(r[2] > 5 for r in got)


def test_variants_bear_hard_rows(spark):
    rows = [(r[0], r[1]) for r in hard_rows()] * 2
    frame = hard_docs(spark).unionAll(hard_docs(spark)).withColumn("word", F.lit("clash")).withColumn("run", F.lit(1))
    assert plain(variants.variant_groups(frame)) == grouped(rows)
    assert variants.variant_groups(no_docs(spark)).collect() == []


def test_padded_and_large_blocks_agree(spark):
    """All words in one bucket by counts alone: anagrams and their neighbours."""
    rng = random.Random(4)
    base = set()
    while len(base) < 300:
        base.add("".join(rng.sample("aabbccddee", rng.choice((9, 10)))))
    words = spark.createDataFrame([(w, 2) for w in sorted(base)], "word string, n long")
    want = sorted(tuple(sorted(p)) for p in {frozenset((a, b)) for a in base for b in base if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b)})
    for block in (20, 1000):
        got = sorted(tuple(sorted(r)) for r in variants.near_words(words, block=block).collect())
        assert got == want
