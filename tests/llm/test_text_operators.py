"""Token counts, licence scans, language model, toxicity and page extraction."""

import html as entities
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cases import hard_docs, hard_rows, no_docs
from leadmerge.llm import hmm, html, licenses, tokens, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"

ROOT = __import__("pathlib").Path(__file__).resolve().parents[2]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return hard_docs(spark).cache()


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    sample = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    both = docs.select("doc_id", "text").unionAll(sample)
    odd = [(900 + i, t) for i, t in enumerate(["  a  b", "a \n b", " lead", "trail ", "it's we'll 12 3.5", "tab\tx", "\n\n", "don't\nstop"])]
    both = both.unionAll(spark.createDataFrame(odd, "doc_id long, text string"))
    expected = sorted(
        ((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False))) for r in both.collect()), key=repr
    )
    for table_rows in (65_536, 10):
        got = tokens.token_counts(both, PATH, table_rows=table_rows).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == expected
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.token_counts(no_docs(spark), PATH).count() == 0


def test_plain_characters_split_as_in_the_library():
    """The pattern's classes and the library's agree on every character of the plain range."""
    import regex
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(PATH).pre_tokenizer.pre_tokenize_str
    for code in [10, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x180)]:
        text = f"a{chr(code)}1 {chr(code)}b"
        assert len(regex.findall(tokens.PRE_TOKEN, text)) == len(split(text)), hex(code)


BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base_by_hand(text):
    found = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)) if w]
    hits = [(i, label) for p, label in BASE.items() for i in range(len(found)) if found[i : i + len(p.split())] == p.split()]
    return len(found), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_scan(spark, docs):
    texts = [
        "Licensed under the Apache License, Version 2.0. MIT License; mit-license cc_by CC BY-SA", "xmit license",
        "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", "gnu general public\nlicense gnu general public license",
        "// SPDX-License-Identifier: (MIT AND\nnext", "SPDX-License-Identifier: BSD-3-Clause */ int x;", "Mozilla Public License 2.0",
    ]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionAll(extra).unionAll(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = licenses.license_scan(both).collect()
    want = sorted(((r.doc_id, *base_by_hand(r.text)) for r in both.collect()), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == want
    by = {r.doc_id: r for r in licenses.license_scan(extra).collect()}
    assert by[102].labels == "apache,gpl,mit" and by[102].score == 1.0 and by[102].permissive is False
    assert by[104].labels == "" and by[104].score == 0.5
    assert by[105].labels == "bsd" and by[105].permissive and by[106].labels == "mpl" and by[106].base_labels == ""
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.license_scan(no_docs(spark)).count() == 0


@pytest.mark.parametrize(
    "text, postfix",
    [("mit", ["mit"]), ("mit or apache-2.0 and gpl-2.0", ["mit", "apache-2.0", "gpl-2.0", "and", "or"]), ("(mit or isc) and x", ["mit", "isc", "or", "x", "and"]),
     ("gpl-2.0 with classpath or mit", ["gpl-2.0", "classpath", "with", "mit", "or"]), ("", None), ("and mit", None), ("(mit", None), ("mit)", None), ("mit or", None), ("()", None)],
)
def test_shunting_yard(text, postfix):
    assert licenses.to_postfix(text) == postfix


def test_hmm_base_scores_and_forward(spark, docs):
    both = docs.select("doc_id", "text").unionAll(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    got = hmm.hmm_scores(both, rounds=2).collect()
    rows = [(r.doc_id, WORD.findall(lower(r.text)) + ["<end> "]) for r in both.collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, ws in rows if not out(i) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((i is None, i or 0, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws), 3)) for i, ws in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 3)) for r in got) == want
    assert {r.train_tokens for r in got} == {total} and all(r.held_out == out(r.doc_id) for r in got)
    # Better than single words on texts that were not learnt from.
    kept = [r for r in got if r.held_out]
    assert sum(r.score for r in kept) > sum(r.base_score for r in kept)
    assert hmm.hmm_scores(no_docs(spark)).count() == 0


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(0)
    k = hmm.STATES
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(7), k).T)
    sequences = [rng.integers(0, 7, n) for n in (1, 5, 3, 700, 1, 260)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    got = model.log10(offsets, np.concatenate(sequences).astype(np.int32))
    for sequence, log in zip(sequences, got):
        state, want = model.start, 0.0
        for i, s in enumerate(sequence):
            state = (state if i == 0 else state @ model.move) * model.emit[s]
            want += math.log10(state.sum())
            state = state / state.sum()
        assert abs(want - log) < 1e-6


def test_baum_welch_counts_against_enumeration():
    """Expected counts equal those of a plain forward-backward, and likelihood does not fall."""
    rng = np.random.default_rng(1)
    k = hmm.STATES
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(5), k).T)
    sequences = [rng.integers(0, 5, n) for n in (4, 1, 6)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    flat = np.concatenate(sequences).astype(np.int32)
    counts = hmm.Counts(model)
    counts.add(offsets, flat)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((5, k))
    for s in sequences:
        a = [model.start * model.emit[s[0]]]
        for x in s[1:]:
            a.append(a[-1] @ model.move * model.emit[x])
        b = [np.ones(k)]
        for x in s[:0:-1]:
            b.insert(0, model.move @ (model.emit[x] * b[0]))
        z = a[-1].sum()
        start += a[0] * b[0] / z
        for t, x in enumerate(s):
            emit[x] += a[t] * b[t] / z
        for t in range(len(s) - 1):
            move += a[t][:, None] * model.move * (model.emit[s[t + 1]] * b[t + 1]) / z
    assert np.allclose(counts.start, start) and np.allclose(counts.move, move) and np.allclose(counts.emit, emit)
    better = hmm.Model(counts.start / counts.start.sum(), counts.move / counts.move.sum(1, keepdims=True), counts.emit / counts.emit.sum(0))
    assert better.log10(offsets, flat).sum() >= model.log10(offsets, flat).sum()


def test_hmm_cuts_texts_into_words_twice(spark, docs, tmp_path, monkeypatch):
    """Once to count the words, once for all rounds and scores, however many rounds there are."""
    plain, seen = hmm.word_lists, str(tmp_path / "seen")

    def counted(texts):
        with open(seen, "a") as f:
            f.write(f"{len(texts)}\n")
        return plain(texts)

    monkeypatch.setattr(hmm, "word_lists", counted)
    got = hmm.hmm_scores(docs, rounds=3).collect()
    with open(seen) as f:
        assert sum(map(int, f)) == len(got) + sum(not r.held_out for r in got)


def test_hmm_sequences_and_endings():
    rng = np.random.default_rng(2)
    lengths = [1, 7, 1, 0, 900]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    sequence = rng.integers(0, hmm.OWN_WORDS + hmm.ENDINGS + 1, offsets[-1]).astype(hmm.CODE)
    column = hmm.packed(offsets, sequence)
    got = hmm.unpacked(column)
    assert (got[0] == offsets).all() and (got[1] == sequence).all()
    got = hmm.unpacked(column.slice(1, 3))
    assert got[0].tolist() == [0, 7, 8, 8] and (got[1] == sequence[1:9]).all()
    assert [len(x) for x in hmm.unpacked(column.slice(0, 0))] == [1, 0]
    words = ["a", "of", "the", "endings", "größe", "größe", "x你好", "😀"]
    assert hmm.endings(pa.array(words)).tolist() == [zlib.crc32(w[-3:].encode()) % hmm.ENDINGS for w in words]
    assert hmm.endings(pa.array([], pa.string())).tolist() == []


def test_recursions_with_tiny_emissions():
    """Scaling every few steps only: nothing underflows, whatever step a sequence ends at."""
    rng = np.random.default_rng(3)
    k = hmm.STATES
    emit = rng.dirichlet(np.ones(6), k).T * 1e-40
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), emit)
    sequences = [rng.integers(0, 6, n) for n in (1, 2, 3, 4, 5, 255, 256, 257, 1001)]
    offsets, flat = np.concatenate([[0], np.cumsum([len(s) for s in sequences])]), np.concatenate(sequences).astype(hmm.CODE)
    for sequence, log in zip(sequences, model.log10(offsets, flat)):
        state, want = model.start, 0.0
        for i, s in enumerate(sequence):
            state = (state if i == 0 else state @ model.move) * model.emit[s]
            want += math.log10(state.sum())
            state = state / state.sum()
        assert math.isclose(want, log, rel_tol=1e-12)
    counts = hmm.Counts(model)
    counts.add(offsets, flat)
    pieces = sum(-(-len(s) // hmm.PIECE) for s in sequences)
    assert np.allclose(counts.emit.sum(axis=1), np.bincount(flat, minlength=6))
    assert math.isclose(counts.start.sum(), pieces) and math.isclose(counts.move.sum(), len(flat) - pieces)


def test_toxicity_on_held_out_rows(spark):
    import random

    rng = random.Random(4)
    bad, mild = ["vilefool", "scumlord", "gitface", "oafish"], [f"w{rng.randint(0, 10**6)}x" for _ in range(400)]
    mild = ["".join(chr(97 + rng.randint(0, 25)) for _ in range(rng.randint(3, 9))) for _ in range(800)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(mild) for _ in range(rng.randint(5, 80))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    kept = [r for r in got if r.held_out]
    right = sum(r.predicted == (r.doc_id % 3 == 0) for r in kept)
    assert len(got) == 900 and right / len(kept) > 0.9
    # Labels of held-out rows do not matter.
    flipped = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert again == {r.doc_id: r.score for r in got}


def test_toxicity_adds_up_short_words(spark):
    """Short toxic words count as long ones do, in long texts too; parts of toxic words in ordinary ones do not."""
    import random

    rng = random.Random(6)
    made = lambda a, b: "".join(chr(97 + rng.randint(0, 25)) for _ in range(rng.randint(a, b)))
    mild, long = [made(3, 9) for _ in range(600)], ["worthlesslout", "disgustingly", "pathetically"]
    rows = []
    for i in range(1200):
        text = [rng.choice(mild) for _ in range(rng.choice([20, 60, 1500]) if i % 12 < 4 else 40)]
        if i % 4 == 0:
            # Of one word each: half of the toxic texts have short ones only.
            some = ["scum", "twit", "dolt"] if i % 8 else long
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(some))
        elif i % 4 == 1:
            text.append(made(2, 3) + rng.choice(long)[:9] + made(2, 3))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    kept = [r for r in toxicity.toxicity(docs, marks).collect() if r.held_out]
    short, others = [r.predicted for r in kept if r.doc_id % 8 == 4], [r.predicted for r in kept if r.doc_id % 4]
    assert sum(short) / len(short) > 0.95 and sum(others) / len(others) < 0.02
    # Two windows are more than one, and a short known word is as much as a long one.
    distance = toxicity.Distance(*toxicity.train_dictionaries([t for i, t in rows if i % 4 == 0], [t for i, t in rows if i % 4]))
    one, other, two, none = distance.gains(["scum", "worthlesslout", "scum and twit", "and so on"])
    assert one == other and two > one > none == 0


def test_toxicity_edges(spark, docs):
    marks = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (0, 0), (777, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = toxicity.toxicity(docs, marks.limit(0)).collect()
    assert all(r.predicted == 0 for r in none)
    assert toxicity.toxicity(no_docs(spark), marks).count() == 0


PAGES = [
    (1, """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><nav><ul><li><a href="/">Home</a></li></ul></nav></header>
<div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div><main><article><h1>Title &amp; more</h1>
<p>First   long paragraph<br>of the story, with words.</p><div class="ad">Buy now, it is cheap!</div><p>Second &lt;b&gt; <b>bold</b>er.</p>
<aside>See also this other story.</aside><ul><li>point one</li><li>point two</li></ul><form><label>Mail</label><button>Go</button></form></article>
<section id="comments"><h2>Comments</h2><p>Great post, I love it very much, these are really good words.</p></section></main><footer>c 2020</footer><script>var a="</p>";</script></body></html>""",
     "Title & more\n\nFirst long paragraph of the story, with words.\n\nSecond <b> bolder.\n\npoint one\n\npoint two"),
    (2, '<div id="menu"><a href=1>A</a> <a href=2>B</a></div><div class="content"><h1>Head</h1><p>Text one is here, and it goes on for a while.<p>Short.</div><div class="sidebar"><p>Other stuff in the side bar.</p></div>',
     "Head\n\nText one is here, and it goes on for a while.\n\nShort."),
    (3, None, ""), (4, "", ""), (5, "<nav><a href=x>only a menu</a></nav>", ""), (6, "<article><p>open &#233; end", "open é end"),
    (7, "<<<>>> <p", None), (None, "<article><p>no id</p></article>", "no id"),
]


def test_pages(spark):
    rows = [(i, None if i == 6 else "u", page, "extra") for i, page, _ in PAGES]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract_pages(df).collect()}
    for i, _, want in PAGES:
        assert got[i].n_chars == len(got[i].text) and (want is None or got[i].text == want)
    assert html.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "before",
    ["<script>for(var i=0;i<n;i++){f(i)}</script>", "<script>if(a<b||c>d)x='<article>'</script >", "<script><!-- f() </script>", "<SCRIPT>s = '<b'</Script>",
     "<head><title>a <b</title><script>i<n</script></head><body>", "<style>a::before{content:'<b'}</style>", "<textarea><!-- a <b </textarea>", "<svg><style>a<b</style></svg>",
     "<img title=it's>", "<img alt=5\" width=3>", "<a' href='x'></a>", "<img alt='a > b' title = \"c > 'd\">", "<head><title>no end<body>"],
)
def test_markup_inside_scripts_and_stray_quotes(before):
    """Neither hides what comes after it, whether or not more scripts and quotes follow."""
    page = f"{before}<article><p>All of the text's words are here.</p></article><p>It's over</p><script>'</script>"
    assert html.main_blocks(page) == ["All of the text's words are here."]


def test_given_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for p in pages:
        inner = re.search(r"<article>(.*)</article>", p.html, re.S)[1].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        assert html.main_blocks(p.html) == [x for x in parts if x]


LONG = "This is a long sentence of the article with more than enough words in it to be told from anything else on the page."


def nested(rng, n):
    """Blocks of nested parents in page order: the last block of the same parent, or -1."""
    stack, last, siblings, number = [0], {}, [], 0
    for i in range(n):
        for _ in range(rng.randint(0, 2)):
            if rng.random() < 0.5:
                number += 1
                stack.append(number)
            elif len(stack) > 1:
                stack.pop()
        siblings.append(last.get(stack[-1], -1))
        last[stack[-1]] = i
    return siblings


def test_min_cut_is_cheapest():
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(0, 9)
        costs, siblings, weight = [rng.randint(-9, 9) for _ in range(n)], nested(rng, n), rng.randint(0, 6)
        adjacent = [rng.randint(0, 6) for _ in range(n)]

        def price(keep):
            own = sum(max(0, -c) if k else max(0, c) for c, k in zip(costs, keep))  # noqa: B023
            beside = sum(adjacent[i] for i in range(1, n) if keep[i] != keep[i - 1])  # noqa: B023
            return own + beside + sum(weight for i, j in enumerate(siblings) if j >= 0 and keep[i] != keep[j])  # noqa: B023

        every = [(price(k), sum(k), k) for k in itertools.product((False, True), repeat=n)]
        assert tuple(html.min_cut(costs, siblings, adjacent, weight)) == min(every)[2]


def test_long_page_is_cut_in_linear_time():
    import time

    page = "<body>" + "".join(f"<p>{LONG} It is number {i}.</p><div class='share-bar'>x</div>" for i in range(25_000))
    start = time.process_time()
    kept = html.main_blocks(page)
    assert len(kept) == 25_000 and time.process_time() - start < 5


def test_cut_is_right_where_the_cost_alone_is_not():
    """Short blocks go with their neighbours: an entry between paragraphs stays, a sentence among links goes."""
    page = f"<body><div><p>{LONG}</p><ul><li>Salt</li></ul><p>{LONG}</p></div><ul>{''.join(f'<li><a href=x>Section number {i}</a></li>' for i in range(9))}</ul></body>"
    blocks = html.blocks_of(page)
    by_cost = [b.text for b in blocks if b.cost > 0]
    assert html.main_blocks(page) == [LONG, "Salt", LONG] and by_cost == [LONG, LONG]
    menu = "".join(f"<li><a href=x>Page {i} of our site</a></li>" for i in range(4))
    page = f"<body><div><p>{LONG}</p><p>{LONG}</p></div><ul>{menu}<li>All pages of our site are listed here in the order of their names, with some more words that make this longer.</li>{menu}</ul></body>"
    by_cost = [b.text for b in html.blocks_of(page) if b.cost > 0]
    assert html.main_blocks(page) == [LONG, LONG] and len(by_cost) == 3


def test_names_that_only_sound_like_boilerplate():
    for page in (
        f'<article><div class="article-header"><h1>A title</h1></div><p>{LONG}</p></article>',
        f'<article class="post comments-open"><header class="entry-header"><h1>A title</h1></header><p>{LONG}</p></article>',
        f'<body><div id="social-history"><h1>A title</h1><p>{LONG}</p></div></body>',
        f'<article><h1>A title</h1><div class="notice-period"><p>{LONG}</p></div></article>',
    ):
        assert html.main_blocks(page) == ["A title", LONG], page
    for name in ("cookie-bar", "adSlot", "newsletter_box", "comment-list", "share-buttons", "sidebar", "comments", "post-comments-list comments", "site-header"):
        page = f'<body><article><p>{LONG}</p></article><div class="{name}"><p>{LONG}</p></div></body>'
        assert html.main_blocks(page) == [LONG], name


def test_many_hits_are_counted_in_linear_time():
    import time

    text = "cc by " * 150_000
    start = time.process_time()
    row = licenses.scan(text, licenses.automaton())
    assert row[:4] == (300_000, 150_000, 0, 299_998) and time.process_time() - start < 5


def test_models_travel_without_the_package(tmp_path):
    """A worker that cannot import this package still has what is sent to it."""
    import subprocess
    import sys

    made = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark import cloudpickle
from leadmerge.llm import decontamination, hmm
import pyarrow as pa
items = decontamination.Pieces(pa.array([1]), pa.array(["one two three four five six"]), 0.25)
open({str(tmp_path / "x")!r}, "wb").write(cloudpickle.dumps(items))
"""
    subprocess.run([sys.executable, "-c", made], check=True, cwd=tmp_path)
    read = f"import pickle; x = pickle.load(open({str(tmp_path / 'x')!r}, 'rb')); import sys; assert 'leadmerge' not in sys.modules; print(list(x.occurrences(__import__('pyarrow').array(['a one two three four five six b']))))"
    got = subprocess.run([sys.executable, "-c", read], check=True, cwd=tmp_path, capture_output=True, text=True)
    assert "(0, 0, 0)" in got.stdout


def test_token_counts_of_any_script(spark, monkeypatch):
    """Every assigned character, in words and between them, through the tiers; summaries that overflow."""
    import random

    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "COUNTED", 50)
    monkeypatch.setattr(tokens, "PROPOSED", 20)
    rng = random.Random(3)
    chars = [chr(c) for c in range(9, 0x33480) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(c + rng.choice(("", "a", " ", "1", "!", "\t", "\r\n")) for c in chars[i : i + 400]) for i in range(0, len(chars), 400)]
    texts += ["It’s “quoted” — and\ttabbed\r\n" * 20, "你好 " * 30, "Привет <|endoftext|> мир"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    library = Tokenizer.from_file(PATH)
    want = {i: len(library.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(frame, PATH, table_rows=30).collect()} == want
