"""Rows that operators have to bear: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, `row` int, n int, n_removed string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i, w in enumerate(words(rng, n)):
        out.append(w.capitalize() if i % 8 == 0 else w + "." if i % 8 == 7 else w)
    return " ".join(out)


def hard_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(12)]
    near = [w if rng.random() > 0.03 else "changed" for w in base[0].split()]
    texts = [
        *base, base[3], base[3], base[5] + " and then", " ".join(near), None, "", " \t\n ", "one", "Two words.",
        prose(rng, 20_000), "x" * 200_000, "é́ 你好 <|endoftext|> \U0001f600", "a b\x0bc", "ÄÖ idiot\x00nul",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, base[3]), (None, None), (None, "no id here, but a text. With two sentences."), (50, base[1].upper())]
    return [
        (i, t, None if k % 3 else "en", None if k % 5 == 0 else f"src{k % 2}", None, k % 4, "k", k, None, "was here")
        for k, (i, t) in enumerate(rows)
    ]


def hard_docs(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
