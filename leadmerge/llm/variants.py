"""Spelling variants: squared distances of letter counts by blocked Gram matrices, then edits."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadmerge.llm.common import mixed, stage

#: Letters of words: A-Z, a-z and U+00C0 to U+00FF; only A-Z are put in lower case.
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups of letters; a changed letter touches two of them at most, so words one edit
#: apart agree in all but two. Common letters are dealt over all groups.
GROUPS = 4
#: Words of a bucket that are compared at once; larger buckets are cut into blocks.
BLOCK = 4096
#: Padded sizes of small blocks whose products are made together.
PADDED = (4, 8, 16, 32, 64)

_BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"
LETTERS = _BY_FREQUENCY + "".join(map(chr, range(0xC0, 0x100)))
_COLUMN = np.full(256, -1, np.int64)
_COLUMN[np.frombuffer(LETTERS.encode("latin-1"), np.uint8)] = np.arange(len(LETTERS))
#: Boustrophedon order, so that each group has its share of frequent and rare letters.
_GROUP_OF = np.array([k % GROUPS if (k // GROUPS) % 2 == 0 else GROUPS - 1 - k % GROUPS for k in range(len(LETTERS))])
#: Every table keys a word by the letter counts of these groups.
TABLES = tuple(itertools.combinations(range(GROUPS), GROUPS - 2))


def spelled_words(docs: DataFrame, id_col: str, text_col: str, least_length: int, damage: int) -> DataFrame:
    """``(word, n)``: runs of letters, every ``damage``-th (by a hash of id and run) without one of its letters."""
    pattern = f"[A-Za-zÀ-ÿ]{{{least_length},}}"
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(key.alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))).alias("run"))
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, SMALL)).otherwise(F.col("run"))
    hashed = runs.select("id", lowered.alias("run")).select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))


def letter_counts(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each letter per word, the letters one after the other, and where words start."""
    text = "".join(words.to_pylist())
    letters = np.frombuffer(text.encode("latin-1"), np.uint8)
    lengths = _lengths(words)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(owner * len(LETTERS) + _COLUMN[letters], minlength=len(lengths) * len(LETTERS))
    return counts.reshape(len(lengths), len(LETTERS)), letters, starts


def _lengths(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(len, words.to_pylist()), np.int64, len(words))


def _group_marks(counts: np.ndarray) -> np.ndarray:
    """A hash of each group's counts per word."""
    odd = mixed(np.arange(1, len(LETTERS) + 1, dtype=np.uint64)) | np.uint64(1)
    marks = np.zeros((len(counts), GROUPS), np.uint64)
    for g in range(GROUPS):
        columns = np.flatnonzero(_GROUP_OF == g)
        marks[:, g] = mixed((counts[:, columns].astype(np.uint64) * odd[columns]).sum(axis=1, dtype=np.uint64) + np.uint64(g + 1))
    return marks


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per word and table, with the counts of the table's groups as key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = _group_marks(letter_counts(batch.column("word"))[0])
        for t, groups in enumerate(TABLES):
            key = np.full(batch.num_rows, t, np.uint64)
            for g in groups:
                key = mixed(key * np.uint64(31) + marks[:, g])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(key.astype(np.int64)), batch.column("word"), batch.column("n")], ["t", "key", "word", "n"]
            )


class _Rows:
    """Sorted rows of many blocks, and the pairs found in them."""

    def __init__(self, rows: pa.Table, columns: list[str]):
        self.words = rows.column("word").combine_chunks()
        self.counts, self.letters, self.starts = letter_counts(self.words)
        self.length = np.diff(self.starts)
        self.block = rows.column("block").to_numpy()
        self.t = rows.column("t").to_numpy()
        self.across = rows.column("lo").to_numpy() != rows.column("hi").to_numpy()
        self.pairs: list[np.ndarray] = []

    def take(self, a: np.ndarray, b: np.ndarray) -> None:
        """Keep the pairs that are one edit apart and agree in no earlier table."""
        if not len(a):
            return
        keep = ~self.across[a] | (self.block[a] != self.block[b])
        a, b = a[keep], b[keep]
        swap = self.length[a] > self.length[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        for part in np.array_split(np.arange(len(a)), max(1, len(a) // 20_000)):
            x, y = a[part], b[part]
            differs = self.counts[x] != self.counts[y]
            same = np.stack([~differs[:, _GROUP_OF == g].any(axis=1) for g in range(GROUPS)], axis=1)
            agree = np.stack([same[:, list(groups)].all(axis=1) for groups in TABLES], axis=1)
            first = agree.argmax(axis=1) == self.t[x]
            x, y = x[first & agree.any(axis=1)], y[first & agree.any(axis=1)]
            self.pairs.append(np.stack([x, y])[:, self.one_edit(x, y)])

    def one_edit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each pair (shorter first) is one replaced or one added letter apart."""
        good = np.zeros(len(x), bool)
        for length in np.unique(self.length[x]).tolist():
            at = np.flatnonzero(self.length[x] == length)
            for some in np.array_split(at, max(1, len(at) * length // 4_000_000)):
                if not len(some):
                    continue
                base = np.arange(length)
                short = self.letters[self.starts[x[some]][:, None] + base]
                head = self.letters[self.starts[y[some]][:, None] + base]
                tail = self.letters[(self.starts[y[some] + 1] - length)[:, None] + base]
                even = self.length[y[some]] == length
                before = np.logical_and.accumulate(short == head, axis=1).sum(axis=1)
                after = np.logical_and.accumulate((short == tail)[:, ::-1], axis=1).sum(axis=1)
                good[some] = np.where(even, before + after == length - 1, before + after >= length)
        return good


def _compare(rows: pa.Table, starts: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    """Pairs one edit apart inside the blocks that start at ``starts``."""
    held = _Rows(rows, columns)
    sizes = np.diff(np.append(starts, rows.num_rows))
    # Small blocks: padded to one size, their products made together.
    low = 1
    for width in PADDED:
        some = starts[(sizes > low) & (sizes <= width)]
        own = sizes[(sizes > low) & (sizes <= width)]
        low = width
        for part in np.array_split(np.arange(len(some)), max(1, len(some) * width // 8192)):
            if not len(part):
                continue
            at = np.minimum(some[part][:, None] + np.arange(width), (some[part] + own[part] - 1)[:, None])
            real = np.arange(width) < own[part][:, None]
            used = np.flatnonzero(held.counts[at.ravel()].any(axis=0))
            x = held.counts[:, used][at].astype(np.float64)
            norms = (x * x).sum(axis=2)
            distance = norms[:, :, None] + norms[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
            length = held.length[at]
            near = (distance <= 2) & (np.abs(length[:, :, None] - length[:, None, :]) <= 1) & real[:, :, None] & real[:, None, :]
            k, i, j = np.nonzero(near & (np.arange(width)[:, None] < np.arange(width)))
            held.take(at[k, i], at[k, j])
    # Large ones: a product for each pair of adjacent length blocks; rows are in order of length.
    for start, size in zip(starts[sizes > PADDED[-1]].tolist(), sizes[sizes > PADDED[-1]].tolist()):
        length = held.length[start : start + size]
        used = np.flatnonzero(held.counts[start : start + size].any(axis=0))
        x = held.counts[start : start + size][:, used].astype(np.float64)
        norms = (x * x).sum(axis=1)
        for value in np.unique(length).tolist():
            first, last, end = np.searchsorted(length, [value, value + 1, value + 2])
            for chunk in range(first, last, 512):
                stop = min(chunk + 512, last)
                distance = norms[chunk:stop, None] + norms[None, chunk:end] - 2 * (x[chunk:stop] @ x[chunk:end].T)
                i, j = np.nonzero(distance <= 2)
                i, j = i[i < j] + chunk + start, j[i < j] + chunk + start
                held.take(i, j)
    found = np.concatenate(held.pairs, axis=1) if held.pairs else np.empty((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([held.words.take(pa.array(found[0])), held.words.take(pa.array(found[1]))], ["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Pairs of every block; a block that a batch cuts off waits for the next one."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = (now if rest is None else pa.concat_tables([rest, now])).combine_chunks()
        starts = _starts(now, columns)
        if not len(starts):
            continue
        if len(starts) > 1:
            yield _compare(now.slice(0, int(starts[-1])), starts[:-1], columns)
        rest = now.slice(int(starts[-1]))
    if rest is not None:
        yield _compare(rest.combine_chunks(), np.zeros(1, np.int64), columns)


def _starts(rows: pa.Table, columns: list[str]) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    change[:1] = True
    for c in columns:
        x = rows.column(c).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def near_words(words: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: all pairs of the distinct words of ``words(word, n)`` one edit apart, once each.

    Words of the same letters in all but two groups share a bucket of a table; pairs of
    a bucket at a squared distance of letter counts of at most two, in equal or adjacent
    lengths, are compared letter by letter. A pair counts in the first table that has it.
    A bucket above ``block`` words is cut into blocks, every pair of which is one group.
    """
    rows = words.select("word", "n").mapInArrow(_keyed, "t int, key long, word string, n long")
    # Adding counts of keys shuffles one number per distinct key and task.
    large = rows.groupBy("t", "key").count().filter(F.col("count") > block).select("t", "key", F.ceil(F.col("count") / block).alias("blocks"))
    dealt = rows.join(large, ["t", "key"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    bucket = ["t", "key", "lo", "hi"]
    dealt = (
        dealt.withColumn("block", F.pmod(F.xxhash64("word"), blocks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
        .select("t", "key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "word")
    )
    return dealt.repartition(*bucket).sortWithinPartitions(*bucket, F.char_length("word")).mapInArrow(
        lambda batches: _blocks(batches, bucket), "a string, b string"
    )


def variant_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2,
    factor: int = 10, damage: int = 31, block: int = BLOCK,
) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)``, one row per word of the texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case; a
    run whose crc32 with the document's id is divisible by ``damage`` loses one letter
    first. Words of at least ``least_length`` letters and ``least_count`` occurrences in
    all documents are kept. Two are near if one letter inserted, deleted or replaced
    makes one the other; all such pairs are found. The form is the near word of the
    largest count (ties: first in code-point order) if it has ``factor`` times the word's
    count, else null; the root follows forms to the last and is the word itself without one.

    Null and empty texts have no words; a null id counts as an empty one; repeated rows
    count each time; words of any length are compared whole. Other columns are not
    looked at; an empty table gives no rows.
    """
    words = stage(spelled_words(docs, id_col, text_col, least_length, damage).filter(F.col("n") >= least_count), "words")
    pairs = stage(near_words(words, block=block), "near")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = named.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    far: Column = -F.col("best.m") >= factor * F.col("n")
    forms = stage(
        words.join(best.withColumnRenamed("a", "word"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(far, F.col("best.b")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"),
        ), "forms",
    )
    # Each form has at least ``factor`` times the count, so chains are short; every round doubles what is followed.
    steps = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = stage(
            steps.join(steps.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
            .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots",
        )
        steps = onward.select("word", "root")
        if onward.filter("moved").isEmpty():
            break
    return forms.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
