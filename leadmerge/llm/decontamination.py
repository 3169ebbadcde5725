"""Benchmark decontamination: pieces that edits must leave whole, exact edit distances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadmerge.llm.common import ALNUM, hash_words, mixed, sent, texts_of, word_lists

#: Words of a piece that its key holds, at most; the check looks at all of them.
KEYED = 8
#: Items of fewer words occur only as a whole text: anywhere else they say too little.
LEAST = 3
#: Bytes of item texts that are broadcast at once; more items take more passes.
PASS_BYTES = 1 << 24
#: Words of the windows that are compared together.
BLOCK = 1 << 21


def edit_in(item: list[str], text: list[str]) -> tuple[int, int]:
    """Least word edit distance of ``item`` to any run of ``text``, and where that run ends."""
    codes = {w: i for i, w in enumerate(set(item))}
    b = np.array([codes.get(w, -1) for w in text], np.int64)
    row = np.zeros(len(text) + 1, np.int64)
    index = np.arange(len(text) + 1)
    for i, word in enumerate(item, 1):
        best = np.minimum(row[:-1] + (b != codes[word]), row[1:] + 1)
        # Insertions: the smallest value to the left plus the distance from it.
        row = np.minimum.accumulate(np.concatenate([[i], best]) - index) + index
    end = int(row.argmin())
    return int(row[end]), end


def _keys(hashes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Keys of the runs of one word, two words and so on up to ``longest`` from every word."""
    key = np.full(len(hashes), 1, np.uint64)
    for size in range(1, min(longest, len(hashes)) + 1):
        key = mixed(key[: len(hashes) - size + 1] * np.uint64(31) + hashes[size - 1 :])
        yield key


class Pieces:
    """Items by their pieces.

    ``k`` edits touch at most ``k`` of ``k + 1`` pieces, so an occurrence within ``k``
    edits holds one piece unchanged, and the rest of it lies within ``k`` words of
    where that piece says.
    """

    def __init__(self, ids: pa.Array, texts: pa.Array, tolerance: float):
        self.ids, self.tolerance = ids, tolerance
        self.offsets, self.words = word_lists(texts, ALNUM)
        hashes = hash_words(self.words)
        self.n = np.diff(self.offsets)
        self.edits = np.minimum((self.n * tolerance).astype(np.int64), np.maximum(self.n - 1, 0))
        counts = np.where(self.n > 0, self.edits + 1, 0)
        item = np.repeat(np.arange(len(self.n)), counts)
        number = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = number * self.n[item] // counts[item]
        size = np.minimum((number + 1) * self.n[item] // counts[item] - begin, KEYED)
        self.longest = int(size.max(initial=0))
        #: Of each key length: keys in order, each one's item and place in it, and a filter.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length, keys in enumerate(_keys(hashes, self.longest), 1):
            these = np.flatnonzero(size == length)
            if len(these):
                key = keys[self.offsets[item[these]] + begin[these]]
                order = np.argsort(key, kind="stable")
                seen = np.zeros(1 << 22, bool)
                seen[key >> np.uint64(42)] = True
                self.tables[length] = key[order], item[these][order], begin[these][order], seen
        #: Every item's words.
        self.held = np.unique(self._held(np.repeat(np.arange(len(self.n)), self.n), hashes))

    @staticmethod
    def _held(item: np.ndarray, words: np.ndarray) -> np.ndarray:
        return mixed(words + mixed(item.astype(np.uint64) + np.uint64(1)))

    def candidates(self, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """``(text, item, first, end)`` rows of word ranges that hold all occurrences with a piece in them."""
        found = [np.empty((0, 4), np.int64)]
        for length, keys in enumerate(_keys(hashes, self.longest), 1):
            if length not in self.tables:
                continue
            known, item, begin, seen = self.tables[length]
            at = np.flatnonzero(seen[keys >> np.uint64(42)])
            low, high = np.searchsorted(known, keys[at], "left"), np.searchsorted(known, keys[at], "right")
            text = np.searchsorted(offsets, at, "right") - 1
            kept = (high > low) & (at + length <= offsets[text + 1])  # no run goes on in the next text
            at, low, high, text = at[kept], low[kept], high[kept], text[kept]
            ends = np.cumsum(high - low)
            block = max(1, BLOCK // int((self.n + 2 * self.edits).max()))
            for a in range(0, int(ends[-1]) if len(ends) else 0, block):
                pair = np.arange(a, min(a + block, ends[-1]))
                hit = np.searchsorted(ends, pair, "right")
                entry = high[hit] - (ends[hit] - pair)
                i, t = item[entry], text[hit]
                start = at[hit] - begin[entry] - self.edits[i]
                first = np.maximum(start, offsets[t])
                end = np.minimum(start + self.n[i] + 2 * self.edits[i], offsets[t + 1])
                # All words but those edited have to be there.
                width = end - first
                owner = np.repeat(np.arange(len(pair)), width)
                word = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width) + first[owner]
                held = self._held(i[owner], hashes[word])
                there = self.held[np.minimum(np.searchsorted(self.held, held), len(self.held) - 1)] == held
                enough = np.bincount(owner[there], minlength=len(pair)) >= self.n[i] - self.edits[i]
                whole = (self.n[i] >= LEAST) | (offsets[t + 1] - offsets[t] == self.n[i])
                found.append(np.stack([t, i, first, end], axis=1)[enough & whole])
        return np.unique(np.concatenate(found), axis=0)

    def occurrences(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """``(text, item, distance)`` of all occurrences, one for each range of candidates."""
        offsets, words = word_lists(texts, ALNUM)
        rows = self.candidates(offsets, hash_words(words))
        # Ranges of one item in one text that overlap are one.
        apart = np.any(rows[1:, :2] != rows[:-1, :2], axis=1) | (rows[1:, 2] > np.maximum.accumulate(rows[:, 3])[:-1])
        for part in np.split(rows, np.flatnonzero(apart) + 1) if len(rows) else []:
            t, i, first, end = *part[0, :3], part[:, 3].max()
            item = self.words.slice(self.offsets[i], self.n[i]).to_pylist()
            distance = edit_in(item, words.slice(first, end - first).to_pylist())[0]
            if distance <= int(self.n[i] * self.tolerance):
                yield int(t), int(i), distance


def contaminated(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", tolerance: float = 0.25,
) -> DataFrame:
    """``(id_col, item_col, distance, n_words)``: items that occur in a text, up to edits.

    Words are lower-case letters and digits of any script. An item occurs if a run of
    the text's words is within ``tolerance`` (below 1) times the item's ``n_words`` word
    edits (rounded down); ``distance`` is the least. Items of under ``LEAST`` words occur
    only as a whole text. Of all others every occurrence is found: one of the item's
    pieces stands in it unchanged, pieces are looked up at every word of every text,
    and what they point to is verified exactly where it is found. No text is shuffled.
    Items are broadcast, ``PASS_BYTES`` of text at a time. Null and empty texts and
    items have no words and match nothing. A null id is kept as it is; rows that repeat
    an id report it once per item. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    some = items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).filter(F.col("text").isNotNull())
    parts = (some.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES + 1
    kind = items.schema[item_col].dataType.simpleString()

    def find(part: int) -> DataFrame:
        chosen = some.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).toArrow().combine_chunks()
        ids, texts = (chosen[c].combine_chunks() for c in ("id", "text"))
        shared = sent(docs.sparkSession, Pieces(ids, texts, tolerance))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = shared()
            for batch in batches:
                found = list(pieces.occurrences(texts_of(batch, "text")))
                text, item, distance = (pa.array([x[c] for x in found], pa.int64()) for c in range(3))
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").take(text), "item_id": pieces.ids.take(item),
                    "distance": distance, "n_words": pa.array(pieces.n).take(item),
                })

        return rows.mapInArrow(search, f"id long, item_id {kind}, distance long, n_words long")

    return (
        reduce(DataFrame.unionAll, [find(p) for p in range(parts)])
        .groupBy("id", "item_id").agg(F.min("distance").alias("distance"), F.max("n_words").alias("n_words"))
        .select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "distance", "n_words")
    )
