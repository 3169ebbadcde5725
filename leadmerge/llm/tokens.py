"""Token counts by a two-tier lookup of pre-token lengths, without moving any text."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from leadmerge.llm.common import most_frequent, stage, texts_of

#: The pre-token pattern of the byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters are split by the pattern here, others by the library's own
#: splitter: what newer scripts belong to depends on its version.
PLAIN = r"^[\n\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{17f}]*$"
#: Entries of the broadcast table (a few MB) and of a worker's cache.
TABLE_ROWS, CACHE_ROWS = 65_536, 200_000
#: Pre-tokens that one task proposes for the table, and how many it counts meanwhile.
PROPOSED, COUNTED = 20_000, 200_000


class _Counter:
    """Lengths of pre-tokens: the shared table, then the worker's cache, then the library."""

    def __init__(self, path: str, table: dict[str, int]):
        # One task is one thread.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split = regex.compile(PRE_TOKEN).findall
        self.table, self.cache = table, {}

    def library_split(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def lengths(self, pieces: list[str], split: Callable[[str], list[str]] | None = None) -> np.ndarray:
        """Token counts of texts, each the sum over its pre-tokens."""
        table, cache = self.table, self.cache
        parts = [(split or self.split)(p) for p in pieces]
        missing = list({t for ts in parts for t in ts if t not in table and t not in cache})
        if len(cache) + len(missing) > CACHE_ROWS:
            cache.clear()
            missing = list({t for ts in parts for t in ts if t not in table})
        cache.update(zip(missing, self.whole(missing)))
        return np.fromiter(
            (sum([table[t] if t in table else cache[t] for t in ts]) for ts in parts), np.int64, len(parts)
        )


def _spaced(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """Pieces between single spaces: offsets per text, pieces, whether a piece is its text's first."""
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy()
    pieces = lists.flatten().dictionary_encode()
    first = np.zeros(len(pieces), bool)
    first[offsets[:-1] - offsets[0]] = True
    return offsets - offsets[0], pieces, first


def _count(counter: _Counter, texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    special = pa.array(np.zeros(len(texts), bool))
    for mark in counter.special:
        special = pc.or_(special, pc.match_substring(texts, mark))
    known = pc.match_substring_regex(texts, PLAIN)
    plain, other = pc.and_(known, pc.invert(special)), pc.invert(pc.or_(known, special))
    # A lone space always starts the next pre-token, so the text can be cut there;
    # between runs of white space it cannot.
    runs = pc.match_substring_regex(texts, r"[ \n]{2}")
    odd = np.flatnonzero(special.to_numpy(zero_copy_only=False))
    long = np.flatnonzero(pc.and_(plain, runs).to_numpy(zero_copy_only=False))
    even = np.flatnonzero(pc.and_(plain, pc.invert(runs)).to_numpy(zero_copy_only=False))
    if len(odd):
        out[odd] = counter.whole(texts.take(pa.array(odd)).to_pylist())
    for i in long:
        out[i] = counter.lengths([texts[int(i)].as_py()])[0]
    for i in np.flatnonzero(other.to_numpy(zero_copy_only=False)):
        out[i] = counter.lengths([texts[int(i)].as_py()], counter.library_split)[0]
    if len(even):
        offsets, pieces, first = _spaced(texts.take(pa.array(even)))
        index, names = pieces.indices.to_numpy(), pieces.dictionary.to_pylist()
        starts = np.unique(index[first])
        after = counter.lengths([" " + n for n in names])
        at_start = np.zeros(len(names), np.int64)
        at_start[starts] = counter.lengths([names[i] for i in starts])
        each = np.where(first, at_start[index], after[index])
        total = np.concatenate([[0], np.cumsum(each)])
        out[even] = total[offsets[1:]] - total[offsets[:-1]]
    return out


def frequent_lengths(docs: DataFrame, path: str, *, text_col: str = "text", rows: int = TABLE_ROWS) -> dict[str, int]:
    """Lengths of the ``rows`` most frequent pre-tokens of all texts.

    Each task counts with a bounded summary, of which the least go when it is full, and
    proposes the most frequent ones with their counts. So what is added up is a bounded
    list per task and never the pre-tokens of the texts.
    """

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(PRE_TOKEN).findall
        found: Counter[str] = Counter()

        def keep(most: int) -> None:
            best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most]
            found.clear()
            found.update(dict(best))

        for batch in batches:
            _, pieces, first = _spaced(texts_of(batch, text_col))
            counts = np.bincount(pieces.indices.to_numpy()[~first], minlength=len(pieces.dictionary))
            for i in np.argsort(-counts, kind="stable")[: 2 * PROPOSED]:
                for token in split(" " + pieces.dictionary[int(i)].as_py()):
                    found[token] += int(counts[i])
            if len(found) > COUNTED:
                keep(COUNTED // 2)
        keep(PROPOSED)
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(path, {})
        for batch in batches:
            tokens = batch.column("token")
            yield pa.RecordBatch.from_pydict({"token": tokens, "length": pa.array(counter.whole(tokens.to_pylist()), pa.int32())})

    proposed = docs.select(text_col).mapInArrow(propose, "token string, n long")
    sums = stage(proposed.groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    best = most_frequent(sums, "n", rows).select("token")
    found = best.mapInArrow(encode, "token string, length int").toArrow()
    return dict(zip(found["token"].to_pylist(), found["length"].to_pylist()))


def token_counts(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
    table_rows: int = TABLE_ROWS,
) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)``, one row per input row.

    ``path`` is a byte-level BPE file of the tokenizers library that every worker can
    open; counts are those of its ``encode`` without added special tokens, truncation
    or padding. The lengths of the most frequent pre-tokens are broadcast
    (``table_rows``, a fixed bound), the others are encoded once per worker and kept in
    a bounded cache, for texts of any script. Texts that hold a special token's string are
    given to the library whole. A null or empty text has 0 bytes and
    0 tokens. Other columns and ids are passed by; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, path, text_col=text_col, rows=table_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(path, shared.value)
        for batch in batches:
            texts = texts_of(batch, "text")
            tokens = _count(counter, texts)
            yield pa.RecordBatch.from_pydict({
                id_col: batch.column("id"),
                "n_bytes": pc.binary_length(texts.cast(pa.binary())).cast(pa.int64()),
                "n_tokens": pa.array(tokens),
                "over_limit": pa.array(tokens > limit),
            })

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
