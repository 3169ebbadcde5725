"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from leadmerge.llm.common import mixed, stage, texts_of

#: Where a sentence may end: after its mark, or at a line break.
_END = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
_WORD = re.compile(r"(\S+)\s*")
#: Words beyond which a sentence is cut on, and the most that a piece of it has.
LONG, CLAUSE = 24, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Characters of text whose spans one group resolves.
GROUP_CHARS = 24_000_000


def sentences(text: str) -> list[str]:
    """Consecutive pieces of a text, each with the white space that follows it.

    Sentences of more than ``LONG`` words, and text without marks, are cut on behind
    words chosen by their hash: such a cut depends on nothing around it, so a passage
    is cut alike wherever it stands.
    """
    out, start = [], 0
    for end in (*(m.end() for m in _END.finditer(text)), len(text)):
        if end - start > LONG * 2 and text.count(" ", start, end) >= LONG:
            out.extend(_clauses(text[start:end]))
        elif end > start:
            out.append(text[start:end])
        start = end
    return out


def _clauses(sentence: str) -> list[str]:
    """Pieces of a long sentence, of ``CLAUSE`` words at most."""
    out, start, count = [], 0, 0
    for m in _WORD.finditer(sentence):
        count += 1
        if count == CLAUSE or zlib.crc32(m[1].lower().encode("utf-8", "replace")) % 6 == 0:
            out.append(sentence[start : m.end()])
            start, count = m.end(), 0
    if start < len(sentence):
        out.append(sentence[start:])
    return out


def spans(hashes: np.ndarray, words: np.ndarray, ends: np.ndarray, min_sentences: int, min_words: int):
    """Shortest runs from each sentence on, and up to each sentence, that are long enough.

    A run has at least ``min_sentences`` sentences and ``min_words`` words and lies in
    one text; ``ends`` is the index after the last sentence of each sentence's text.
    Where a text repeats a passage, the runs inside it are the same as at the other
    place and cover it up to both ends. Returns (first, last, hash) arrays.
    """
    n = len(hashes)
    total = np.concatenate([[0], np.cumsum(words)])
    index = np.arange(n)
    last = np.maximum(index + min_sentences - 1, np.searchsorted(total, total[:-1] + min_words) - 1)
    forth = last < ends
    starts = np.zeros(n, np.int64)
    if n:
        new = np.concatenate([[True], ends[1:] != ends[:-1]])
        starts = np.maximum.accumulate(np.where(new, index, 0))
    first = np.minimum(index - min_sentences + 1, np.searchsorted(total, total[1:] - min_words, side="right") - 1)
    back = first >= starts
    a = np.concatenate([index[forth], first[back]])
    b = np.concatenate([last[forth], index[back]])
    pairs = np.unique(a * (n + 1) + b) if n else np.empty(0, np.int64)
    a, b = pairs // (n + 1), pairs % (n + 1)
    power = np.cumprod(np.full(n, _BASE)) if n else np.empty(0, np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power, dtype=np.uint64)])
    unpower = np.cumprod(np.full(n, _UNBASE)) if n else np.empty(0, np.uint64)
    return a, b, mixed((prefix[b + 1] - prefix[a]) * unpower[a] + (b - a).astype(np.uint64))


class _Spans:
    """Spans of one batch or group: owner of each, order of owners, places and hashes."""

    def __init__(self, ids, keys, owner, first, last, hashes):
        self.ids, self.keys, self.owner, self.first, self.last, self.hashes = ids, keys, owner, first, last, hashes

    def later(self) -> tuple[np.ndarray, np.ndarray]:
        """Which spans repeat an earlier one, and which are the first of their hash."""
        # Owners by (id, key); rows that repeat a text under one id are the same place.
        order = np.lexsort((self.keys, self.ids))
        rank = np.zeros(len(order), np.int64)
        if len(order):
            i, k = self.ids[order], self.keys[order]
            rank[order] = np.concatenate([[0], np.cumsum((i[1:] != i[:-1]) | (k[1:] != k[:-1]))])
        place = rank[self.owner] << 32 | self.first
        by = np.lexsort((place, self.hashes))
        h, p = self.hashes[by], place[by]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
        head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else by
        after = np.zeros(len(h), bool)
        after[by] = p > p[head]
        one = np.zeros(len(h), bool)
        one[by] = new
        return after, one

    def pack(self, chosen: np.ndarray) -> bytes:
        """Spans ordered by owner, owners' ids and keys once each."""
        chosen = chosen[np.argsort(self.owner[chosen], kind="stable")]
        own, counts = np.unique(self.owner[chosen], return_counts=True)
        head = np.array([len(own), len(chosen)], np.int64)
        parts = (
            head, self.ids[own], self.keys[own], counts.astype(np.int64), self.hashes[chosen],
            self.first[chosen].astype(np.int32), (self.last - self.first)[chosen].astype(np.int32),
        )
        return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))

    @classmethod
    def unpack(cls, blobs: list[bytes]) -> _Spans:
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        owners = 0
        for blob in blobs:
            raw = zstandard.decompress(blob)
            m, n = np.frombuffer(raw, np.int64, 2)
            ids, keys, counts, hashes = np.split(np.frombuffer(raw, np.int64, 3 * m + n, 16), [m, 2 * m, 3 * m])
            first, length = np.split(np.frombuffer(raw, np.int32, 2 * n, 16 + 8 * (3 * m + n)).astype(np.int64), [n])
            values = ids, keys, np.repeat(np.arange(m) + owners, counts), first, first + length, hashes.view(np.uint64)
            for c, v in zip(columns, values):
                c.append(v)
            owners += int(m)
        return cls(*(np.concatenate(c) for c in columns))

    def by_owner(self, chosen: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(id, key, covered sentence ranges) per owner of the chosen spans, overlaps merged."""
        chosen = chosen[np.lexsort((self.first[chosen], self.owner[chosen]))]
        if not len(chosen):
            return
        owner, first, last = self.owner[chosen], self.first[chosen], self.last[chosen]
        for part in np.split(np.arange(len(chosen)), np.flatnonzero(owner[1:] != owner[:-1]) + 1):
            reach = np.maximum.accumulate(last[part])
            cut = np.concatenate([[True], first[part][1:] > reach[:-1] + 1])
            begin = first[part][cut]
            end = reach[np.concatenate([cut[1:], [True]])]
            o = owner[part[0]]
            yield int(self.ids[o]), int(self.keys[o]), np.stack([begin, end], 1).astype(np.int32).tobytes()


def _batch_spans(batch: pa.RecordBatch, min_sentences: int, min_words: int) -> _Spans:
    hashes, words, owner, local = [], [], [], []
    for i, text in enumerate(texts_of(batch, "text").to_pylist()):
        pieces = sentences(text)
        for j, piece in enumerate(pieces):
            split = piece.lower().split()
            hashes.append(xxhash.xxh3_64_intdigest(" ".join(split).encode("utf-8", "replace")))
            words.append(len(split))
            owner.append(i)
            local.append(j)
    owner, local = np.array(owner, np.int64), np.array(local, np.int64)
    ends = np.searchsorted(owner, owner, side="right")
    a, b, h = spans(np.array(hashes, np.uint64), np.array(words, np.int64), ends, min_sentences, min_words)
    ids = batch.column("id").fill_null(np.iinfo(np.int64).min).to_numpy()
    return _Spans(ids, batch.column("key").to_numpy(), owner[a] if len(a) else a, local[a] if len(a) else a, local[b] if len(b) else b, h)


def repeated_spans(rows: DataFrame, *, min_sentences: int, min_words: int) -> DataFrame:
    """``(key, spans)``: sentence ranges of ``rows(id, key, text)`` that repeat an earlier place.

    Of a span's places in one batch all but the first are repeats whatever the other
    batches hold; only the first goes on, so a passage in any share of the texts is one
    row per batch. Those are grouped by parts of the hash, as many as the text needs.
    """
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // GROUP_CHARS))
    width = min((1 << 64) // parts + 1, (1 << 64) - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int64()), ("key", pa.int64()), ("spans", pa.binary())])
        for batch in batches:
            found = _batch_spans(batch, min_sentences, min_words)
            after, one = found.later()
            out = [(None, key, ranges) for _, key, ranges in found.by_owner(np.flatnonzero(after))]
            one = np.flatnonzero(one)
            part = (found.hashes[one] // np.uint64(width)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
                out.append((int(part[some[0]]), None, found.pack(one[some])))
            columns = zip(*out) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def resolve(group: pa.Table) -> pa.Table:
        found = _Spans.unpack(group.column("spans").to_pylist())
        after, _ = found.later()
        out = [(key, ranges) for _, key, ranges in found.by_owner(np.flatnonzero(after))]
        columns = zip(*out) if out else [[], []]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary()))], names=["key", "spans"])

    made = stage(rows.mapInArrow(cut, "part long, key long, spans binary"), "spans")
    met = made.filter("part is not null").select("part", "spans").groupBy("part").applyInArrow(resolve, "key long, spans binary")
    return made.filter("part is null").select("key", "spans").unionAll(met)


def substring_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2, min_words: int = 20
) -> DataFrame:
    """All columns of ``docs`` with repeated passages cut from the text, and two counts.

    Sentences end at ``.``, ``!`` or ``?`` with white space after it, or at a line break;
    longer ones are cut on (:func:`sentences`).
    Every run of consecutive sentences that just reaches ``min_sentences`` and
    ``min_words`` is hashed (case and white space apart); a sentence goes if a run over
    it stands earlier as well, by (id, place): in a smaller id, or earlier in the same
    text. The other sentences stay as they are. Adds ``n_sentences`` and ``n_removed``
    (columns of these names are replaced). Null and empty texts have none and stay; a
    null id counts as the smallest; rows that repeat an id and its text are one place
    and stay alike. A text left without sentences becomes empty, not null. An empty
    table gives no rows.
    """
    rest = [c for c in docs.columns if c not in (text_col, "n_sentences", "n_removed")]
    keyed = docs.withColumn("_span_key", F.xxhash64(id_col, text_col))
    rows = keyed.select(F.col(id_col).cast("long").alias("id"), F.col("_span_key").alias("key"), F.col(text_col).alias("text"))
    repeats = repeated_spans(rows, min_sentences=min_sentences, min_words=min_words)
    per_text = repeats.groupBy(F.col("key").alias("_span_key")).agg(F.collect_list("spans").alias("_spans"))
    joined = keyed.join(per_text, "_span_key", "left").select(*rest, F.col(text_col), "_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            for text, ranges in zip(batch.column(text_col).to_pylist(), batch.column("_spans").to_pylist()):
                pieces = sentences(text) if text else []
                out = np.zeros(len(pieces), bool)
                for blob in ranges or []:
                    for a, b in np.frombuffer(blob, np.int32).reshape(-1, 2):
                        out[a : b + 1] = True
                texts.append("".join(p for p, o in zip(pieces, out) if not o) if out.any() else text)
                counts.append(len(pieces))
                gone.append(int(out.sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())],
                [*rest, text_col, "n_sentences", "n_removed"],
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return joined.mapInArrow(cut, f"{kinds}, `{text_col}` string, n_sentences long, n_removed long")
