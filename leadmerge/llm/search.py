"""Ranked lexical search: summed accumulators of short lists inside a skipping walk over long ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from leadmerge.llm.common import ALNUM, stage, texts_of, word_lists

#: Postings of one shard of the index, the unit that is searched in memory.
SHARD_POSTINGS = 1_000_000
#: Documents of one step of the walk; lists know their largest impact in each.
WINDOW = 1024
#: Lists are short while they hold one posting for so many documents of the shard, together.
SHORT_SHARE = 8
#: Bytes of item terms that are broadcast at a time; more items take more passes.
ITEM_BYTES = 16 << 20
#: Parts in which the best of all tasks are merged before the last merge.
MERGE_PARTS = 64

_INDEX = "n_docs long, n_terms long, terms array<int>, lengths array<int>, ids binary, sizes binary, docs binary, tf binary"


def _index(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array, shard_postings: int) -> Iterator[pa.RecordBatch]:
    """Shards of postings of the wanted terms, term by term and in document order."""
    size = len(vocabulary)
    ids, lengths, owners, terms, tfs = [], [], [], [], []
    docs = words_seen = base = held = 0

    def flush() -> pa.RecordBatch:
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        term = np.concatenate(terms) if terms else np.empty(0, np.int64)
        tf = np.concatenate(tfs) if tfs else np.empty(0, np.int64)
        present, local = np.unique(owner, return_inverse=True)
        order = np.argsort(term, kind="stable")
        lists, counts = np.unique(term, return_counts=True)
        id_list = pa.concat_arrays(ids).take(pa.array(present)) if ids else pa.array([], pa.int64())
        known = id_list.is_valid().to_numpy(zero_copy_only=False)
        numbers = np.stack([id_list.fill_null(0).to_numpy().astype(np.int64), known.astype(np.int64)])
        n = np.concatenate(lengths)[present] if lengths else np.empty(0, np.int64)
        return pa.RecordBatch.from_pydict({
            "n_docs": pa.array([docs], pa.int64()), "n_terms": pa.array([words_seen], pa.int64()),
            "terms": pa.array([lists.astype(np.int32)], pa.list_(pa.int32())), "lengths": pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
            "ids": pa.array([numbers.tobytes()], pa.binary()), "sizes": pa.array([n.astype(np.int64).tobytes()], pa.binary()),
            "docs": pa.array([local[order].astype(np.int32).tobytes()], pa.binary()), "tf": pa.array([tf[order].astype(np.int32).tobytes()], pa.binary()),
        })

    for batch in batches:
        offsets, words = word_lists(texts_of(batch, "text"), ALNUM)
        n = np.diff(offsets)
        coded = words.dictionary_encode()
        place = pc.index_in(coded.dictionary, vocabulary).fill_null(-1).to_numpy()
        term = place[coded.indices.to_numpy()].astype(np.int64) if len(words) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        wanted = term >= 0
        code, tf = np.unique(owner[wanted] * max(size, 1) + term[wanted], return_counts=True)
        ids.append(batch.column("id"))
        lengths.append(n)
        owners.append(code // max(size, 1) + base)
        terms.append(code % max(size, 1))
        tfs.append(tf)
        base += len(n)
        docs += int((n > 0).sum())
        words_seen += int(n.sum())
        held += len(code) + len(n)
        if held >= shard_postings:
            yield flush()
            ids, lengths, owners, terms, tfs = [], [], [], [], []
            docs = words_seen = base = held = 0
    if held:
        yield flush()


class _Best:
    """The best documents of one item so far: highest score, then smallest id, ids that are null last."""

    __slots__ = ("top", "score", "known", "id")

    def __init__(self, top: int):
        self.top = top
        self.score, self.known, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        score, known, ids = (np.concatenate(x) for x in ((self.score, score), (self.known, known), (self.id, ids)))
        order = np.lexsort((ids, 1 - known, -score))[: self.top]
        self.score, self.known, self.id = score[order], known[order], ids[order]

    def least(self) -> int:
        """What a document has to reach."""
        return max(1, int(self.score[-1])) if len(self.score) == self.top else 1


class _Shard:
    """Posting lists of one shard with their impacts."""

    def __init__(self, row: dict, weights: np.ndarray, total_docs: int, total_terms: int):
        self.terms = np.asarray(row["terms"], np.int64)
        self.ends = np.cumsum(np.asarray(row["lengths"], np.int64))
        self.starts = self.ends - np.asarray(row["lengths"], np.int64)
        self.id, self.known = np.frombuffer(row["ids"], np.int64).reshape(2, -1)
        self.docs = np.frombuffer(row["docs"], np.int32).astype(np.int64)
        tf = np.frombuffer(row["tf"], np.int32).astype(np.int64)
        m = 50 + (50 * np.frombuffer(row["sizes"], np.int64) * total_docs) // max(total_terms, 1)
        weight = np.repeat(weights[self.terms], self.ends - self.starts)
        self.impact = weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.docs]))
        self.windows = -(-len(self.id) // WINDOW)
        self.edges = np.arange(self.windows + 1) * WINDOW
        self.cache: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def long_list(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, impacts, first posting and largest impact of each window."""
        if k not in self.cache:
            self.cache[k] = self.walked(self.docs[self.starts[k] : self.ends[k]], self.impact[self.starts[k] : self.ends[k]])
        return self.cache[k]

    def walked(self, docs: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cuts = np.searchsorted(docs, self.edges)
        most = np.zeros(self.windows, np.int64)
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        if len(full):
            most[full] = np.maximum.reduceat(impact, cuts[:-1][full])
        return docs, impact, cuts, most


def _summed(docs: list[np.ndarray], impacts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of several slices in order, with the sum of their impacts."""
    if len(docs) == 1:
        return docs[0], impacts[0]
    every, impact = np.concatenate(docs), np.concatenate(impacts)
    if not len(every):
        return every, impact
    order = np.argsort(every, kind="stable")
    every, impact = every[order], impact[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.add.reduceat(impact, first)


def search_shard(shard: _Shard, wanted: np.ndarray, best: _Best) -> None:
    """Add the best documents of the shard for one item's terms.

    Short lists are added up term at a time into accumulators, one list with a known
    largest sum. It and the long lists are walked document at a time, window by window:
    a window whose largest impacts cannot reach what is needed is skipped, in the others
    only lists that could lift a document over it bring candidates, the rest are looked
    up for candidates that still can get there.
    """
    at = np.flatnonzero(np.isin(shard.terms, wanted, assume_unique=True))
    if not len(at):
        return
    lengths = shard.ends[at] - shard.starts[at]
    at = at[np.argsort(lengths, kind="stable")]
    short = np.cumsum(np.sort(lengths, kind="stable")) * SHORT_SHARE <= len(shard.id)
    lists = [shard.long_list(int(k)) for k in at[~short]]
    need = best.least()
    if short.any():
        docs, sums = _summed(
            [shard.docs[shard.starts[k] : shard.ends[k]] for k in at[short]], [shard.impact[shard.starts[k] : shard.ends[k]] for k in at[short]]
        )
        lists.append(shard.walked(docs, sums))
        if len(sums) >= best.top:  # these documents have that much already
            need = max(need, int(np.partition(sums, len(sums) - best.top)[len(sums) - best.top]))
    most = np.stack([x[3] for x in lists])
    reach = most.sum(axis=0)
    for w in range(shard.windows):
        if reach[w] < need:
            continue
        order = np.argsort(most[:, w], kind="stable")
        rising = np.cumsum(most[order, w])
        first = int(np.searchsorted(rising, need))  # below it lists cannot reach it together
        slices = [(lists[k][0][lists[k][2][w] : lists[k][2][w + 1]], lists[k][1][lists[k][2][w] : lists[k][2][w + 1]]) for k in order]
        docs, score = _summed([s[0] for s in slices[first:]], [s[1] for s in slices[first:]])
        for i in range(first - 1, -1, -1):
            able = score + rising[i] >= need
            docs, score = docs[able], score[able]
            if not len(docs):
                break
            there, impact = slices[i]
            if len(there):
                place = np.minimum(np.searchsorted(there, docs), len(there) - 1)
                score = score + np.where(there[place] == docs, impact[place], 0)
        good = score >= need
        if good.any():
            found = docs[good]
            best.add(score[good], shard.known[found], shard.id[found])
            need = max(need, best.least())


def _search(
    batches: Iterator[pa.RecordBatch], queries: list[np.ndarray], numbers: list[int | None], weights: np.ndarray, total_docs: int, total_terms: int, top: int
) -> Iterator[pa.RecordBatch]:
    bests = [_Best(top) for _ in queries]
    for batch in batches:
        for row in batch.to_pylist():
            shard = _Shard(row, weights, total_docs, total_terms)
            for wanted, best in zip(queries, bests):
                search_shard(shard, wanted, best)
    for k, best in enumerate(bests):
        ids = pa.array(best.id, mask=best.known == 0)
        yield pa.RecordBatch.from_pydict({
            "item": pa.array(np.full(len(ids), k, np.int64)), "item_id": pa.array([numbers[k]] * len(ids), pa.int64()),
            "doc_id": ids, "score": pa.array(best.score),
        })


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``(item_id, terms, bytes)``: the distinct terms of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, words = word_lists(texts_of(batch, "text"), ALNUM)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(owner)), words], ["item_id", "term"])

    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return (
        rows.mapInArrow(cut, "item_id long, term string").distinct()
        .groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.sum(F.octet_length("term") + 8).alias("bytes"))
    )


def lexical_search(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", top: int = 50, shard_postings: int = SHARD_POSTINGS, item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best documents of each item.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with
    A-Z in lower case. A document scores by its items' distinct terms in whole numbers:
    ``w * (1e9 * tf div (1000 * tf + 20 * m))`` with ``w = floor(1000 * ln((2N + 2) /
    (2df + 1)))`` and ``m = 50 + 50 * n * N div L``, over counts of all documents. Ranks
    go by score, then by id; null ids come last. The result is exact.

    One pass over the documents writes an index of the terms that items ask for, in
    shards of ``shard_postings``; a second pass searches every shard. Each task returns
    its ``top`` best of an item, and those are merged in two steps. Items are broadcast
    ``item_bytes`` of terms at a time, each such part takes its own passes.

    Null and empty texts have no terms: such documents are not counted, such items have
    no rows. Rows that repeat an item's id are one item with the terms of all; documents
    that repeat an id are ranked one by one. Ids are integers. Other columns are not
    looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = stage(_item_terms(items, item_col, item_text_col), "items")
    total = asked.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, math.ceil(2 * total / item_bytes))
    found: DataFrame | None = None
    for part in range(parts):
        some = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).select("item_id", "terms").toArrow()
        numbers = some.column("item_id").to_pylist()
        terms = some.column("terms").combine_chunks() if some.num_rows else pa.array([], pa.list_(pa.string()))
        vocabulary = terms.flatten().unique()
        queries = [np.sort(pc.index_in(x.values, vocabulary).to_numpy()).astype(np.int64) for x in terms]
        words = spark.sparkContext.broadcast(vocabulary.to_pylist())
        index = stage(
            rows.mapInArrow(lambda batches, words=words: _index(batches, pa.array(words.value, pa.string()), shard_postings), _INDEX), "index"
        )
        sums = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        n, length = sums[0] or 0, sums[1] or 0
        held = (
            index.select(F.explode(F.arrays_zip("terms", "lengths")).alias("x")).groupBy(F.col("x.terms").alias("term"))
            .agg(F.sum("x.lengths").alias("df")).toArrow()
        )
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in zip(held.column("term").to_pylist(), held.column("df").to_pylist()):
            weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        sent = spark.sparkContext.broadcast((queries, numbers, weights))
        each = index.select("terms", "lengths", "ids", "sizes", "docs", "tf").mapInArrow(
            lambda batches, sent=sent, n=n, length=length: _search(batches, *sent.value, n, length, top), "item long, item_id long, doc_id long, score long"
        )
        found = each if found is None else found.unionAll(each.withColumn("item", F.col("item") + F.lit(part << 32)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS))
    first = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    return last.select("item_id", "rank", "doc_id", "score")
