"""Records of large files whose separators may also stand inside quotes or brackets.

A file is read as pieces between separators, block by block in many tasks. Whether a
separator ends a record depends on everything before it, but only through two numbers:
is the place inside quotes, and how many brackets are open. Each block is summed up for
both cases it may start in, prefix sums over the blocks say which one holds, and then
every block cuts its own records. Only what a block leaves unfinished is put together
with the next ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from leadmerge.session import cut_lineage

#: One row per block is broadcast up to this many bytes, after measuring; beyond it the
#: pieces are shuffled to their block's row.
BROADCAST_BYTES = 32 << 20

_WHOLE, _HEAD, _OPEN = 0, 1, 2
_RECORD = "file string, block long, row long, kind int, before long, after long, text string"


def pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """``(file, block, value)`` in file order within each block."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("value"),
    )


_OPENED = np.zeros(256, np.int8)
_OPENED[[ord("["), ord("{")]], _OPENED[[ord("]"), ord("}")]] = 1, -1


def _counts(values: pa.Array, nested: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotes of each piece, and the brackets it opens less those it closes if it starts
    outside or inside quotes.

    ``nested`` is JSON: brackets count, and a character behind a backslash does not.
    """
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    data = values.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    quotes = data == ord('"')
    signs = _OPENED[data] if nested else None
    if nested:
        # A character is escaped behind an odd number of backslashes of its piece.
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        after = np.flatnonzero((data[:-1] == ord("\\")) & (quotes[1:] | (signs[1:] != 0)) & ~first[1:-1]) + 1
        for place in after.tolist():
            run = place - 1
            while not first[run] and data[run - 1] == ord("\\"):
                run -= 1
            if (place - run) % 2:
                quotes[place], signs[place] = False, 0
    so_far = np.concatenate([[0], np.cumsum(quotes)])
    q = np.diff(so_far[offsets])
    if not nested:
        return q, np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.flatnonzero(signs)
    piece = np.searchsorted(offsets, at, "right") - 1
    inside = (so_far[at] - so_far[offsets[piece]]) % 2 == 1
    d0, d1 = (np.bincount(piece[k], signs[at[k]], n).astype(np.int64) for k in (~inside, inside))
    return q, d0, d1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Parts of a batch that belong to one block."""
    if not batch.num_rows:
        return
    files = batch.column("file").dictionary_encode()
    code, block = files.indices.to_numpy(), batch.column("block").to_numpy()
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield files.dictionary[int(code[start])].as_py(), int(block[start]), batch.slice(start, stop - start)


def _walk(counts: tuple[np.ndarray, np.ndarray, np.ndarray], odd: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Inside quotes or not, and open brackets, behind each piece."""
    q, d0, d1 = counts
    after = (odd + np.cumsum(q)) & 1
    before = np.concatenate([[odd], after[:-1]])
    return after, depth + np.cumsum(np.where(before == 1, d1, d0))


def _sum_up(batches: Iterator[pa.RecordBatch], nested: bool) -> Iterator[pa.RecordBatch]:
    """One row per block: its quotes, and its change of depth from either start."""
    key, state = None, [0, 0, 0, 0]
    names = ["file", "block", "q", "d0", "d1"]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), *[pa.array([v], pa.int64()) for v in (key[1], state[0], state[2], state[3])]], names)

    for batch in batches:
        for file, block, run in _runs(batch):
            if key != (file, block):
                if key is not None:
                    yield row()
                key, state = (file, block), [0, 1, 0, 0]
            counts = _counts(run.column("value"), nested)
            a, x = _walk(counts, state[0], state[2])
            b, y = _walk(counts, state[1], state[3])
            state = [int(a[-1]), int(b[-1]), int(x[-1]), int(y[-1])]
    if key is not None:
        yield row()


def block_states(parts: DataFrame, nested: bool) -> DataFrame:
    """``(file, block, odd, depth, odd_after, depth_after)``: the state at both ends of each block."""
    sums = parts.mapInArrow(lambda batches: _sum_up(batches, nested), "file string, block long, q long, d0 long, d1 long")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    known = sums.withColumn("odd", before("q") % 2).withColumn("d", F.when(F.col("odd") == 1, F.col("d1")).otherwise(F.col("d0")))
    return known.withColumn("depth", before("d")).select(
        "file", "block", "odd", "depth", ((F.col("odd") + F.col("q")) % 2).alias("odd_after"), (F.col("depth") + F.col("d")).alias("depth_after")
    )


def _cut(batches: Iterator[pa.RecordBatch], separator: str, limit: int, nested: bool, wanted: tuple[int, ...], below: int | None = None) -> Iterator[pa.RecordBatch]:
    """Records of the blocks: whole ones, ends of an earlier block's, and unfinished ones;
    of the whole ones those that begin with less than ``below`` open brackets."""
    key = None
    odd = depth = rows = begun = 0
    clean = False  # whether a record has begun in this block
    waiting: list[str] = []

    def made(file, block, numbers, kinds, before, after, texts) -> pa.RecordBatch:
        n = len(numbers)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(numbers, pa.int64()), pa.array(kinds, pa.int32()),
             pa.array(before, pa.int64()), pa.array(after, pa.int64()), texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())],
            ["file", "block", "row", "kind", "before", "after", "text"])

    def left() -> Iterator[pa.RecordBatch]:
        kind = _OPEN if clean else _HEAD
        if waiting and kind in wanted:
            yield made(*key, [rows], [kind], [begun], [depth], [separator.join(waiting)])

    for batch in batches:
        for file, block, run in _runs(batch):
            if key != (file, block):
                yield from left()
                key, waiting, rows = (file, block), [], 0
                odd, depth = int(run.column("odd")[0].as_py()), int(run.column("depth")[0].as_py())
                clean, begun = odd == 0 and depth <= limit, depth
            values = run.column("value")
            inside, depths = _walk(_counts(values, nested), odd, depth)
            odd, depth = int(inside[-1]), int(depths[-1])
            ends = np.flatnonzero((inside == 0) & (depths <= limit))
            if not len(ends):
                waiting += values.to_pylist()
                continue
            starts = np.concatenate([[0], ends[:-1] + 1])
            before = np.concatenate([[begun], depths[ends[:-1]]])
            kinds = np.full(len(ends), _WHOLE, np.int32)
            if not clean:
                kinds[0] = _HEAD
            long_ = starts != ends
            long_[0] |= bool(waiting)
            kept = np.isin(kinds, wanted) & (True if below is None else before < below)
            if kept.any():
                texts = values.take(pa.array(ends[kept]))
                several = np.flatnonzero(long_[kept])
                if len(several):
                    at = np.flatnonzero(kept)[several].tolist()
                    joined = [separator.join([*(waiting if k == 0 else ()), *values.slice(starts[k], ends[k] + 1 - starts[k]).to_pylist()]) for k in at]
                    place = np.arange(len(texts))
                    place[several] = len(texts) + np.arange(len(several))
                    texts = pa.concat_arrays([texts, pa.array(joined, pa.string())]).take(pa.array(place))
                yield made(file, block, (rows + np.arange(len(ends)))[kept], kinds[kept], before[kept], depths[ends[kept]], texts)
            waiting = values.slice(ends[-1] + 1).to_pylist()
            clean, begun, rows = True, int(depths[ends[-1]]), rows + len(ends)
    if key is not None:
        yield from left()


def records(parts: DataFrame, separator: str, limit: int = 0, *, nested: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(file, block, row, before, after, text)`` of all records, the same of those that
    begin with less than ``limit`` open brackets, and the states of the blocks.

    A record ends at a separator outside quotes with at most ``limit`` open brackets, or
    with its file; ``before`` and ``after`` are the open brackets at its ends, which count
    in ``nested`` text, that is JSON. Blocks are those of the file scan: the scan's settings must be the same when the result is
    computed, else the job fails.
    """
    states = cut_lineage(block_states(parts, nested))
    size = states.agg(F.coalesce(F.sum(F.octet_length("file") + 48), F.lit(0))).first()[0]
    changed = F.raise_error(F.lit("the blocks of the files are not those that were counted")).cast("long")

    def with_state(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
        known = known.select("file", "block", "odd", "depth")
        if size <= BROADCAST_BYTES:
            return rows.join(F.broadcast(known), ["file", "block"], how)
        numbered = rows.withColumn("line", F.monotonically_increasing_id())
        return numbered.join(known, ["file", "block"], how).sortWithinPartitions("file", "block", "line")

    every = with_state(parts, states, "left").withColumn("odd", F.coalesce("odd", changed))
    whole, outer = (
        every.mapInArrow(lambda batches, below=below: _cut(batches, separator, limit, nested, (_WHOLE,), below), _RECORD).drop("kind")
        for below in (None, limit)
    )
    torn = states.where((F.col("odd") == 1) | (F.col("depth") > limit) | (F.col("odd_after") == 1) | (F.col("depth_after") > limit))
    if torn.isEmpty():
        return whole, outer, states
    ends = with_state(parts, torn, "inner").mapInArrow(lambda batches: _cut(batches, separator, limit, nested, (_HEAD, _OPEN)), _RECORD)
    ends = cut_lineage(ends)
    # A head goes to the last block before it that left a record open.
    so_far = Window.partitionBy("file").orderBy("block", "kind")
    owner = F.last(F.when(F.col("kind") == _OPEN, F.col("block")), ignorenulls=True).over(so_far)
    owned = ends.select("file", "block", "kind").withColumn("owner", owner)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"])
    joined = (
        ends.join(owned, ["file", "block", "kind"]).groupBy("file", "owner")
        .agg(F.max(F.when(F.col("kind") == _OPEN, F.col("row"))).alias("row"), F.max(F.when(F.col("kind") == _OPEN, F.col("before"))).alias("before"),
             F.max_by("after", "block").alias("after"), F.array_join(texts, separator).alias("text"))
        .select("file", F.col("owner").alias("block"), "row", "before", "after", "text")
    )
    return whole.unionByName(joined), outer.unionByName(joined.where(F.col("before") < limit)), states
