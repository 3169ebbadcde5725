"""Helpers of the training-data operators: tables, stages, batches and components."""

from __future__ import annotations

import pickle
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadmerge.session import work_path

#: Words of a text: runs of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch handed to Python, whatever the length of the texts.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Python operators get its rows in batches of bounded bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: computed once, short lineage."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(spark: SparkSession, value):
    """Broadcast of any value; call what comes back, on a worker, to have it.

    Workers need not find this package: its classes travel with the value.
    """
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        if not hasattr(get, "value"):
            get.value = pickle.loads(shared.value)
        return get.value

    return get


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves ``fold``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


#: Rows without an id get a number from here on; ids are smaller.
NO_ID = 1 << 62


def own_id(key: Column, content: Column) -> Column:
    """The id, or for rows without one a number made from what they hold.

    Such numbers come behind all ids, so the smallest of a group is an id if it has one;
    rows of equal content share theirs.
    """
    return F.coalesce(key.cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(content), F.lit(NO_ID - 1)))


def shown_id(node: Column) -> Column:
    """The id that :func:`own_id` stands for, null if there was none."""
    return F.when(node < NO_ID, node)


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A text column with nulls as empty texts."""
    return batch.column(column).fill_null("")


def most_frequent(counts: DataFrame, column: str, rows: int) -> DataFrame:
    """Rows whose count is at least the level that ``rows`` of them at most reach.

    The level comes from how many rows have each count, so nothing is sorted and no
    task gathers candidates of all others; rows tied at the cut are left out.
    """
    levels = counts.groupBy(column).agg(F.count("*").alias("k")).toArrow()
    order = np.argsort(-levels[column].to_numpy())
    level, reached = levels[column].to_numpy()[order], np.cumsum(levels["k"].to_numpy()[order])
    inside = level[reached <= rows]
    return counts.where(F.col(column) >= int(inside[-1])) if len(inside) else counts.limit(0)


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of ``edges(u, v)``: one row ``(node, root)`` per node.

    Rounds of contraction: every node joins the neighbour that comes first under the
    round's order (ids combined with a random mask, so chains shrink geometrically),
    edges move to the joined nodes, loops and repeats go. Hubs are only aggregated
    (combined before the shuffle) or on the left of a join. ``root`` is one node of
    the component, not always the smallest. Nulls are not nodes; no edges, no rows.
    """
    rng = random.Random(7)
    left = stage(
        edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct(),
        label,
    )
    steps: list[DataFrame] = []
    mask = 0
    while not left.isEmpty():
        both = left.select("u", "v").unionAll(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        key = F.lit(mask).cast("long")
        first = both.groupBy("u").agg(F.min(F.col("v").bitwiseXOR(key)).alias("best"))
        step = stage(
            first.select(
                F.col("u").alias("node"),
                F.least("best", F.col("u").bitwiseXOR(key)).bitwiseXOR(key).alias("to"),
            ),
            label,
        )
        steps.append(step)
        moved = (
            left.join(step.select(F.col("node").alias("u"), F.col("to").alias("a")), "u")
            .join(step.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
            .filter("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .distinct()
        )
        left = stage(moved, label)
        mask = rng.getrandbits(62)
    if not steps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # The last round's targets are roots; earlier rounds follow from them.
    found = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = found.withColumnsRenamed({"node": "to"})
        found = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return found


#: Byte tables: A-Z in lower case; the same with all but letters, digits and non-ASCII as spaces.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
ALNUM = np.array(
    [b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8
)


def word_lists(texts: pa.Array, table: np.ndarray = LOWER) -> tuple[np.ndarray, pa.Array]:
    """Words between ASCII white space after mapping the bytes by ``table``.

    Returns the offsets of each text's words, and all words one after the other.
    """
    texts = pa.concat_arrays([texts])  # offsets from 0
    _, offsets, data = texts.buffers()
    mapped = table[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.empty(0, np.uint8)
    texts = pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(mapped))
    lists = pc.ascii_split_whitespace(texts)
    ends = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return kept[ends - ends[0]], words.filter(full)


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    coded = words.dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(n) for n in names), np.uint64, len(names))
    return hashes[coded.indices.to_numpy()] if len(names) else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bits:
    """A fixed-size membership filter over 64-bit numbers: no misses, some false alarms."""

    SIZE = 1 << 24

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def collect(cls, df: DataFrame, column: str) -> Bits:
        """Of a column of longs. At most SIZE / 64 partial words come to the driver."""
        place = F.pmod(F.xxhash64(column), F.lit(cls.SIZE))
        parts = (
            df.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        )
        words = np.zeros(cls.SIZE // 64, np.int64)
        words[parts["w"].to_numpy()] = parts["b"].to_numpy()
        return cls(words.view(np.uint64))

    def has(self, values: np.ndarray) -> np.ndarray:
        place = (_xxhash64_long(values.astype(np.int64)).view(np.int64) % self.SIZE).astype(np.int64)
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0


def _xxhash64_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of a long column (public xxHash64 over eight bytes)."""
    p1, p2, p3, p4, p5 = (
        np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
    )
    rot = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    h = np.full(len(x), np.uint64(seed) + p5 + np.uint64(8), np.uint64)
    h ^= rot(x.view(np.uint64) * p2, 31) * p1
    h = rot(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))
