"""Near duplicates among vectors: p-stable hash tables, then exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadmerge.llm.common import components, own_id, shown_id, stage

#: Width of a quantised projection of unit vectors.
WIDTH = 2.0
#: Rows of a bucket that one task compares with each other; larger ones are cut into blocks.
BLOCK = 4096


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors at this distance share one quantised projection."""
    r = width / distance
    phi = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(rows: int, cosine: float, recall: float) -> tuple[int, int]:
    """Projections per table and tables, from the number of rows alone.

    As many projections as leave about 150 unrelated vectors in a bucket, as many
    tables as find pairs at the threshold with ``recall``; nearer pairs are found more often.
    """
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    width = max(2, round(math.log(max(rows, 1) / 150) / -math.log(far))) if rows > 150 else 2
    return width, math.ceil(math.log(1 - recall) / math.log(1 - near**width))


def _compare(rows: pa.Table, cosine: float, tables: int, out: dict[str, list]) -> None:
    """Links inside one block pair of one bucket, counted in the first table that has the pair."""
    n = rows.num_rows
    if n < 2:
        return
    t, lo, hi = (int(rows.column(c)[0].as_py()) for c in ("t", "lo", "hi"))
    q = np.frombuffer(b"".join(rows.column("q").to_pylist()), np.int16).reshape(n, -1) / 32767.0
    keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int64).reshape(n, tables)
    rep, size, block = (rows.column(c).to_numpy() for c in ("rep", "n", "block"))
    # Rounding moves a component by half a step at most; the sum of both errors bounds the cosine's.
    slack = math.sqrt(q.shape[1]) / 32767.0
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = np.zeros(n, np.int64)
    for start in range(0, n, 512):
        part = q[start : start + 512] @ q.T
        a, b = np.nonzero(part >= cosine - slack)
        near = part[a, b] < cosine + slack
        a = a + start
        keep = a < b
        if lo != hi:
            keep &= block[a] != block[b]
        a, b, near = a[keep], b[keep], near[keep]
        if t:
            fresh = ~(keys[a, :t] == keys[b, :t]).any(axis=1)
            a, b, near = a[fresh], b[fresh], near[fresh]
        out["rep"] += rep[a[near]].tolist()
        out["other"] += rep[b[near]].tolist()
        out["links"] += [None] * int(near.sum())
        a, b = a[~near], b[~near]
        np.add.at(links, a, size[b])
        np.add.at(links, b, size[a])
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
    some = np.flatnonzero(links)
    out["rep"] += rep[some].tolist()
    out["other"] += [int(rep[find(i)]) for i in some.tolist()]
    out["links"] += links[some].tolist()


def embedding_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
    cosine: float = 0.9, recall: float = 0.975, block: int = BLOCK, seed: int = 5,
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, one row per input row.

    Pairs with a cosine (in double precision) of at least ``cosine`` that share a
    bucket in one of the tables are linked; each pair at the threshold is found with
    probability ``recall``, nearer ones with more. Equal vectors are one class before
    any comparison, links count their members. A bucket above ``block`` rows is cut
    into blocks and every pair of blocks compared in a task of its own, so no bucket is
    capped. Vectors that are null, zero, of another length than most, or hold null or
    non-finite components link with nothing and are their own component. Ids should be
    unique integers below 2**62; rows that repeat an id and a vector count as copies of
    each other. A row without an id is linked like any other, keeps its null, and shows
    the smallest id of its component, or null if no row there has one; of such a
    component its first vector by hash is kept. Other columns are not looked at; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    sound = (
        vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )
    rows = vectors.select(
        own_id(F.col(id_col), vector).alias("id"), vector.cast("array<double>").alias("v"),
        F.coalesce(sound, F.lit(False)).alias("ok"), F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(1), vector).alias("h2"),
    )
    lengths = rows.filter("ok").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return vectors.select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    d = lengths["d"]
    good = F.col("ok") & (F.size("v") == d)
    classes = stage(
        rows.filter(good).groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "emb"
    )
    width, tables = table_plan(classes.count(), cosine, recall)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        directions = rng.standard_normal((d, tables * width))
        offsets = rng.uniform(0, WIDTH, tables * width)
        odd = rng.integers(1, 2**62, width, dtype=np.int64) * 2 + 1
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(m, d)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            cells = np.floor((x @ directions + offsets) / WIDTH).astype(np.int64).reshape(m, tables, width)
            keys = (cells * odd).sum(axis=2)
            q = np.round(x * 32767).astype(np.int16)
            codes, marks = [r.tobytes() for r in q], [r.tobytes() for r in keys]
            for t in range(tables):
                yield pa.RecordBatch.from_pydict({
                    "t": pa.array(np.full(m, t, np.int32)), "key": pa.array(keys[:, t]), "rep": batch.column("rep"),
                    "n": batch.column("n"), "q": pa.array(codes, pa.binary()), "keys": pa.array(marks, pa.binary()),
                })

    hashed = classes.select("rep", "n", "v").mapInArrow(hash_rows, "t int, key long, rep long, n long, q binary, keys binary")
    ids = classes.select("rep", "n", "v").mapInArrow(
        lambda batches: (b.select(["t", "key"]) for b in hash_rows(batches)), "t int, key long"
    )
    large = ids.groupBy("t", "key").count().filter(F.col("count") > block).select(
        "t", "key", F.ceil(F.col("count") / block).alias("blocks")
    )
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    # Block b meets every block: as (min, max) of the two, with itself once.
    dealt = (
        hashed.join(large, ["t", "key"], "left").withColumn("block", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
        .select("t", "key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "rep", "n", "q", "keys")
    )
    bucket = ["t", "key", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            cuts = _run_starts(now, bucket)
            rest = now.slice(cuts[-1]) if len(cuts) else now
            out: dict[str, list] = {"rep": [], "other": [], "links": []}
            for i, j in zip(cuts[:-1], cuts[1:]):
                _compare(now.slice(i, j - i), cosine, tables, out)
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        if rest is not None:
            out = {"rep": [], "other": [], "links": []}
            _compare(rest, cosine, tables, out)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    found = stage(
        dealt.repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(compare, "rep long, other long, links long"), "emb"
    )
    # Pairs within rounding of the threshold are decided by the vectors themselves.
    sides = classes.select("rep", "n", "v")
    exact = (
        found.filter("links is null").select("rep", "other").distinct()
        .join(sides, "rep").join(sides.select(F.col("rep").alias("other"), F.col("n").alias("m"), F.col("v").alias("w")), "other")
        .filter(_cosine(F.col("v"), F.col("w")) >= cosine)
    )
    exact = stage(exact.select("rep", "other", "n", "m"), "emb")
    sums = (
        found.filter("links is not null").select("rep", "links")
        .unionAll(exact.select("rep", F.col("m").alias("links")))
        .unionAll(exact.select(F.col("other").alias("rep"), F.col("n").alias("links")))
        .groupBy("rep").agg(F.sum("links").alias("links"))
    )
    edges = found.filter("links is not null and rep <> other").select(F.col("rep").alias("u"), F.col("other").alias("v"))
    roots = components(edges.unionAll(exact.select(F.col("rep").alias("u"), F.col("other").alias("v"))), "emb")
    smallest = roots.groupBy("root").agg(F.min("node").alias("smallest"))
    member = roots.join(smallest, "root").select(F.col("node").alias("rep"), "smallest")
    per_class = classes.select("h1", "h2", "rep", "n").join(sums, "rep", "left").join(member, "rep", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("smallest", "rep").alias("component")
    )
    marked = rows.select("id", good.alias("good"), "h1", "h2")
    return marked.join(per_class, ["h1", "h2"], "left").select(
        shown_id(F.col("id")).alias(id_col),
        F.when(F.col("good"), F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        shown_id(F.when(F.col("good"), F.col("component")).otherwise(F.col("id"))).alias("component_id"),
        F.coalesce(~F.col("good") | (F.col("id") == F.col("component")), F.lit(True)).alias("kept"),
    )


def _run_starts(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Where the values of ``columns`` change; the first row included."""
    n = rows.num_rows
    if not n:
        return np.empty(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for c in columns:
        x = rows.column(c).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _cosine(a, b):
    """Cosine of two arrays in double precision; scaled first, so that no square leaves the range."""
    most = lambda v: F.array_max(F.transform(v, F.abs))
    scaled = lambda v: F.zip_with(v, F.array_repeat(most(v), F.size(v)), lambda x, m: x / m)
    dot = F.aggregate(F.zip_with(scaled(a), scaled(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(scaled(v), F.lit(0.0), lambda s, x: s + x * x))
    return dot / (norm(a) * norm(b))
