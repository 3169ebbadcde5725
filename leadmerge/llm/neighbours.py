"""Nearest neighbours by learned partitions: a balanced cut of a neighbour graph and a router."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from leadmerge.llm.common import stage

#: Distinct vectors the partitions are learnt from, at most (first by a hash of the vector).
SAMPLE = 16384
#: Of those, held out to choose how many partitions a query visits.
HELD_OUT = 1024
#: Vectors of a partition that are aimed at, and partitions at most.
CELL_ROWS, CELLS = 2048, 512
#: Neighbours of a vector in the graph.
DEGREE = 10
#: Rows, and queries, of a partition that are compared in one group.
ROW_BLOCK, QUERY_BLOCK = 8192, 1024
#: Parts of a class of equal vectors in which its smallest ids are found first.
SALT = 32


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, up to rounding."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0)


def _graph(spark, sample: np.ndarray, degree: int) -> np.ndarray:
    """The nearest ``degree`` others of each sampled vector, found by tasks over blocks of them."""
    sent, n = spark.sparkContext.broadcast(sample), len(sample)
    width = 256

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sent.value
        for batch in batches:
            for start in (batch.column("id").to_numpy() * width).tolist():
                stop = min(start + width, n)
                d = _squares(every[start:stop], every)
                d[np.arange(stop - start), np.arange(start, stop)] = np.inf
                best = np.argpartition(d, degree - 1, axis=1)[:, :degree]
                yield pa.RecordBatch.from_pydict({
                    "i": pa.array(np.repeat(np.arange(start, stop), degree)), "j": pa.array(best.ravel().astype(np.int64))
                })

    blocks = math.ceil(n / width)
    found = spark.range(0, blocks, 1, min(blocks, 64)).mapInArrow(near, "i long, j long").toArrow()
    out = np.zeros((n, degree), np.int64)
    i, j = found.column("i").to_numpy(), found.column("j").to_numpy()
    order = np.argsort(i, kind="stable")
    out[:] = j[order].reshape(n, degree)
    return out


def balanced_cut(neighbours: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """A part for each node of a neighbour graph: parts of equal size, few edges between them.

    Halves the nodes again and again: first by a smooth vector over the graph (steps of
    diffusion), cut at its median, then by swaps of nodes that have most of their
    neighbours on the other side, as long as the cut gets smaller.
    """
    rng = np.random.default_rng(seed)
    n, degree = neighbours.shape
    i, j = np.repeat(np.arange(n), degree), neighbours.ravel()
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    part = np.zeros(n, np.int64)
    for _ in range(int(math.log2(parts))):
        inside = part[i] == part[j]  # edges between halves made before don't count any more
        a, b = i[inside], j[inside]
        weight = np.bincount(a, minlength=n).astype(float)
        groups = int(part.max()) + 1
        total = np.maximum(np.bincount(part, weights=weight, minlength=groups), 1e-9)
        y = rng.standard_normal(n)
        for _ in range(60):
            y = 0.5 * y + 0.5 * np.bincount(a, weights=y[b], minlength=n) / np.maximum(weight, 1)
            y -= (np.bincount(part, weights=weight * y, minlength=groups) / total)[part]
            spread = np.sqrt(np.bincount(part, weights=y * y, minlength=groups))
            y /= np.maximum(spread, 1e-12)[part]
        order = np.lexsort((y, part))
        rank = np.empty(n, np.int64)
        first = np.searchsorted(part[order], np.arange(groups))
        rank[order] = np.arange(n) - first[part[order]]
        side = (rank >= np.bincount(part, minlength=groups)[part] // 2).astype(np.int64)
        cut = int((side[a] != side[b]).sum())
        for _ in range(20):
            other = np.bincount(a, weights=(side[a] != side[b]).astype(float), minlength=n)
            gain = 2 * other - weight + rng.uniform(0, 0.01, n)
            gain[rng.random(n) < 0.5] = -np.inf  # half of the nodes rest, so that neighbours do not trade places
            moved = side.copy()
            for g in range(groups):
                left, right = (np.flatnonzero((part == g) & (side == s)) for s in (0, 1))
                left, right = left[np.argsort(-gain[left])], right[np.argsort(-gain[right])]
                pairs = min(len(left), len(right))
                good = int((gain[left[:pairs]] + gain[right[:pairs]] > 0).sum())
                moved[left[:good]], moved[right[:good]] = 1, 0
            now = int((moved[a] != moved[b]).sum())
            if now < cut:
                side, cut = moved, now
        part = 2 * part + side
    return part


class _Net:
    """One hidden layer; gives the share of a vector's neighbours expected in each part."""

    @staticmethod
    def forward(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(x @ w["w1"] + w["b1"], 0)
        out = hidden @ w["w2"] + w["b2"]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return hidden, out / out.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, shares: np.ndarray, seed: int, hidden: int = 128, epochs: int = 40, batch: int = 256) -> dict[str, np.ndarray]:
    """Weights of a small network fitted to ``shares`` of neighbours per part (cross entropy, Adam)."""
    rng = np.random.default_rng(seed)
    center, scale = x.mean(axis=0), max(float(x.std()), 1e-30)
    z = (x - center) / scale
    d, parts = z.shape[1], shares.shape[1]
    w = {"w1": rng.standard_normal((d, hidden)) * math.sqrt(2 / d), "b1": np.zeros(hidden), "w2": rng.standard_normal((hidden, parts)) * math.sqrt(1 / hidden), "b2": np.zeros(parts)}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        rate = 0.003 * (1 - epoch / epochs) + 0.0002
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // batch)):
            h, p = _Net.forward(w, z[rows])
            slope = (p - shares[rows]) / len(rows)
            back = (slope @ w["w2"].T) * (h > 0)
            grads = {"w1": z[rows].T @ back, "b1": back.sum(axis=0), "w2": h.T @ slope, "b2": slope.sum(axis=0)}
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w | {"center": center, "scale": np.array(scale)}


def route(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of each part."""
    return _Net.forward(w, (x - w["center"]) / float(w["scale"]))[1]


def learn(spark, sample: np.ndarray, cells: int, target: float, top: int, seed: int) -> tuple[dict[str, np.ndarray], int]:
    """The router, and how many parts a query visits for ``target`` recall on held-out vectors."""
    held = min(HELD_OUT, len(sample) // 4)
    test, rest = sample[:held], sample[held:]
    neighbours = _graph(spark, rest, min(DEGREE, len(rest) - 1))
    part = balanced_cut(neighbours, cells, seed)
    shares = np.zeros((len(rest), cells))
    np.add.at(shares, (np.repeat(np.arange(len(rest)), neighbours.shape[1]), part[neighbours].ravel()), 1.0)
    np.add.at(shares, (np.arange(len(rest)), part), 2.0)
    w = train_router(rest, shares / shares.sum(axis=1, keepdims=True), seed)
    own = route(w, rest).argmax(axis=1)
    order = np.argsort(-route(w, test), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(cells)[None, :], axis=1)
    near = np.argpartition(_squares(test, rest), min(top, len(rest)) - 1, axis=1)[:, : min(top, len(rest))]
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return w, int(needed[min(math.ceil(target * len(needed)), len(needed)) - 1]) + 1


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pair; in units of the largest difference where squares would leave the range."""
    apart = x - y
    most = np.abs(apart).max(axis=1)
    unit = np.where((most > 1e150) | ((most < 1e-150) & (most > 0)), most, 1.0)
    return np.sqrt(((apart / unit[:, None]) ** 2).sum(axis=1)) * unit


def _nearest(rows: pa.Table, top: int) -> pa.RecordBatch:
    """The ``top`` nearest of each query among the rows of one group."""
    is_query = rows.column("query").is_valid().to_numpy(zero_copy_only=False)
    asked, held = rows.filter(pa.array(is_query)), rows.filter(pa.array(~is_query))
    out = ([], [], [])
    if asked.num_rows and held.num_rows:
        numbers = asked.column("query").to_numpy()
        q, x = (t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (asked, held))
        lists = held.column("ids").combine_chunks()
        starts, ids = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        starts = starts - starts[0]
        wanted = min(top + 1, len(x))
        with np.errstate(over="ignore"):
            x_squares = (x * x).sum(axis=1)
        for start in range(0, len(q), 128):
            part = q[start : start + 128]
            with np.errstate(all="ignore"):
                size = (part * part).sum(axis=1)[:, None] + x_squares
                rough = size - 2 * (part @ x.T)
                slack = 1e-11 * size
                high = np.where(np.isfinite(rough), rough + slack, np.inf)
                limit = np.partition(high, wanted - 1, axis=1)[:, wanted - 1]
                open_ = ~(rough - slack > limit[:, None])
            # What rounding leaves open, or overflows, is measured.
            i, j = np.nonzero(open_)
            for some in np.array_split(np.arange(len(i)), max(1, len(i) // 50_000)):
                exact = _distances(part[i[some]], x[j[some]])
                k = starts[j[some] + 1] - starts[j[some]]
                at = np.repeat(starts[j[some]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                query, score, found = np.repeat(numbers[start + i[some]], k), np.repeat(exact, k), ids[at]
                other = query != found
                for column, values in zip(out, (query[other], found[other], score[other])):
                    column.append(values)
    query, found, score = (np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64)))
    order = np.lexsort((found, score, query))
    query, found, score = query[order], found[order], score[order]
    first = np.searchsorted(query, query)
    best = np.arange(len(query)) - first < top
    return pa.RecordBatch.from_arrays([pa.array(query[best]), pa.array(found[best]), pa.array(score[best])], ["query_id", "vec_id", "score"])


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str], top: int) -> Iterator[pa.RecordBatch]:
    """The rows of a group follow each other; a group cut off by a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in columns])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            key = keys[:, start].tolist()
            if held and key != last:
                yield _nearest(pa.Table.from_batches(held), top)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield _nearest(pa.Table.from_batches(held), top)


def nearest_neighbours(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 10, every: int = 100,
    target: float = 0.98, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, seed: int = 12,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each row whose id ``every`` divides, the ``top`` nearest others.

    The neighbour graph of a bounded sample of distinct vectors is cut into parts of
    equal size; a small network learns where a vector's neighbours are. Every vector
    goes to its most probable part, a query visits the most probable ones, as many as
    find ``target`` of the neighbours of held-out sampled vectors. What it meets there
    is ranked by the Euclidean distance in double precision, ties by the smaller id. A
    part is cut into blocks of rows and of queries, each pair of which is one group.
    The neighbours are approximate, their scores and order are exact.

    Equal vectors are one candidate with their ``top + 1`` smallest ids. Vectors that are
    null, zero, of another length than most, or hold null or non-finite components take
    no part, nor do rows without an id. Ids should be unique integers: rows that repeat
    an id are the query itself to each other, and as a query the vector that comes first
    by its hash counts. A query has fewer rows only if there are fewer candidates or the
    parts it visits hold fewer. Other columns are not looked at; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    sound = (
        vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0) & F.col(id_col).isNotNull()
    )
    rows = vectors.filter(F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), vector.cast("array<double>").alias("v"), F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(1), vector).alias("h2")
    )
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == lengths["d"])
    # The smallest ids of each class of equal vectors: in salted parts first, so that no task gathers a large class.
    key = ["h1", "h2"]
    by_salt = Window.partitionBy(*key, "salt").orderBy("id")
    few = (
        rows.groupBy(*key, "id").agg(F.lit(1).alias("one")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)))
        .withColumn("k", F.row_number().over(by_salt)).filter(F.col("k") <= top + 1)
        .groupBy(*key).agg(F.slice(F.sort_array(F.collect_list("id")), 1, top + 1).alias("ids"))
    )
    distinct = rows.groupBy(*key).agg(F.first("v").alias("v"))
    classes = stage(distinct.join(few, key).select("h1", "h2", "ids", "v"), "vectors")
    n = classes.count()
    share = min(1.0, 1.2 * sample / max(n, 1))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "h1", "h2"), F.lit(1 << 40))
    picked = (
        classes.filter(drawn < int(share * (1 << 40))).select("v", drawn.alias("at"), "h1", "h2").orderBy("at", "h1", "h2").limit(sample).toArrow()
    )
    known = picked.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(picked.num_rows, -1)
    # Coordinates are compared as they are; only their common scale is taken out of the learning.
    scale = 2.0 ** -math.frexp(float(np.abs(known).max()))[1]
    fitted = len(known) - min(HELD_OUT, len(known) // 4)
    cells = 1 << max(0, min(round(math.log2(max(n / cell_rows, 4))), int(math.log2(CELLS)), int(math.log2(max(fitted / 32, 1)))))
    router, visits = learn(spark, known * scale, cells, target, top, seed) if cells > 1 else (None, 1)
    sent = spark.sparkContext.broadcast(router)

    def place(count: int):
        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if sent.value is None:
                    best = np.zeros((batch.num_rows, 1), np.int64)
                else:
                    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    with np.errstate(all="ignore"):
                        chance = np.nan_to_num(route(sent.value, np.clip(x * scale, -1e6, 1e6)))
                    best = np.argsort(-chance, axis=1, kind="stable")[:, :count]
                for c in range(best.shape[1]):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best[:, c])], [*batch.schema.names, "cell"])
        return placed

    asked = (
        rows.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min_by("v", F.struct("h1", "h2")).alias("v"))
    )
    index = stage(classes.select("ids", "v").mapInArrow(place(1), "ids array<long>, v array<double>, cell long"), "index")
    routed = stage(asked.select(F.col("id").alias("query"), "v").mapInArrow(place(visits), "query long, v array<double>, cell long"), "queries")
    per_cell = index.groupBy("cell").agg(F.ceil(F.count("*") / row_block).cast("int").alias("row_blocks")).join(
        routed.groupBy("cell").agg(F.ceil(F.count("*") / query_block).cast("int").alias("query_blocks")), "cell"
    )
    blocks = F.broadcast(per_cell)  # a row per part, of which there are CELLS at most
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = index.join(blocks, "cell").select(
        "cell", F.pmod(F.xxhash64("ids"), "row_blocks").cast("int").alias("rb"), spread("query_blocks").alias("qb"), F.lit(None).cast("long").alias("query"), "ids", "v"
    )
    right = routed.join(blocks, "cell").select(
        "cell", spread("row_blocks").alias("rb"), F.pmod(F.xxhash64("query"), "query_blocks").cast("int").alias("qb"), "query", F.lit(None).cast("array<long>").alias("ids"), "v"
    )
    group = ["cell", "rb", "qb"]
    met = left.unionAll(right).repartition(*group).sortWithinPartitions(*group)
    found = met.mapInArrow(lambda batches: _groups(batches, group, top), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
