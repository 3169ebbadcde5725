"""N-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadmerge.llm.common import Bits, components, hash_words, mixed, most_frequent, own_id, shown_id, stage, texts_of, word_lists

#: Smallest n-grams of a set that look for a leader, and how many have to agree.
SMALLEST, AGREE = 8, 2
#: N-grams of this many sets or more come last in the global order ...
FREQUENT = 16
#: ... as far as a fixed-size filter holds them: of more, those of the most sets do.
FILTER_ROWS = 1 << 20
#: N-grams are counted by their highest 44 bits: the part they are dealt to, and 32 bits in it.
COUNT_PART_BITS, COUNT_BITS = 12, 44
#: N-grams that one task counts at once.
COUNT_ROWS = 4_000_000
#: N-grams that one fragment of the order brings together.
FRAGMENT_ROWS = 1_000_000
#: Parts of the order in which overlaps of candidates are counted, as shares of it.
PARTS = (0.0, 0.3, 1.0)
_TOP = 1 << 62  # n-grams are 62-bit hashes; this bit marks the frequent ones


def ngram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and n-gram hashes of the texts: each text's distinct ones in ascending order."""
    offsets, words = word_lists(texts)
    tokens, lengths = hash_words(words), np.diff(offsets)
    out, owners = [], []
    if len(tokens) >= n:
        h = np.full(len(tokens) - n + 1, n, np.uint64)
        for k in range(n):
            h = mixed(h * np.uint64(31) + tokens[k : len(tokens) - n + 1 + k])
        text = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(len(h)) + n <= offsets[1:][text[: len(h)]]
        out.append(h[inside])
        owners.append(text[: len(h)][inside])
    for length in range(1, n):  # a shorter text is one n-gram of its own length
        short = np.flatnonzero(lengths == length)
        h = np.full(len(short), length, np.uint64)
        for k in range(length):
            h = mixed(h * np.uint64(31) + tokens[offsets[short] + k])
        out.append(h)
        owners.append(short)
    grams = (np.concatenate(out) >> np.uint64(2)).astype(np.int64)
    owner = np.concatenate(owners)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return np.searchsorted(owner, np.arange(len(lengths) + 1)), grams


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("id").to_numpy()


def set_table(rows: DataFrame, n: int) -> DataFrame:
    """One row per text ``(id, sig, n, smallest)``, and the n-grams to count ``(part, grams)``.

    The n-grams of the distinct sets of a batch are packed into one value per part of the
    order, four bytes each.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("smallest", pa.list_(pa.int64())), ("part", pa.int32()), ("grams", pa.binary())])
        for batch in batches:
            offsets, grams = ngram_sets(texts_of(batch, "text"), n)
            counts = np.diff(offsets)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(grams.astype(np.uint64)), dtype=np.uint64)])
            sig = mixed(total[offsets[1:]] - total[offsets[:-1]] + counts.astype(np.uint64)).astype(np.int64)
            few = np.minimum(counts, SMALLEST)
            at = np.repeat(offsets[:-1] - (np.cumsum(few) - few), few) + np.arange(few.sum())
            m = len(sig)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_ids(batch)), pa.array(sig), pa.array(counts), _lists(np.concatenate([[0], np.cumsum(few)]), grams[at]),
                 pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
            # Each distinct set of the batch counts once.
            _, once = np.unique(sig, return_index=True)
            mask = np.zeros(m, bool)
            mask[once] = True
            held = np.sort(_counted(grams[np.repeat(mask, counts)]))
            parts, starts = np.unique(held >> 32, return_index=True)
            packed = (held & 0xFFFFFFFF).astype(np.uint32)
            blobs = [x.tobytes() for x in np.split(packed, starts[1:])] if len(parts) else []
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(parts), f.type) for f in list(schema)[:4]] + [pa.array(parts.astype(np.int32)), pa.array(blobs, pa.binary())], schema=schema)

    return rows.mapInArrow(make, "id long, sig long, n long, smallest array<long>, part int, grams binary")


def _counted(grams: np.ndarray) -> np.ndarray:
    """What of an n-gram's 62 bits is counted."""
    return grams >> (62 - COUNT_BITS)


def frequent_grams(packed: DataFrame, total: int) -> DataFrame:
    """``(gram, sets)``: the n-grams that ``FREQUENT`` sets or more hold, all sets counted.

    ``packed`` has the parts of :func:`set_table`; a part is cut further where it would
    be too large for one task. Copies of a set in other batches count again.
    """
    cut = max(1, -(-total // (COUNT_ROWS << COUNT_PART_BITS)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, shares, blobs = [], [], []
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("grams").to_pylist()):
                keys = np.frombuffer(blob, np.uint32)
                share = (keys.astype(np.int64) * cut) >> 32  # in order, so each share is a run
                found, starts = np.unique(share, return_index=True)
                parts += [part] * len(found)
                shares += found.tolist()
                blobs += [x.tobytes() for x in np.split(keys, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(shares, pa.int32()), pa.array(blobs, pa.binary())], ["part", "share", "grams"])

    def count(group: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([np.frombuffer(b, np.uint32) for b in group.column("grams").to_pylist()]))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sets = np.diff(np.append(starts, len(keys)))
        often = sets >= FREQUENT
        part = int(group.column("part")[0].as_py())
        return pa.table({"gram": (part << 32) | keys[starts[often]].astype(np.int64), "sets": sets[often].astype(np.int64)})

    dealt = packed.withColumn("share", F.lit(0)) if cut == 1 else packed.mapInArrow(deal, "part int, share int, grams binary")
    return dealt.groupBy("part", "share").applyInArrow(count, "gram long, sets long")


def overlaps(rows: DataFrame, pairs: DataFrame, n: int, parts: list[tuple[float, float]]) -> DataFrame:
    """``pairs(a, b, ...)`` with the n-grams both sets hold in ``parts`` of the order.

    Adds ``common``, and ``in_a``, ``in_b``: what each set has there. Only texts that
    occur in a pair are read further than their id. Each part's share of a set is a row
    of its own; partial counts are summed per pair.
    """
    ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id")))
    wanted = rows.sparkSession.sparkContext.broadcast(Bits.collect(ends, "id").words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits(wanted.value)
        for batch in batches:
            batch = batch.filter(pa.array(known.has(_ids(batch))))
            if not batch.num_rows:
                continue
            offsets, grams = ngram_sets(texts_of(batch, "text"), n)
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            for i, (low, high) in enumerate(parts):
                inside = (grams >= int(low * _TOP)) & (grams < int(high * _TOP))
                edges = np.searchsorted(owner[inside], np.arange(len(offsets)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(np.full(batch.num_rows, i, np.int32)), _lists(edges, grams[inside])], ["id", "part", "grams"])

    sides = rows.mapInArrow(cut, "id long, part int, grams array<long>")
    left = sides.select(F.col("id").alias("a"), "part", F.col("grams").alias("ga"))
    right = sides.select(F.col("id").alias("b"), "part", F.col("grams").alias("gb"))
    counted = (
        pairs.select("a", "b").join(left, "a").join(right, ["b", "part"])
        .select("a", "b", "part", F.size(F.array_intersect("ga", "gb")).alias("common"), F.size("ga").alias("in_a"), F.size("gb").alias("in_b"))
        .groupBy("a", "b", "part").agg(*[F.max(c).alias(c) for c in ("common", "in_a", "in_b")])  # repeated rows agree
        .groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("common", "in_a", "in_b")])
    )
    return pairs.join(counted, ["a", "b"])


def _linked(common, na, nb):
    """100 * intersection >= 75 * union, in whole numbers."""
    return 7 * common >= 3 * (na + nb)


def leader_links(rows: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Links of sets to a leader: the first set among those with the same smallest n-grams.

    One candidate per set and n-gram however many sets hold it; enough to join most of
    a group, so that the exact search only has to look between groups.
    """
    small = sets.select("rep", "n", F.explode("smallest").alias("gram"))
    leaders = small.groupBy("gram").agg(F.min("rep").alias("a"), F.count("*").alias("k")).filter("k > 1").select("gram", "a")
    pairs = (
        small.select("gram", F.col("rep").alias("b"), F.col("n").alias("nb")).join(leaders, "gram").filter("a <> b")
        .groupBy("a", "b").agg(F.count("*").alias("k"), F.max("nb").alias("nb")).filter(F.col("k") >= AGREE)
        .join(sets.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a")
        .filter("4 * least(na, nb) >= 3 * greatest(na, nb)").select("a", "b", "na", "nb")
    )
    pairs = stage(pairs, "pairs")
    first = stage(
        overlaps(rows, pairs, n, [PARTS[:2]]).filter(_linked(F.col("common") + F.least(F.col("na") - F.col("in_a"), F.col("nb") - F.col("in_b")), F.col("na"), F.col("nb"))),
        "pairs",
    ).withColumnRenamed("common", "before").drop("in_a", "in_b")
    rest = overlaps(rows, first, n, [PARTS[1:]])
    return rest.filter(_linked(F.col("before") + F.col("common"), F.col("na"), F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _fragment_pairs(group: pa.Table) -> pa.Table:
    """Pairs of sets of different groups with a common n-gram in one fragment, and how many."""
    tables, grams, base = [], [], 0
    owner = []
    for blob in group.column("sets").to_pylist():
        m = int(np.frombuffer(blob, np.int64, 1)[0])
        head = np.frombuffer(blob, np.int64, 4 * m, 8).reshape(4, m)
        tables.append(head[:3])
        grams.append(np.frombuffer(blob, np.int64, -1, 8 + 32 * m))
        owner.append(np.repeat(np.arange(m) + base, head[3]))
        base += m
    rep, n, comp = np.concatenate(tables, axis=1)
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(grams)))
    code, count = np.empty(0, np.int64), np.empty(0, np.int64)
    waiting: list[np.ndarray] = []

    def merge() -> None:
        nonlocal code, count, waiting
        more, k = np.unique(np.concatenate(waiting), return_counts=True)
        code, at = np.unique(np.concatenate([code, more]), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([count, k]), minlength=len(code)).astype(np.int64)
        waiting = []

    if len(starts):
        c = comp[owner]
        mixed_run = np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts)
        end = np.repeat(np.where(mixed_run, starts + lengths, 0), lengths)
        at, step = np.flatnonzero(end), 1
        while True:
            at = at[at + step < end[at]]
            if not len(at):
                break
            a, b = owner[at], owner[at + step]
            keep = (comp[a] != comp[b]) & (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b]))
            a, b = a[keep], b[keep]
            waiting.append(np.minimum(a, b) * base + np.maximum(a, b))
            step += 1
            if sum(map(len, waiting)) > 1_000_000:
                merge()
        if waiting:
            merge()
    x, y = rep[code // max(base, 1)], rep[code % max(base, 1)]
    return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "common": count})


def joined_groups(rows: DataFrame, late: DataFrame, n: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links between groups of sets made up of frequent n-grams, and ``late`` with the groups they join.

    For some n-grams a set of the largest group that holds the n-gram leads, another one
    in every turn, and each set of another group is compared with it. One candidate per
    set and n-gram; what is joined here need not be compared pair by pair.
    """
    some = late.filter(F.pmod(F.xxhash64("gram"), F.lit(4)) == 0)  # the same n-grams in all sets
    drawn = F.xxhash64("rep", "gram", F.lit(turn))
    per_group = some.groupBy("gram", "comp").agg(F.max_by("rep", drawn).alias("a"), F.count("*").alias("k"))
    leaders = per_group.groupBy("gram").agg(F.max_by("a", "k").alias("a"), F.count("*").alias("groups")).filter("groups > 1").select("gram", "a")
    facts = late.select("rep", "n", "comp", "often").distinct()
    side = lambda s: facts.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("comp").alias(f"c{s}"), F.col("often").alias(f"o{s}"))
    pairs = (
        some.select("gram", F.col("rep").alias("b")).join(leaders, "gram").filter("a <> b").select("a", "b").distinct()
        .join(side("a"), "a").join(side("b"), "b").filter((F.col("ca") != F.col("cb")) & _linked(F.least("oa", "ob"), F.col("na"), F.col("nb")))
    )
    pairs = stage(pairs.select("a", "b", "na", "nb", "ca", "cb"), "pairs")
    links = stage(overlaps(rows, pairs, n, [(0.0, 1.0)]).filter(_linked(F.col("common"), F.col("na"), F.col("nb"))).select("a", "b", "ca", "cb"), "links")
    merged = components(links.select(F.col("ca").alias("u"), F.col("cb").alias("v")), "links")
    moved = late.join(merged.select(F.col("node").alias("comp"), "root"), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")), stage(moved, "late")


def between_links(rows: DataFrame, sets: DataFrame, frequent: np.ndarray, n: int, fragments: int) -> DataFrame:
    """All links between sets of different groups, from ``sets(rep, n, comp)``.

    The global order is that of the hashes, frequent n-grams last. Linked sets share an
    n-gram among the first n/4 + 1 of each. These prefixes are cut into fragments of
    the order; every fragment counts the overlaps of its pairs, the counts are summed
    per pair, and pairs that cannot reach the threshold with what lies beyond the
    prefixes go. Frequent n-grams are in the prefix of few sets, those made up of
    them. All other n-grams of such a late set are in its prefix and so counted: of two
    late sets without any of those in common, only pairs whose frequent n-grams could
    be enough are joined, by n-gram, for n-grams that more than one group holds.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits(shared.value)
        for batch in batches:
            offsets, grams = ngram_sets(texts_of(batch, "text"), n)
            counts = np.diff(offsets)
            owner = np.repeat(np.arange(len(counts)), counts)
            late = known.has(_counted(grams))
            grams = np.where(late, grams | _TOP, grams)
            order = np.lexsort((grams, owner)) if late.any() else np.arange(len(grams))
            grams = grams[order]
            length = np.where(counts > 0, counts // 4 + 1, 0)
            kept = np.arange(len(grams)) - offsets[:-1][owner] < length[owner]
            ends = np.concatenate([[0], np.cumsum(length)])
            values = grams[kept]
            last = np.where(length > 0, values[np.maximum(ends[1:] - 1, 0)] if len(values) else 0, 0)
            often = np.bincount(owner, weights=late, minlength=len(counts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(length), pa.array(last), pa.array(often), _lists(ends, values)],
                ["rep", "p", "last", "often", "prefix"])

    found = stage(rows.mapInArrow(prefixes, "rep long, p long, last long, often long, prefix array<long>"), "prefixes")
    owned = found.join(sets, "rep")
    width = -(-_TOP // fragments)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.concat_arrays([batch.column("prefix")])
            grams = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            columns = np.stack([batch.column(c).to_numpy() for c in ("rep", "n", "comp")])
            common = grams < _TOP
            g, o = grams[common], owner[common]
            part = g // width
            order = np.argsort(part, kind="stable")
            parts, blobs = [], []
            for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
                own, k = np.unique(o[some], return_counts=True)
                by_owner = some[np.argsort(o[some], kind="stable")]
                parts.append(int(part[some[0]]))
                blobs.append(np.int64(len(own)).tobytes() + columns[:, own].tobytes() + k.astype(np.int64).tobytes() + g[by_owner].tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int64()), "sets": pa.array(blobs, pa.binary())})

    packed = owned.select("rep", "n", "comp", "prefix").mapInArrow(deal, "part long, sets binary")
    counted = packed.groupBy("part").applyInArrow(_fragment_pairs, "a long, b long, common long")
    # Two such sets can only be linked if each consists of frequent n-grams by three quarters.
    late = stage(
        owned.filter((F.col("last") >= _TOP) & (4 * F.col("often") >= 3 * F.col("n")))
        .select("rep", "n", "comp", "often", F.explode(F.filter("prefix", lambda g: g >= _TOP)).alias("gram")).distinct(), "late",
    )
    early, late = joined_groups(rows, late, n, 1)
    more, late = joined_groups(rows, late, n, 2)
    open_grams = late.groupBy("gram").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("gram")
    late = late.join(open_grams, "gram")
    held = late.groupBy("rep", "n", "comp", "often").agg(F.sort_array(F.collect_list("gram")).alias("grams"))
    held = held.withColumn("gram", F.explode("grams"))
    one = held.select("gram", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("often").alias("oa"), F.col("grams").alias("ga"))
    two = held.select("gram", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("often").alias("ob"), F.col("grams").alias("gb"))
    late_pairs = (
        one.join(two, (one["gram"] == two["gram"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
                 & _linked(F.least("oa", "ob"), F.col("na"), F.col("nb"))
                 & (one["gram"] == F.array_min(F.array_intersect("ga", "gb"))))  # each pair once
        .select("a", "b", F.lit(0).cast("long").alias("common"))
    )
    totals = counted.unionAll(late_pairs).groupBy("a", "b").agg(F.sum("common").alias("common"))
    totals = stage(totals, "pairs")
    ends = totals.select(F.col("a").alias("rep")).unionAll(totals.select(F.col("b").alias("rep"))).distinct()
    facts = stage(found.select("rep", "p", "last", "often").join(ends, "rep").join(sets.select("rep", "n"), "rep").distinct(), "facts")
    side = lambda s: facts.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("p").alias(f"p{s}"), F.col("last").alias(f"l{s}"), F.col("often").alias(f"o{s}"))
    # Common n-grams up to the nearer prefix end are counted, but for the frequent ones;
    # beyond it one set has this many left.
    left = (
        F.when((F.col("la") >= _TOP) & (F.col("lb") >= _TOP), F.least("oa", "ob"))
        .when(F.col("la") <= F.col("lb"), F.col("na") - F.col("pa")).otherwise(F.col("nb") - F.col("pb"))
    )
    pairs = totals.join(side("a"), "a").join(side("b"), "b").filter(_linked(F.col("common") + left, F.col("na"), F.col("nb")))
    pairs = stage(pairs.select("a", "b", "na", "nb"), "pairs")
    full = overlaps(rows, pairs, n, [PARTS[:2], PARTS[1:]])
    found = full.filter(_linked(F.col("common"), F.col("na"), F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return found.unionAll(early).unionAll(more)


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """``(id_col, n_shingles, component_id)``, one row per input row.

    A text's set holds its distinct runs of ``n`` words (A-Z in lower case, cut at ASCII
    white space); a shorter text is one run. Sets with a Jaccard similarity of 0.75 or
    more are linked, exactly, and texts reachable by links share the smallest of their
    ids. Equal sets are one class before any comparison. N-grams and sets are compared
    by 62-bit and 64-bit hashes. Null and empty texts have no set and are their own
    component. Ids should be unique integers below 2**62: rows that repeat an id have to
    repeat its text. A row without an id is linked like any other, keeps its null, and
    shows the smallest id of its component, or null if no row there has one. Other
    columns are not looked at; an empty table gives no rows.
    """
    named = jaccard_groups(docs.select(own_id(F.col(id_col), F.col(text_col)).alias("id"), F.col(text_col).alias("text")), n)
    return named.select(shown_id(F.col("id")).alias(id_col), "n_shingles", shown_id(F.col("component_id")).alias("component_id"))


def jaccard_groups(rows: DataFrame, n: int = 5) -> DataFrame:
    """``(id, n_shingles, component_id)`` of ``rows(id, text)`` without null ids."""
    made = stage(set_table(rows, n), "sets")
    texts = made.filter("sig is not null")
    sets = stage(
        texts.filter("n > 0").groupBy("sig")
        .agg(F.min("id").alias("rep"), F.min("n").alias("n"), *[F.min(F.get("smallest", F.lit(i))).alias(f"m{i}") for i in range(SMALLEST)])
        .select("sig", "rep", "n", F.array_compact(F.array(*[f"m{i}" for i in range(SMALLEST)])).alias("smallest")), "sets",
    )
    first = stage(leader_links(rows, sets, n), "links")
    groups = components(first, "links")
    total = texts.agg(F.sum("n")).first()[0] or 0
    packed = made.filter("part is not null").select("part", "grams")
    often = most_frequent(stage(frequent_grams(packed, total), "often"), "sets", FILTER_ROWS)
    frequent = Bits.collect(often, "gram").words
    grouped = stage(
        sets.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", F.coalesce("root", "rep").alias("comp")), "sets"
    )
    more = between_links(rows, grouped, frequent, n, max(1, -(-total * 2 // 7 // FRAGMENT_ROWS)))
    roots = stage(components(first.unionAll(more), "links"), "links")
    smallest = roots.join(roots.groupBy("root").agg(F.min("node").alias("smallest")), "root").select(F.col("node").alias("rep"), "smallest")
    own = F.coalesce("smallest", "rep", "id")
    return (
        texts.select("id", "sig", "n").join(sets.select("sig", "rep"), "sig", "left").join(smallest, "rep", "left")
        .select("id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    )
