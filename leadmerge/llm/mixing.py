"""Mix sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadmerge.llm.common import WORD, stage

#: Rows folded one after the other in one place; also the fan-in of the reduction tree.
FAN_IN = 64


def with_running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Global row number ``pos`` from 0, and for each of ``sums`` the total up to the row.

    Rows are range partitioned by ``order`` (which has to be unique) and numbered
    inside each partition; only one row per partition is brought together for the
    offsets.
    """
    from pyspark.sql import Window

    inner = Window.partitionBy("_part").orderBy(*order)
    local = stage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix")
    numbered = local.withColumns(
        {"_pos": F.row_number().over(inner) - 1}
        | {f"_{c}": F.sum(c).over(inner.rowsBetween(Window.unboundedPreceding, 0)) for c in sums}
    )
    parts = local.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t{c}") for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_s{c}") for c in sums],
    )
    kept = [F.col(c) for c in rows.columns if c not in sums]
    return numbered.join(offsets, "_part").select(
        *kept, *sums, (F.col("_pos") + F.col("_n0")).alias("pos"),
        *[(F.col(f"_{c}") + F.col(f"_s{c}")).alias(f"sum_{c}") for c in sums],
    )


def source_targets(
    sizes: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """``(source, source_size, n_rows, target)`` for ``sizes(source, size)``.

    Sources by code point, null last, take ``weights`` in turn and split ``share`` of
    all sizes; no target is above ``cap`` times its source, the excess is shared again
    by weight. With the sources in order of cap / weight, the level at which the
    targets meet the total is the largest of (total - caps before) / (weights from
    here on), so no loop is needed. Sources without words get 0.
    """
    per = stage(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "mix"
    )
    ranked = with_running(per, [F.col("source").isNull(), F.col("source")], [])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    limits = stage(
        ranked.select("source", "source_size", "n_rows", "pos", weight.alias("w"),
                      (F.col("source_size") * float(cap)).alias("most")), "mix",
    )
    totals = limits.agg(
        (F.sum("source_size") * float(share)).alias("total"), F.sum("w").alias("all_w")
    )
    filled = with_running(
        limits.select("pos", "w", "most").withColumnRenamed("pos", "rank"), [F.col("most") / F.col("w"), F.col("rank")],
        ["w", "most"],
    )
    level = filled.join(F.broadcast(totals)).agg(
        F.max(
            (F.col("total") - F.col("sum_most") + F.col("most")) / (F.col("all_w") - F.col("sum_w") + F.col("w"))
        ).alias("level")
    )  # one row each: totals and level
    return limits.join(F.broadcast(level)).select(
        "source", "source_size", "n_rows",
        F.greatest(F.lit(0.0), F.least(F.col("most"), F.col("level") * F.col("w"))).alias("target"),
    )


def _uniform(*parts: Column) -> Column:
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)


def _fold(rows: Column, level: int, seed: int) -> Column:
    """Pivotal rounding along an array of ``(id, size, base, p, key)``.

    The open row meets the next one; words move between the two, in random direction
    but without bias, until one probability is 0 or 1. The result holds the decided
    rows and the open one.
    """
    def step(state: Column, row: Column) -> Column:
        a = state["open"]
        give = F.struct(
            # Words that can move from a to row, and from row to a.
            F.least(a["p"] * a["size"], (1.0 - row["p"]) * row["size"]).alias("ab"),
            F.least(row["p"] * row["size"], (1.0 - a["p"]) * a["size"]).alias("ba"),
            _uniform(a["key"], row["key"], F.lit(level), F.lit(seed)).alias("u"),
        )

        def moved(g: Column) -> Column:
            # Towards row with probability ba / (ab + ba): no bias.
            forth = g["u"] * (g["ab"] + g["ba"]) < g["ba"]
            pa = F.when(forth, a["p"] - g["ab"] / a["size"]).otherwise(a["p"] + g["ba"] / a["size"])
            pb = F.when(forth, row["p"] + g["ab"] / row["size"]).otherwise(row["p"] - g["ba"] / row["size"])
            # Which of the two became whole is known from what limited the move.
            a_whole = F.when(forth, a["p"] * a["size"] <= (1.0 - row["p"]) * row["size"]).otherwise(
                (1.0 - a["p"]) * a["size"] <= row["p"] * row["size"]
            )
            done_a = a.withField("p", F.round(pa))
            done_b = row.withField("p", F.round(pb))
            return F.struct(
                F.when(a_whole, row.withField("p", pb)).otherwise(a.withField("p", pa)).alias("open"),
                F.concat(state["done"], F.array(F.when(a_whole, done_a).otherwise(done_b))).alias("done"),
            )

        return F.element_at(F.transform(F.array(give), moved), 1)

    start = F.struct(F.element_at(rows, 1).alias("open"), F.slice(rows, 1, 0).alias("done"))
    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), start, step)


def pivotal_round(rows: DataFrame, *, seed: int = 11, fan_in: int = FAN_IN) -> DataFrame:
    """Whole copies for ``rows(source, n_rows, id, size, copies, key)``; ``copies`` is fractional.

    Each source's words are kept: every step moves words between two rows of the
    source. Groups of about ``fan_in`` rows, set by the hash in ``key``, are folded
    where they lie; the one open row of each group goes to the next level, until every
    source has a single group. The open row of that one takes the part of its words that
    is left, so a source meets its target to a word. A source with any share of the rows is
    spread over as many groups as it needs. Returns ``(source, id, size, taken)``.
    """
    whole = F.floor("copies")
    p = F.col("copies") - whole
    base = rows.select("source", "n_rows", "id", "size", "key", whole.alias("base"), p.alias("p"))
    settled = [base.filter("p = 0 or size = 0").select("source", "id", "size", (F.col("base") * F.col("size")).alias("taken"))]
    # Equal rows need no chance: so many of them are taken whole, and one is left with the rest.
    classes = base.filter("p > 0 and size > 0").groupBy("source", "id", "size", "key").agg(
        *[F.max(c).alias(c) for c in ("n_rows", "base", "p")], F.count("*").alias("m")
    )
    classes = classes.withColumn("k", F.floor(F.col("m") * F.col("p"))).withColumn("rest", F.col("m") * F.col("p") - F.col("k"))
    closed = classes.withColumn("n", F.col("m") - (F.col("rest") > 0).cast("int")).filter("n > 0")
    step = 1 << 16  # an array for every so many rows, however many are equal
    some = closed.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))))
    every = some.withColumn("i", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + step, F.col("n")) - 1)))
    settled.append(every.select("source", "id", "size", ((F.col("base") + (F.col("i") < F.col("k")).cast("int")) * F.col("size")).alias("taken")))
    now = classes.filter("rest > 0").select("source", "n_rows", "id", "size", "key", "base", F.col("rest").alias("p"))
    most = rows.agg(F.max("n_rows")).first()[0] or 1
    groups = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / fan_in))
    level = 0
    while True:
        place = F.when(F.lit(most <= fan_in), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(F.col("key"), F.lit(level)), groups)
        )
        item = F.struct("key", "id", F.col("size").cast("double").alias("size"), "base", "p")
        folded = (
            now.withColumn("place", place)
            .groupBy("source", "place").agg(F.max("n_rows").alias("n_rows"), F.sort_array(F.collect_list(item)).alias("rows"))
            .select("source", "n_rows", _fold(F.col("rows"), level, seed).alias("f"))
        )
        folded = stage(folded, "mix")
        done = folded.select("source", F.explode("f.done").alias("r"))
        settled.append(done.select("source", "r.id", F.col("r.size").cast("long").alias("size"),
                                   ((F.col("r.base") + F.col("r.p")) * F.col("r.size")).cast("long").alias("taken")))
        level += 1
        rest = folded.select("source", F.ceil(F.col("n_rows") / fan_in).alias("n_rows"), "f.open.*")
        if most <= fan_in:
            settled.append(rest.select("source", "id", F.col("size").cast("long").alias("size"),
                                       F.round((F.col("base") + F.col("p")) * F.col("size")).cast("long").alias("taken")))
            break
        most = -(-most // fan_in)
        now = rest
    out = settled[0]
    for more in settled[1:]:
        out = out.unionAll(more)
    return out


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 11,
) -> DataFrame:
    """How many words of each row a mix with the given source weights takes.

    Returns ``(id_col, size, source_size, target, taken)``, one row per input row.
    ``size`` is the number of words, ``taken`` is 0 to ``cap`` whole copies of it, but for
    one row per source that takes a part. A null text has size 0 and is not taken; null sources are one source, last in order;
    null ids are allowed. Of rows with the same id and text as many are taken whole as
    their share says, and one is rounded with the others. An
    empty table gives an empty result. Other columns are not looked at. Same rows, same
    seed: same result, whatever the partitions.
    """
    sizes = stage(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"),
        ), "mix",
    )
    targets = stage(source_targets(sizes, weights=weights, share=share, cap=cap), "mix")
    named = targets.withColumnRenamed("source", "s")
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "n_rows", "id", "size", "key",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("copies"),
    )
    taken = pivotal_round(rows, seed=seed)
    return taken.join(named, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken"
    )
