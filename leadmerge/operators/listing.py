"""Filtered and paged list of masters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from leadmerge.contract import BOTH, PAGE_SIZE_DEFAULT, PAGE_SIZE_MAX, SOURCES
from leadmerge.functions import on_date


def master_filters(date: str | None = None, status: str | None = None) -> Column | None:
    """Predicates on master columns, joined by AND; null when there are none."""
    terms: list[Column] = []
    if date:
        terms.append(on_date(F.col("created_at"), date))
    if status:
        terms.append(F.col("status") == status.upper())
    return reduce(lambda a, b: a & b, terms) if terms else None


def exported_only(masters: DataFrame, exports: DataFrame, wanted: bool) -> DataFrame:
    """Masters with (or without) an export mark."""
    marks = exports.select("dedup_key").distinct()
    return masters.join(marks, "dedup_key", "left_semi" if wanted else "left_anti")


def with_exported(masters: DataFrame, exports: DataFrame) -> DataFrame:
    """Adds the boolean ``exported``. Marks may repeat; they are made distinct
    before the join."""
    marks = exports.select("dedup_key").distinct().withColumn("exported", F.lit(True))
    return masters.join(marks, "dedup_key", "left").withColumn(
        "exported", F.coalesce("exported", F.lit(False))
    )


def collect_sources(links: DataFrame, known: Sequence[str] = SOURCES) -> DataFrame:
    """Sorted distinct source names per master, out of the known names.

    One flag per name instead of collected sets: the flags are combined before the
    shuffle in a hash aggregate.
    """
    flags = [F.max(F.col("source") == name).alias(f"_s{i}") for i, name in enumerate(sorted(known))]
    names = [F.when(F.col(f"_s{i}"), F.lit(name)) for i, name in enumerate(sorted(known))]
    per_master = links.where(F.col("source").isin(*known)).groupBy("dedup_key").agg(*flags)
    return per_master.select("dedup_key", F.array_compact(F.array(*names)).alias("sources"))


def source_filter(sources: Column, wanted: str | None, known: Sequence[str] = SOURCES) -> Column | None:
    """Predicate on the collected sources; an unknown name filters nothing."""
    name = (wanted or "").upper()
    if name == BOTH:
        return F.size(sources) == 2
    if name in known:
        return F.array_contains(sources, name)
    return None


def lead_list(
    masters: DataFrame,
    links: DataFrame,
    exports: DataFrame,
    *,
    date: str | None = None,
    status: str | None = None,
    exported: bool | None = None,
    source: str | None = None,
    mark_exported: bool = True,
    known: Sequence[str] = SOURCES,
) -> DataFrame:
    """Masters with ``sources`` and ``exported`` after all filters, unordered.

    Master filters run before any join; links are reduced to one row per master
    before they are joined. ``mark_exported=False`` leaves the mark out, for totals.
    """
    where = master_filters(date, status)
    rows = masters if where is None else masters.where(where)
    if exported is not None:
        rows = exported_only(rows, exports, exported)
    sourced = collect_sources(links, known)
    having = source_filter(F.col("sources"), source, known)
    rows = rows.join(sourced if having is None else sourced.where(having), "dedup_key")
    if not mark_exported:
        return rows
    if exported is not None:
        return rows.withColumn("exported", F.lit(exported))
    return with_exported(rows, exports)


def page_bounds(page: int | None = None, page_size: int | None = None, max_size: int = PAGE_SIZE_MAX) -> tuple[int, int]:
    """Page number from 1 and page size within its limits."""
    return max(int(page or 1), 1), min(max(int(page_size or PAGE_SIZE_DEFAULT), 1), max_size)


def page_of(
    rows: DataFrame,
    page: int | None = None,
    page_size: int | None = None,
    *,
    order: Sequence[Column] | None = None,
    max_size: int = PAGE_SIZE_MAX,
) -> DataFrame:
    """One page, newest first. Each task keeps only the rows up to the page end;
    for pages far behind use :func:`page_after`."""
    number, size = page_bounds(page, page_size, max_size)
    order = order or (F.desc("created_at"), F.desc("dedup_key"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(rows: DataFrame, created_at, dedup_key: str, page_size: int | None = None) -> DataFrame:
    """The page behind a known last row; costs the same at any depth."""
    _, size = page_bounds(1, page_size)
    at = F.lit(created_at).cast("timestamp")
    behind = (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("dedup_key") < dedup_key))
    return rows.where(behind).orderBy(F.desc("created_at"), F.desc("dedup_key")).limit(size)


def page_summary(rows: DataFrame, page: int | None = None, page_size: int | None = None) -> DataFrame:
    """One row: page, page_size, total, total_pages."""
    number, size = page_bounds(page, page_size)
    total = rows.agg(F.count("*").alias("total"))
    return total.select(
        F.lit(number).cast("bigint").alias("page"),
        F.lit(size).cast("bigint").alias("page_size"),
        "total",
        F.ceil(F.col("total") / size).alias("total_pages"),
    )
