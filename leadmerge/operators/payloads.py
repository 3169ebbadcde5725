"""Merging the raw cells of one master."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from leadmerge.functions import is_blank


def merge_payloads(
    rows: DataFrame,
    key: str = "dedup_key",
    payload: str = "raw_payload",
    order: Sequence[str] = ("received_at", "source_record_id"),
) -> DataFrame:
    """Per master, for each header the first non-blank cell in ``order``.

    The first aggregate reduces to one value per master and header before the
    shuffle; the second gathers at most one entry per header. Headers come in the
    order in which the rows introduce them, so of two that trim to the same text the
    later one still counts as the later.
    """
    cells = rows.select(key, *order, F.posexplode(payload).alias("_place", "_header", "_cell"))
    at = F.struct(*order, "_place")
    full = ~is_blank(F.col("_cell"))
    first = cells.groupBy(key, "_header").agg(
        F.min(at).alias("_at"), F.min_by(F.when(full, F.col("_cell")), F.when(full, at)).alias("_cell")
    ).where("_cell is not null")
    entries = F.sort_array(F.collect_list(F.struct("_at", "_header", "_cell")))
    pairs = F.transform(entries, lambda e: F.struct(e["_header"], e["_cell"]))
    return first.groupBy(key).agg(F.map_from_entries(pairs).alias("merged_payload"))
