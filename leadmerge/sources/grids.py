"""Cell grids: header detection and row building.

A grid table has ``grid_id`` (file or tab), ``row_idx`` (order inside the grid) and
``cells`` (array of text, ragged).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadmerge.functions import is_blank
from leadmerge.operators.membership import attach
from leadmerge.session import cut_lineage

# Headers are broadcast up to this many bytes of text, after measuring them.
BROADCAST_BYTES = 32 << 20


def filled_cells(cells: Column) -> Column:
    """Number of cells that hold something."""
    return F.size(F.filter(cells, lambda c: ~is_blank(c)))


def drop_blank_rows(grid: DataFrame) -> DataFrame:
    """Rows with at least one filled cell."""
    return grid.where(F.exists("cells", lambda c: ~is_blank(c)))


def grid_headers(grid: DataFrame, min_cells: int = 1) -> DataFrame:
    """First row per grid with ``min_cells`` filled cells.

    One partially combined aggregate; the output has one row per grid.
    """
    candidates = grid.where(filled_cells(F.col("cells")) >= min_cells)
    first = F.min(F.struct("row_idx", "cells"))
    return candidates.groupBy("grid_id").agg(first.alias("_first")).select(
        "grid_id",
        F.col("_first.row_idx").alias("header_idx"),
        F.transform("_first.cells", lambda h: F.coalesce(h, F.lit(""))).alias("header"),
    )


def row_payload(header: Column, cells: Column) -> Column:
    """Map header -> cell: short rows padded with '', surplus cells dropped.

    A header that occurs twice keeps its last cell (session map policy).
    """
    padded = F.slice(
        F.concat(cells, F.array_repeat(F.lit(""), F.size(header))), F.lit(1), F.size(header)
    )
    return F.map_from_arrays(header, F.transform(padded, lambda c: F.coalesce(c, F.lit(""))))


def grid_rows(
    grid: DataFrame, min_cells: int = 1, *, checked: bool = False, max_header: int | None = None
) -> DataFrame:
    """Data rows below the detected header as ``(grid_id, row_idx, raw_payload)``.

    ``min_cells=1`` takes the first non-blank row as header, ``min_cells=2`` skips
    one-cell titles. With ``checked=True`` the headers are written to the
    checkpoint folder, measured and broadcast up to ``BROADCAST_BYTES``, so the
    rows are not shuffled; otherwise, and beyond it, rows and headers are joined by
    grid. A header of more than ``max_header`` cells fails the job.
    """
    headers, small = grid_headers(grid, min_cells), False
    if max_header is not None:
        wide = F.raise_error(F.lit(f"header has more than {max_header} columns")).cast("array<string>")
        headers = headers.withColumn("header", F.when(F.size("header") > max_header, wide).otherwise(F.col("header")))
    if checked:
        headers = cut_lineage(headers)
        width = F.octet_length(F.concat_ws("", "header")) + F.octet_length("grid_id") + 8 * F.size("header") + 64
        size = headers.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
        small = size <= BROADCAST_BYTES
    rows = drop_blank_rows(grid)
    body = rows.join(F.broadcast(headers), "grid_id") if small else attach(rows, headers, "grid_id")
    body = body.where(F.col("row_idx") > F.col("header_idx"))
    return body.select("grid_id", "row_idx", row_payload(F.col("header"), F.col("cells")).alias("raw_payload"))


def grid_counts(grid: DataFrame, first_cells: int = 3) -> DataFrame:
    """Per grid: rows with something in the first cells, and data rows below a header."""
    populated = F.count_if(filled_cells(F.slice("cells", 1, first_cells)) > 0)
    counts = grid.groupBy("grid_id").agg(populated.alias("populated_rows"))
    return counts.withColumn("data_rows", F.greatest(F.col("populated_rows") - 1, F.lit(0)))
