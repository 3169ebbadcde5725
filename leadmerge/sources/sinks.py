"""CSV output of display rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadmerge.contract import DISPLAY_HEADERS
from leadmerge.functions.text import csv_field

CSV_COLUMNS = (*DISPLAY_HEADERS, "source")


def csv_lines(rows: DataFrame, columns=CSV_COLUMNS) -> DataFrame:
    """One text line per row: cells on one physical line, quoted only when needed."""
    cells = [csv_field(F.col(f"`{c}`")) for c in columns]
    return rows.select(F.concat_ws(",", *cells).alias("line"))


def write_csv(rows: DataFrame, path: str, columns=CSV_COLUMNS, *, limit: int | None = None) -> None:
    """Write display rows as CSV part files, each starting with the header.

    Part files follow the order of ``rows``. All rows are written unless a ``limit`` is
    asked for, which takes the first ones, so ``rows`` should be sorted. The cells are flattened
    here; quoting is left to Spark's writer, which quotes only where needed.
    """
    from leadmerge.functions.text import one_line

    chosen = rows if limit is None else rows.limit(limit)
    flat = chosen.select(*[one_line(F.col(f"`{c}`")).alias(c) for c in columns])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)
