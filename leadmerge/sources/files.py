"""Delimited files of unknown header."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from leadmerge.functions.text import bind
from leadmerge.sources.blocks import pieces, records
from leadmerge.sources.grids import grid_rows

MAX_COLUMNS = 64


def split_record(text: str) -> list[str]:
    """Cells of one record: commas count outside quotes, a doubled quote inside is one.

    A quote opens or closes wherever it stands, carriage returns outside quotes go.
    """
    cells = [""]
    parts = text.split('"')
    for i, part in enumerate(parts):
        if i % 2:
            cells[-1] += part
        elif not part and 0 < i < len(parts) - 1:
            cells[-1] += '"'
        else:
            first, *more = part.replace("\r", "").split(",")
            cells[-1] += first
            cells += more
    return cells


def _record_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        quoted = pc.match_substring(text, '"').to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(pc.replace_substring(text.filter(pa.array(~quoted)), "\r", ""), ",")
        parsed = pa.array([split_record(t) for t in text.filter(pa.array(quoted)).to_pylist()], pa.list_(pa.string()))
        place = np.argsort(np.argsort(quoted, kind="stable"), kind="stable")
        cells = pa.concat_arrays([plain, parsed]).take(pa.array(place))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "block", "row")), cells], ["file", "block", "row", "cells"])


def read_cells(
    spark: SparkSession,
    path: str | list[str],
    *,
    max_columns: int = MAX_COLUMNS,
    multiline: bool = True,
) -> DataFrame:
    """Delimited files as a cell grid, one grid per file.

    Quoted fields may hold commas, doubled quotes and line breaks. Every cell keeps its
    place: empty ones are '', missing ones at the end of a row are left out. Large files
    are read by many tasks, with line breaks in cells too: a line break ends a record if
    an even number of quotes stands before it, or if it is the file's last character.
    ``multiline=False`` takes Spark's own
    reader for files without line breaks in cells: one pass less; there quotes in the
    middle of an unquoted field are kept, empty cells at the end of a row count as
    missing, and cells beyond ``max_columns`` + 1 are not read.
    """
    if multiline:
        found, *_ = records(pieces(spark, path, "\n"), "\n")
        cells = found.select("file", "block", "row", "text").mapInArrow(_record_cells, "file string, block long, row long, cells array<string>")
        return cells.select(F.col("file").alias("grid_id"), F.struct("block", "row").alias("row_idx"), "cells")
    names = [f"_c{i}" for i in range(max_columns + 1)]
    # One column more than is read: to a reader that picks columns a short row is no
    # malformed record, each of which would cost an exception.
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_beyond"]])
    lines = (
        spark.read.schema(schema)
        .option("quote", '"')
        .option("escape", '"')
        .option("maxColumns", max(20480, max_columns + 1))
        .csv(path)
    )
    # The reader gives null for a missing and for an unquoted empty cell.
    filled = lambda cell, i: F.when(cell.isNotNull(), i + 1)
    width = lambda row: F.coalesce(F.array_max(F.transform(row, filled)), F.lit(0))
    cells = bind(F.array(*names), lambda row: F.transform(F.slice(row, F.lit(1), width(row)), lambda c: F.coalesce(c, F.lit(""))))
    return lines.select(
        F.col("_metadata.file_path").alias("grid_id"),
        # Splits of one file may be read in any order: block first, then row.
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("row_idx"),
        cells.alias("cells"),
    )


def read_rows(
    spark: SparkSession,
    path: str | list[str],
    source: str,
    *,
    min_cells: int = 1,
    max_columns: int = MAX_COLUMNS,
    **options,
) -> DataFrame:
    """Whole files of one source as ingest items ``(source, raw_payload)``.

    A header wider than ``max_columns`` fails the job; surplus cells of a data row are
    dropped.
    """
    cells = read_cells(spark, path, max_columns=max_columns, **options)
    rows = grid_rows(cells, min_cells, checked=True, max_header=max_columns)
    return rows.select(F.lit(source).alias("source"), "raw_payload")
