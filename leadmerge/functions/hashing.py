"""Row identity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the byte between the sorted header=value pairs.
PAIR_SEPARATOR = "\x01"


def row_hash(source: Column, payload: Column) -> Column:
    """sha256 over the source name and all cells in header order.

    A null cell prints as the text ``null``; file scans turn missing cells into
    empty text before they get here.
    """
    entries = F.sort_array(F.map_entries(payload))  # native order, no comparator lambda
    pairs = F.transform(
        entries,
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))),
    )
    text = F.concat(source, F.lit("|"), F.array_join(pairs, PAIR_SEPARATOR))
    return F.sha2(text, 256)
