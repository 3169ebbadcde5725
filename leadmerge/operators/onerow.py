"""Combining one-row aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames in one row.

    The frames are stacked and folded by ``max`` over as many rows as there are
    frames, so no cross join is needed and every table is read once.
    """
    columns = [c for f in frames for c in f.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in columns])
