"""Numbers from loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadmerge.functions.text import jtrim

_NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(c: Column) -> Column:
    """Text as a finite number; anything else, and infinity, is 0."""
    text = jtrim(c.cast("string"))
    value = F.when(text.rlike(_NUMERIC), text.try_cast("double"))
    finite = F.when(F.abs(value) < F.lit(float("inf")), value)
    return F.coalesce(finite, F.lit(0.0))


def clamp(c: Column, low: float, high: float) -> Column:
    """Number limited to ``low``..``high``."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), number(c)))
