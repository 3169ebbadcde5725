"""UK phone numbers to one spelling (E.164)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadmerge.functions.text import first_match

# One international or trunk prefix, then zeros, then nine or ten digits. The
# prefix group is atomic and the zeros possessive: a prefix that was recognised
# is never given back to make a too short number fit. "44" counts as a prefix
# only when ten more characters follow.
_NATIONAL = r"^(?>\+44|0044|44(?=.{10})|0|)0*+([0-9]{9,10})$"


def normalize_uk_phone(c: Column) -> Column:
    """``+44`` and the national number, or null if it is not a UK number."""
    dialled = F.regexp_replace(c, r"[^0-9+]", "")
    return F.concat(F.lit("+44"), first_match(dialled, _NATIONAL, 1))


def first_uk_phone(*candidates: Column) -> Column:
    """The first candidate that normalises."""
    return F.coalesce(*[normalize_uk_phone(c) for c in candidates])


def match_key(*candidates: Column) -> Column:
    """Cross-source key of a lead: its normalised phone, null when it has none."""
    return first_uk_phone(*candidates)
