"""Business name and postcode keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from leadmerge.contract import BUSINESS_STOPWORDS
from leadmerge.functions.text import deaccent, empty_to_null, remove_spaces


def business_key(name: Column, stopwords: Sequence[str] = BUSINESS_STOPWORDS) -> Column:
    """Lower-case ASCII letters and digits of the name without filler words."""
    words = F.split(F.lower(deaccent(name)), r"[^a-z0-9]+")
    kept = F.filter(words, lambda w: ~w.isin(*stopwords))
    return F.coalesce(F.array_join(kept, ""), F.lit(""))


def postcode_key(postcode: Column) -> Column:
    """Upper case without white space."""
    return F.coalesce(remove_spaces(F.upper(postcode)), F.lit(""))


def fingerprint(
    name: Column, postcode: Column, stopwords: Sequence[str] = BUSINESS_STOPWORDS
) -> Column:
    """``business|postcode`` when both parts say something, else null."""
    business = empty_to_null(business_key(name, stopwords))
    place = empty_to_null(postcode_key(postcode))
    return F.concat(business, F.lit("|"), place)
