"""Scalar functions as Column expressions."""

from leadmerge.functions.hashing import row_hash
from leadmerge.functions.names import business_key, fingerprint, postcode_key
from leadmerge.functions.numbers import clamp
from leadmerge.functions.phones import first_uk_phone, match_key, normalize_uk_phone
from leadmerge.functions.text import (
    blank_to_null, clean_email, deaccent, deaccent_exact, error_text, is_blank, jtrim,
)
from leadmerge.functions.times import (
    age_hours, epoch_seconds_between, on_date, parse_cutoff, retry_at, stale_text,
    tolerant_timestamp,
)
from leadmerge.functions.urls import canonical_host, extract_post_id, normalize_permalink
from leadmerge.functions.verdicts import decode_verdict

__all__ = [
    "age_hours", "blank_to_null", "business_key", "canonical_host", "clamp",
    "clean_email", "deaccent", "deaccent_exact", "decode_verdict", "epoch_seconds_between",
    "error_text", "extract_post_id", "fingerprint", "first_uk_phone", "is_blank",
    "jtrim", "match_key", "normalize_permalink", "normalize_uk_phone", "on_date",
    "parse_cutoff", "postcode_key", "retry_at", "row_hash", "stale_text",
    "tolerant_timestamp",
]
