"""Timestamps, ages and retry times."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, functions as F

from leadmerge.functions.text import bind, jtrim

# Shapes a spreadsheet timestamp comes in, each with year, month, day and, behind
# them, hour, minute, second, fraction, half of the day and zone. Slashed dates are
# month first unless they start with the year; month names may follow a weekday.
_ISO = r"^\d{4}(-\d{1,2}(-\d{1,2})?)?([T ].*)?$"
_CLOCK = r"(?:,? +(\d{1,2}):(\d{2})(?::(\d{2})(\.\d{1,6})?\d*)?(?: ?([ap])\.?m\.?)?)?"
_ZONE = r" *(?:z|utc|gmt)? *([+-]\d{1,2}(?::?\d{2})?)? *(?:\([^)]*\))?$"
_DAY = r"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? +)?"
_MONTH = r"((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)\.?"
_YEAR = r"(\d{4}|\d{2})"
_REST = "|$4|$5|$6|$7|$8|$9"
_SHAPES = {
    _DAY + r"(\d{1,2})/(\d{1,2})/" + _YEAR: "$3|$1|$2",
    r"^(\d{4})/(\d{1,2})/(\d{1,2})": "$1|$2|$3",
    _DAY + _MONTH + r"[ -]+(\d{1,2})(?:,| |-)+" + _YEAR: "$3|$1|$2",
    _DAY + r"(\d{1,2})[ -]*" + _MONTH + r"[ ,-]+" + _YEAR: "$3|$2|$1",
}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def tolerant_timestamp(c: Column) -> Column:
    """Any accepted spelling of a time to a UTC instant, else null.

    ISO texts, and dates with slashes or English month names in any case, with two or
    four digits of the year (00 to 49 are 2000 to 2049), optional clock with fractions
    and AM or PM, and an offset from UTC; without one the text is UTC. The shape picks
    one rewrite, so a value is taken apart once instead of failing through a list of
    formats.
    """
    return bind(jtrim(c), _parsed)


def _parsed(text: Column) -> Column:
    lower = F.lower(text)
    taken = F.lit(None).cast("string")
    for shape, order in reversed(_SHAPES.items()):
        whole = shape + _CLOCK + _ZONE
        taken = F.when(lower.rlike(whole), F.regexp_replace(lower, whole, order + _REST)).otherwise(taken)
    other = bind(F.split(taken, r"\|", -1), _assembled)
    return F.when(text.rlike(_ISO), text.try_cast("timestamp")).otherwise(other)


def _assembled(parts: Column) -> Column:
    """Instant from the nine texts of a rewritten time."""
    year, month, day, hour, minute, second, fraction, half, zone = (parts[i] for i in range(9))
    number = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.left(month, F.lit(3))).cast("string")
    year = F.when(F.length(year) == 4, year).otherwise(
        F.concat(F.when(year < "50", F.lit("20")).otherwise(F.lit("19")), year)
    )
    h = hour.try_cast("int")
    h = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    clock = F.when(hour == "", F.lit("0:00:00")).otherwise(
        F.concat(h.cast("string"), F.lit(":"), minute, F.lit(":"), F.when(second == "", F.lit("00")).otherwise(second), fraction)
    )
    digits = F.regexp_replace(zone, "[+:-]", "")
    hours = F.lpad(F.when(F.length(digits) > 2, F.substring(digits, 1, F.length(digits) - 2)).otherwise(digits), 2, "0")
    offset = F.when(zone == "", F.lit("Z")).otherwise(
        F.concat(F.left(zone, F.lit(1)), hours, F.lit(":"), F.when(F.length(digits) > 2, F.right(digits, F.lit(2))).otherwise(F.lit("00")))
    )
    month = F.when(month.rlike("^[a-z]"), number).otherwise(month)
    return F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), clock, offset).try_cast("timestamp")


def parse_cutoff(text: str | None) -> Column:
    """Cut-off setting as an instant; a missing or unreadable one is null."""
    return tolerant_timestamp(F.lit(text).cast("string"))


def as_instant(value: Column | datetime | str) -> Column:
    """A point in time given as a column, a datetime or an ISO text."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    return F.lit(str(value)).cast("timestamp")


def age_hours(ts: Column, as_of: Column | datetime | str) -> Column:
    """Hours from ``ts`` to ``as_of``."""
    return (F.unix_micros(as_instant(as_of)) - F.unix_micros(ts.cast("timestamp"))) / 3.6e9


def stale_text(ts: Column, as_of: Column | datetime | str) -> Column:
    """``stale_<hours>h`` with the age rounded to whole hours."""
    hours = F.round(age_hours(ts, as_of)).cast("bigint").cast("string")
    return F.concat(F.lit("stale_"), hours, F.lit("h"))


def retry_at(
    attempt: Column, base_minutes: float, as_of: Column | datetime | str
) -> Column:
    """Linear back-off: ``as_of`` plus attempt times the base."""
    micros = (attempt * F.lit(float(base_minutes)) * 60e6).cast("bigint")
    return F.timestamp_micros(F.unix_micros(as_instant(as_of)) + micros)


def on_date(ts: Column, day: date | str) -> Column:
    """True when the instant falls on the UTC day.

    A half-open range instead of a cast of the column, so the predicate reaches
    the Parquet statistics.
    """
    start = F.lit(str(day)).cast("date")
    return (ts >= start.cast("timestamp")) & (ts < F.date_add(start, 1).cast("timestamp"))


def epoch_seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds between two instants, with fractions."""
    later, earlier = later.cast("timestamp"), earlier.cast("timestamp")
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6
