"""Text helpers."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

from leadmerge.contract import ERROR_TEXT_LIMIT

# Every character a spreadsheet cell may be padded with (all Unicode spaces, line
# and paragraph separators, byte order mark); Spark's trim() knows only U+0020.
SPACES = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

_MARKS = re.compile("[\u0300-\u036f]+")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row.

    A one-element transform. It keeps long rules out of the generated code of the
    surrounding projection: a generated method beyond the JIT's size limit would run
    interpreted, which costs far more than the lambda does.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """Group of the first match, null when there is none.

    ``nullif(regexp_extract(...), '')`` says the same but evaluates the pattern
    twice wherever it is nested in another expression.
    """
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(1))


def empty_to_null(c: Column) -> Column:
    """Null for empty text, computing ``c`` once."""
    return first_match(c, r"(?s)^.+$")


def jtrim(c: Column) -> Column:
    """Strip all Unicode white space from both ends."""
    return F.btrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return empty_to_null(jtrim(c))


def is_blank(c: Column) -> Column:
    """True for null and for white space only."""
    return F.coalesce(jtrim(c) == "", F.lit(True))


def remove_spaces(c: Column) -> Column:
    """Drop white space anywhere in the text."""
    return F.translate(c, SPACES, "")


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Characters whose canonical decomposition is one character plus marks.

    Derived from the Unicode data shipped with Python. The combining marks
    U+0300-U+036F come last in the first string without a counterpart, so
    ``translate`` deletes them.
    """
    source, target = [], []
    for code in range(0xC0, min(sys.maxunicode, 0xFFFF)):
        if 0xAC00 <= code <= 0xDFFF or 0x300 <= code <= 0x36F:
            continue  # Hangul decomposes into several letters; surrogates; marks
        char = chr(code)
        letter = bare(char)
        if len(letter) == 1 and letter != char:
            source.append(char)
            target.append(letter)
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(source) + marks, "".join(target)


def deaccent(c: Column) -> Column:
    """Remove accents; letters without a decomposition (o-slash, sharp s) stay."""
    source, target = _accent_table()
    # Most names are ASCII: those skip the per-character table walk.
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(c, source, target)).otherwise(c)


def bare(text: str) -> str:
    """Canonical decomposition without the combining marks U+0300-U+036F."""
    return _MARKS.sub("", unicodedata.normalize("NFD", text))


def _bare_all(texts: pd.Series) -> pd.Series:
    return texts.map(bare, na_action="ignore")


def deaccent_exact(c: Column) -> Column:
    """The whole canonical decomposition without accents, for texts of any script.

    Only texts that are not ASCII go to Python, in Arrow batches; the others cross as
    nulls. A pattern of all characters beyond the table of :func:`deaccent` would try its
    hundreds of ranges one after the other at every character.
    """
    decomposed = F.pandas_udf(_bare_all, "string")
    return F.coalesce(decomposed(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def clean_email(c: Column) -> Column:
    """Blank and the placeholder ``.`` mean no address."""
    return F.nullif(blank_to_null(c), F.lit("."))


def error_text(c: Column, limit: int = ERROR_TEXT_LIMIT) -> Column:
    """Error message cut to the stored length."""
    return F.substring(c, 1, limit)


def one_line(c: Column) -> Column:
    """Line breaks collapsed to one blank, trimmed, null as empty text."""
    return jtrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "))


def csv_field(c: Column) -> Column:
    """One CSV cell on one physical line, quoted only when it has to be."""
    flat = one_line(c)
    quoted = F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(flat.rlike('[",]'), quoted).otherwise(flat)
