"""Licence scans: Aho-Corasick over notices and tags, shunting-yard over expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadmerge.llm.common import texts_of

#: Phrases every scan counts, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices. They add labels, not places.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
}
TAG = "spdx license identifier"
#: Licence families by the start of an identifier, and those that permit most uses.
FAMILIES = ("agpl", "lgpl", "gpl", "apache", "mit", "bsd", "mpl", "epl", "isc", "cc-by", "cc0", "unlicense", "zlib", "artistic")
PERMISSIVE = {"apache", "mit", "bsd", "isc", "cc-by", "cc0", "unlicense", "zlib"}
_TAG_LINE = re.compile(r"spdx-license-identifier\s*:\s*([^\r\n]*)")
_PART = re.compile(r"\(|\)|[a-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
# Word bytes: lower-case ASCII letters, digits and everything beyond ASCII.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def family(identifier: str) -> str:
    """The label of a licence identifier: its family, or the identifier itself."""
    return next((f for f in FAMILIES if re.match(rf"{f}(?![a-z])", identifier)), identifier)


def to_postfix(text: str) -> list[str] | None:
    """Shunting-yard: an expression in postfix order; None if it is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # what may come next
    for part in _PART.findall(text):
        if part == "(":
            if not operand:
                return None
            held.append(part)
        elif part == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif part in _RANK:
            if operand:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[part]:
                out.append(held.pop())
            held.append(part)
            operand = True
        elif operand:
            out.append(part)
            operand = False
        else:
            # Text after the expression, such as the end of a comment, is not part of it.
            break
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Labels named by an expression, and whether it can be met by permissive licences.

    ``a or b`` can be met by either, ``a and b`` by both, ``a with exception`` as ``a``.
    """
    stack: list[tuple[set[str], bool]] = []
    for part in postfix:
        if part in _RANK:
            right, left = stack.pop(), stack.pop()
            if part == "with":
                stack.append(left)
            else:
                met = left[1] or right[1] if part == "or" else left[1] and right[1]
                stack.append((left[0] | right[0], met))
        else:
            label = family(part)
            stack.append(({label}, label in PERMISSIVE))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**BASE, **NOTICES, TAG: None}.items():
        found.add_word(f" {phrase} ", (phrase, label))
    found.make_automaton()
    return found


def scan(text: str, machine: ahocorasick.Automaton) -> tuple:
    """One row of ``SCHEMA`` for a text."""
    raw = text.encode("utf-8", "replace")
    words = raw.translate(_WORDS).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places: list[int] = []
    base, more, tagged = set(), set(), False
    at = word = 0  # spaces are counted on from the last place; starts differ by less than a phrase
    for end, (phrase, label) in machine.iter(line):
        if phrase in BASE:
            start = end - len(phrase) - 1
            word += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
            at = start
            places.append(word)
            base.add(label)
        elif phrase == TAG:
            tagged = True
        else:
            more.add(label)
    labels, score, permissive = base | more, 0.9 if base else 0.8 if more else 0.0, None
    if labels:
        permissive = labels <= PERMISSIVE
    if tagged:
        for tail in _TAG_LINE.findall(raw.translate(_LOWER).decode("utf-8", "replace")):
            postfix = to_postfix(tail)
            score = max(score, 0.5)
            if postfix:
                named, met = evaluate(postfix)
                labels, score = labels | named, 1.0
                permissive = met if permissive is None else permissive and met
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), score, permissive,
    )


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, *SCHEMA)``, one row per input row.

    Words are lower-case; ``n_base`` counts all places of the base phrases, overlapping
    ones too, ``first_word`` and ``last_word`` are their smallest and largest start
    (null without any). ``labels`` adds those of further notices and of the expressions
    behind identifier tags; a malformed expression adds none. ``score`` is 1 for a
    valid tag, 0.9 for a base phrase, 0.8 for another notice, 0.5 for a malformed tag,
    0 otherwise. ``permissive`` is null without labels. A null or empty text has no
    words and empty labels. Null and repeated ids, and other columns, do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [scan(t.as_py(), machine) for t in texts_of(batch, "text")]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], [id_col, *names]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
