"""Comparable permalinks and post ids out of pasted URLs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from leadmerge.contract import (
    CONTENT_PARAMS, HOST_SUFFIXES, POST_ID_PATTERNS, POST_TOKEN, SHORT_LINK_HOSTS,
)
from leadmerge.functions.text import bind, empty_to_null, first_match, jtrim

_ALL = 1 << 30  # longer than any text

# Optional scheme, any slashes, optional user info: what comes before the host.
# Possessive: a recognised part is never given back.
_LEAD = r"^(?i:https?://)?+[/\\]*+(?:[^/\\?#]*@)?+"
# A host without characters that are forbidden in host names, then a valid port.
_HOST = (
    _LEAD
    + r"(\[[0-9A-Fa-f:.]+\]|[^\x00-\x20#/<>?@\[\\\]^|%:\x7f]+)"
    + r"(?::0*(?:[0-5]?\d{0,4}|6[0-4]\d{3}|65[0-4]\d{2}|655[0-2]\d|6553[0-5]))?(?=[/\\?#]|$)"
)
_PATH = _LEAD + r"[^/\\?#]*([^?#]*)"
# Characters a URL path spells as %XX, and segments that move up or stay.
_ESCAPED = r"""[^\x21\x23-\x3b\x3d\x40-\x5f\x61-\x7a\x7c\x7e]"""
_STAY, _UP = r"^(\.|%2[eE])$", r"^(\.|%2[eE]){2}$"
_UNUSUAL = _ESCAPED + r"|\\|/(\.|%2[eE]){1,2}(/|$)"


def canonical_host(
    host: Column,
    short_hosts: Sequence[str] = SHORT_LINK_HOSTS,
    suffixes: Sequence[tuple[str, str]] = HOST_SUFFIXES,
) -> Column:
    """Mobile and regional hosts of one site become one host.

    The suffix test is a plain text suffix, not a domain-label test. One pattern
    per canonical host, so the host expression occurs once in the plan.
    """
    kept = "|".join(re.escape(h) for h in short_hosts)
    guard = f"(?!(?:{kept})$)" if kept else ""
    groups: dict[str, list[str]] = {}
    for suffix, canonical in suffixes:
        groups.setdefault(canonical, []).append(re.escape(suffix))
    name = F.lower(host)
    for canonical, group in groups.items():
        name = F.regexp_replace(name, f"^{guard}.*(?:{'|'.join(group)})$", canonical)
    return name


def _rewrite_path(path: Column) -> Column:
    """Back slashes turned, characters escaped, dot segments resolved."""
    escaped = F.array_join(
        F.transform(
            F.split(F.translate(path, "\\", "/"), ""),
            lambda ch: F.when(
                ch.rlike(_ESCAPED), F.regexp_replace(F.hex(ch), "(..)", "%$1")
            ).otherwise(ch),
        ),
        "",
    )
    folded = F.aggregate(
        F.split(F.substring(escaped, 2, _ALL), "/"),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(
            part.rlike(_UP), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        )
        .when(part.rlike(_STAY), kept)
        .otherwise(F.array_append(kept, part)),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def _comparable_path(path: Column) -> Column:
    """Rewritten where needed, no trailing slashes, lower case, at least ``/``."""
    plain = bind(
        path, lambda p: F.when((p != "") & p.rlike(_UNUSUAL), _rewrite_path(p)).otherwise(p)
    )
    return F.regexp_replace(F.lower(F.rtrim(plain, F.lit("/"))), "^$", "/")


def _param(text: Column, name: str) -> Column:
    """``&name=value`` for the first value of a parameter, decoded and lower case;
    empty text if it is absent or has no value."""
    first = r"^[^?#]*\?(?:[^#]*?&)??" + re.escape(name) + r"(?:=([^&#]*))?(?=&|#|$)"
    raw = F.regexp_extract(text, first, 1)
    decoded = F.coalesce(F.try_url_decode(raw), F.translate(raw, "+", " "))
    return F.regexp_replace(F.lower(decoded), r"(?s)^(?=.)", f"&{name}=")


def normalize_permalink(
    url: Column,
    params: Sequence[str] = CONTENT_PARAMS,
    short_hosts: Sequence[str] = SHORT_LINK_HOSTS,
    suffixes: Sequence[tuple[str, str]] = HOST_SUFFIXES,
) -> Column:
    """``host/path?params`` in one spelling, or null when it is not a URL.

    Scheme, user info, port, fragment and tracking parameters are dropped, path
    and values are lower-cased. Not covered: international domain names and
    numeric host notations are kept as written.
    """
    trimmed = F.translate(jtrim(url), "\t\n\r", "")

    def comparable(text: Column) -> Column:
        host = canonical_host(first_match(text, _HOST, 1), short_hosts, suffixes)
        path = _comparable_path(F.regexp_extract(text, _PATH, 1))
        ordered = sorted(params, key=lambda p: p + "=")
        kept = F.concat(F.lit(""), *[_param(text, name) for name in ordered])
        query = F.when(text.contains("?"), F.regexp_replace(kept, "^&", "?")).otherwise("")
        return F.concat(host, path, query)

    return bind(trimmed, comparable)


def extract_post_id(
    url: Column,
    patterns: Sequence[str] = POST_ID_PATTERNS,
    token: str | None = POST_TOKEN,
) -> Column:
    """Post token if the URL has one, else the first pattern that hits.

    Every pattern has exactly one group, the token has none.
    """
    # One anchored alternation: each alternative searches the whole text before the
    # next one is tried, and the last one matches anything and captures nothing.
    ordered = [*([f"({token})"] if token is not None else []), *patterns]
    tried = "|".join(f".*?(?:{p})" for p in ordered)
    groups = "".join(f"${i + 1}" for i in range(len(ordered)))
    return empty_to_null(F.regexp_replace(jtrim(url), f"(?s)^(?:{tried}|).*$", groups))
