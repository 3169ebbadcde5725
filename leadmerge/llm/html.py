"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadmerge.llm.common import texts_of

# A comment, a declaration, or a tag with its attributes; what is between is text. A quote
# counts only after "=", elsewhere it is a character of a name or value.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))*+)>", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
#: Elements whose content has no markup but their own end tag.
PLAIN = frozenset("script style textarea title iframe".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in PLAIN}
_NAME = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section select summary"
    " table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea svg math iframe object head title canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag that ends an open element of the same kind.
REPEATED = frozenset("p li dt dd tr td th option".split())
#: Costs of the classifier: what an element says about all text inside it ...
ELEMENT = {
    "article": 4.0, "main": 3.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "header": -6.0, "menu": -9.0,
    "button": -9.0, "select": -9.0, "fieldset": -9.0, "dialog": -9.0, "search": -9.0,
}
ROLES = {
    "navigation": -9.0, "banner": -9.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "form": -9.0,
    "dialog": -9.0, "alert": -9.0, "main": 3.0, "article": 4.0,
}
#: ... and words in its class or id.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr"
    " notice notification alert popup modal overlay newsletter subscribe subscription signup login comment comments reply"
    " replies discussion disqus respond sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead share"
    " sharing social related recommended recommendations widget pagination pager toolbar copyright skip search form header".split()
)
# What a name may end with and still be one of them.
PART_NAMES = frozenset(
    "area bar block body bottom box button buttons close container content count footer form group head header heading icon"
    " icons info inner item items label left link links list main message messages mini outer overlay panel right row section"
    " slot small text thread title top unit wrap wrapper zone".split()
)
GOOD_NAMES = frozenset("article content post entry story text prose".split())
BLOCK_TAG = {"p": 1.5, "h1": 1.5, "h2": 1.0, "h3": 1.0, "blockquote": 1.0, "pre": 1.0, "li": -0.5, "td": -0.5}
#: Costs of cutting between neighbours, and between blocks of the same parent.
ADJACENT, SIBLINGS = 0.8, 1.2


@dataclass
class Block:
    text: str
    tag: str
    parent: int
    cost: float  # above 0: content, below: boilerplate
    linked: int = 0
    inside: bool = False


@dataclass
class _Element:
    tag: str
    number: int
    cost: float
    inside: bool  # an article or main part


@dataclass
class _Reader:
    stack: list[_Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    count: int = 0

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                top = next((e for e in reversed(self.stack) if e.tag in BLOCKS), None)
                if top is None:
                    top = _Element("", -1, 0.0, False)
                self.blocks.append(Block(text, top.tag, top.number, top.cost, self.linked, top.inside))
        self.parts, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag in REPEATED:
            # Only as far as the nearest container.
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].tag == tag:
                    del self.stack[i:]
                    break
                if self.stack[i].tag in ("ul", "ol", "dl", "table", "div", "section", "article", "select", "body"):
                    break
        parent = self.stack[-1] if self.stack else None
        cost = parent.cost if parent else 0.0
        inside = parent.inside if parent else False
        own = ELEMENT.get(tag, 0.0)
        if tag == "header" and inside:
            own = 0.0  # holds the article's title
        if attributes and tag not in ("html", "body"):
            own = min(own, 0.0) + self._named(attributes) if own <= 0 else own + min(0.0, self._named(attributes))
        # Boilerplate stays so whatever holds it or lies in it.
        if own < 0:
            cost = max(-18.0, min(cost, 0.0) + own)
        elif cost >= 0:
            cost += own
        self.count += 1
        self.stack.append(_Element(tag, self.count, cost, inside or tag in ("article", "main")))
        self.links += tag == "a"

    @staticmethod
    def _named(attributes: str) -> float:
        best = worst = 0.0
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                for part in value.split():
                    words = [w.lower() for w in _NAME.findall(_CAMEL.sub(" ", part))]
                    good, bad = GOOD_NAMES.intersection(words), BAD_NAMES.intersection(words)
                    if bad and not good:
                        # "notice-period", "comments-open": the name speaks of something else.
                        if len(words) == 1 or words[-1] in BAD_NAMES or words[-1] in PART_NAMES:
                            return -9.0
                        worst = -1.0
                    elif good and not bad:  # both, as in "entry-header", say nothing
                        best = max(best, 3.0)
            elif name == "role":
                role = ROLES.get(value.lower(), 0.0)
                if role < 0:
                    return role
                best = max(best, role)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return -12.0
        return worst or best

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self.links -= sum(e.tag == "a" for e in self.stack[i:])
                del self.stack[i:]
                break

    def text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.links > 0:
            self.linked += len(text)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with the classifier's cost of each."""
    reader, at, skip = _Reader(), 0, ""
    endless: set[str] = set()
    while m := _MARKUP.search(page, at):
        if m.start() > at and not skip:
            reader.text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in PLAIN and not m[1] and not m[3].endswith("/") and tag not in endless:
            if end := _END[tag].search(page, at):
                at = end.start()
            else:
                endless.add(tag)
        if skip:
            # A missing end tag of the head must not hide the page.
            if m[1] and tag == skip or skip == "head" and tag == "body":
                skip = ""
                if tag != "body":
                    continue
            else:
                continue
        if m[1]:
            reader.close(tag)
        elif tag in RAW:
            if not m[3].endswith("/"):
                skip = tag
        elif tag == "br":
            reader.text(" ")
        elif tag not in VOID:
            reader.open(tag, m[3])
        elif tag == "hr":
            reader.flush()
    if at < len(page) and not skip:
        reader.text(page[at:])
    reader.flush()
    blocks = reader.blocks
    marked = any(b.inside for b in blocks)
    for b in blocks:
        words = b.text.count(" ") + 1
        b.cost += BLOCK_TAG.get(b.tag, 0.0) + min(2.0, words / 15) - 4.0 * min(1.0, b.linked / len(b.text))
        b.cost += 0.5 if b.text[-1] in ".!?:;\"'»”" else 0.0
        if marked and not b.inside:
            b.cost -= 5.0  # the page says where its article is
        elif not marked:
            b.cost -= 1.0
    return blocks


def min_cut(costs: list[int], siblings: list[int], adjacent: list[int], weight: int) -> list[bool]:
    """Which blocks are on the content side of the minimum cut.

    A positive cost is what labelling a block as boilerplate costs, a negative one what
    labelling it as content costs; a cut edge costs its weight. Block ``i`` has an edge of
    ``adjacent[i]`` to the block before it and one of ``weight`` to the block
    ``siblings[i]``, the last one of the same parent (-1: none). Parents are nested, so
    these edges never cross: every block between two siblings is settled, for each pair
    of their labels, once the second one comes, and the cut takes linear time. Of equal
    cuts the one with the least content is taken.
    """
    n = len(costs)
    # One more unit for every content block decides between equal cuts.
    scale = n + 1
    # Of the open blocks: the block, and the least cost between it and the one below for
    # each pair of labels (below, own); settled blocks keep their best label for each pair around them.
    path: list[tuple[int, tuple[int, int, int, int]]] = []
    settled: list[tuple[int, int, int, tuple[int, int, int, int]]] = []

    def own(i: int) -> tuple[int, int]:
        return max(0, costs[i]) * scale, max(0, -costs[i]) * scale + 1

    def settle(below: int, between: tuple, i: int, above: int, beyond: tuple) -> tuple[int, int, int, int]:
        zero, one = own(i)
        out, best = [], []
        for x in (0, 1):
            for y in (0, 1):
                a, b = between[2 * x] + zero + beyond[y], between[2 * x + 1] + one + beyond[2 + y]
                out.append(min(a, b))
                best.append(int(b < a))
        settled.append((i, below, above, tuple(best)))
        return tuple(out)

    for i in range(n):
        w = adjacent[i] * scale
        edge = (0, w, w, 0) if path else (0, 0, 0, 0)
        if siblings[i] >= 0:
            while path[-1][0] != siblings[i]:
                j, between = path.pop()
                edge = settle(path[-1][0], between, j, i, edge)
            w = weight * scale
            edge = (edge[0], edge[1] + w, edge[2] + w, edge[3])
        path.append((i, edge))
    edge = (0, 0, 0, 0)
    while path:  # the rest is a path; nothing is below its first block and above its last one
        j, between = path.pop()
        edge = settle(path[-1][0] if path else n, between, j, n, edge)
    label = [0] * (n + 1)
    for i, below, above, best in reversed(settled):
        label[i] = best[2 * label[below] + label[above]]
    return [x == 1 for x in label[:n]]


def main_blocks(page: str) -> list[str]:
    """Texts of the blocks on the content side of the cut."""
    blocks = blocks_of(page)
    adjacent, siblings, last = [], [], {}
    for i, b in enumerate(blocks):
        # Less to cut where the page's own parts meet.
        adjacent.append(int(100 * ADJACENT * (1.0 if i and b.inside == blocks[i - 1].inside else 0.25)))
        siblings.append(last.get(b.parent, -1))
        last[b.parent] = i
    keep = min_cut([int(100 * b.cost) for b in blocks], siblings, adjacent, int(100 * SIBLINGS))
    return [b.text for b, k in zip(blocks, keep) if k]


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)``, one row per input row.

    The page is read whole into blocks; menus, headers, footers, sidebars, notices,
    adverts, forms and comments are told from content by a minimum cut through a graph
    with the classifier's costs and smoothness between neighbours and siblings. Blocks
    of content are joined by an empty line, white space inside one is a single space,
    character references are decoded, scripts, styles and markup are gone. A null,
    empty or text-free page has an empty text. Broken markup is read as far as it goes:
    unclosed elements end with the page. Ids, urls and other columns may be null or
    repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(main_blocks(p)) for p in texts_of(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id_col, url_col, "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
