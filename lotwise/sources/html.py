"""HTML as numbered trees: elements as intervals of the page's pieces of text, so that what an element shows, and which elements surround another, are questions on intervals.

A page is tokenized once, in a task, by one pass with a stack. Element k shows the pieces begin[k] to end[k]; its ancestors are the elements whose interval holds its own and that
were opened before it, which `parent` walks in order.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content, elements whose content is no markup, elements that stand on lines of their own, and what the start of an element closes, up to which element.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template")
HIDDEN = frozenset(("script", "style", "noscript", "template", "head", "title"))
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)), "a": (("a",), ()),
}
#: How many elements from a link outward a card may be.
REACH = 8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_ITEM = re.compile(r"/item/([0-9]+)")
_PRICE, _SALE = re.compile(r"\$[0-9]"), re.compile(r"Time remaining:|Buy It Now")


@dataclass
class Tree:
    """Elements in the order in which they open, and the page's pieces of visible text."""

    tag: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    begin: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)

    def text(self, k: int) -> str:
        """What element k shows, its white space as single spaces."""
        return " ".join("".join(self.pieces[self.begin[k] : self.end[k]]).split())

    def attribute(self, k: int, name: str) -> str | None:
        """The first value of an element's attribute."""
        for m in _ATTRIBUTE.finditer(self.attributes[k]):
            if m[1].lower() == name:
                return _html.unescape(next((x for x in m.groups()[1:] if x is not None), ""))
        return None

    def outward(self, k: int) -> Iterator[int]:
        """Element k and those around it, from within."""
        while k >= 0:
            yield k
            k = self.parent[k]


def parse(page: str | None) -> Tree:
    """The tree of a page. Ends without a start are passed over; what stays open ends with the page; an element that can't hold another of its kind ends where that begins."""
    tree, page = Tree(), page or ""
    stack: list[int] = []
    hidden, at, lower = 0, 0, None

    def close(keep: int) -> None:
        nonlocal hidden
        while len(stack) > keep:
            k = stack.pop()
            if tree.tag[k] in BLOCKS and not hidden:
                tree.pieces.append("\n")
            tree.end[k] = len(tree.pieces)
            hidden -= tree.tag[k] in HIDDEN

    def say(text: str) -> None:
        if text and not hidden:
            tree.pieces.append(_html.unescape(text))

    while True:
        m = _TOKEN.search(page, at)
        say(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            keep = next((n for n in range(len(stack) - 1, -1, -1) if tree.tag[stack[n]] == tag), None)
            if keep is not None:
                close(keep)
            continue
        inner, bounds = CLOSES.get(tag, ((), ()))
        if tag in BLOCKS and tag != "br" and any(tree.tag[k] == "p" for k in stack[-1:]):
            inner = (*inner, "p")
        for n in range(len(stack) - 1, -1, -1) if inner else ():
            own = tree.tag[stack[n]]
            if own in bounds:
                break
            if own in inner:
                close(n)
                if tag not in ("tr", "tbody"):
                    break
        k = len(tree.tag)
        if tag in BLOCKS and not hidden:
            tree.pieces.append("\n")
        for column, value in ((tree.tag, tag), (tree.attributes, m[3]), (tree.parent, stack[-1] if stack else -1), (tree.depth, len(stack)), (tree.begin, len(tree.pieces)), (tree.end, len(tree.pieces))):
            column.append(value)
        if tag in VOID or m[3].endswith("/"):
            continue
        stack.append(k)
        hidden += tag in HIDDEN
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            until = lower.find(f"</{tag}", at)
            say(page[at : until if until >= 0 else len(page)])
            at = until if until >= 0 else len(page)
    close(0)
    return tree


def cards_of(tree: Tree) -> list[tuple[str, str, str, str]]:
    """(id, title, url, card) of each item that a page links to: the link's text, and that of the nearest of REACH elements from the link outward that states a price and how the item is sold. The first such link of an id counts."""
    out: dict[str, tuple[str, str, str, str]] = {}
    for k, tag in enumerate(tree.tag):
        if tag != "a":
            continue
        url = tree.attribute(k, "href") or ""
        found, title = _ITEM.search(url), tree.text(k)
        if not found or not title or found[1] in out:
            continue
        for n, around in enumerate(tree.outward(k)):
            if n == REACH:
                break
            card = tree.text(around)
            if _PRICE.search(card) and _SALE.search(card):
                out[found[1]] = (found[1], title, url, card)
                break
    return list(out.values())


def cards(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, id, title, url, card) for each item that a page links to (see cards_of). Null and empty pages link to nothing; other columns are left aside; repeated pages are each read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *card) for k, page in enumerate(batch.column(1).to_pylist()) for card in cards_of(parse(page))]
            at, *columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], [key, "id", "title", "url", "card"])

    return pages.select(key, F.col(html).cast("string")).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, id string, title string, url string, card string")


def elements(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, element, tag, parent, depth, begin, end) for each element of each page: a page as a table of intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, page in enumerate(batch.column(1).to_pylist()):
                t = parse(page)
                n = len(t.tag)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * n, pa.int64())), pa.array(range(n), pa.int32()), pa.array(t.tag, pa.string()), *(pa.array(x, pa.int32()) for x in (t.parent, t.depth, t.begin, t.end))], [key, "element", "tag", "parent", "depth", "begin", "end"])

    return pages.select(key, F.col(html).cast("string")).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, element int, tag string, parent int, depth int, begin int, end int")
