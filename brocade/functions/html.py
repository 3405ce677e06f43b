"""A small tolerant HTML reader: bytes or text in, a tree of elements out. Standard library only.

It follows what browsers and the common C parser agree on for listing pages: names without case, quotes
that open only after '=' and run to their own closing quote wherever it is, unquoted values, the first of
repeated attributes, comments and scripts kept out of the text, entities decoded, list items, cells, rows
and paragraphs closed by what can't stand in them, and end tags that close up to their start tag unless a
stronger element is open in between.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=(?!\s*[\"']))*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?", re.S)
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style"))
_BLOCK = frozenset("address blockquote center dd div dl dt fieldset form h1 h2 h3 h4 h5 h6 hr li ol p pre table tbody td tfoot th thead tr ul".split())
#: Which open elements a start tag closes, as long as they are innermost.
_CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"},
    "tbody": {"td", "th", "tr", "tbody", "thead", "tfoot", "p"}, "thead": {"td", "th", "tr", "tbody", "p"}, "tfoot": {"td", "th", "tr", "tbody", "thead", "p"},
    "body": {"head", "title"},
} | {b: {"p"} for b in _BLOCK if b not in {"li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot"}}
#: An end tag isn't looked for beyond an open element of higher rank.
_RANK = {"p": 10, "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}


class Node:
    """An element: name, attributes, children (elements and texts)."""

    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]) -> None:
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if child.__class__ is Node:
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def find(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def _texts(self) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if child.__class__ is str:
                    yield child
                elif child.name not in _RAW:
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        """Its pieces of text, each stripped, empty ones left out, joined by a space."""
        return " ".join(s for s in (t.strip() for t in self._texts()) if s)


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        value = a or b or c
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


def read_html(page: bytes | str) -> Node:
    """The tree under a root element without a name. Bytes are UTF-8; what isn't becomes U+FFFD."""
    if not isinstance(page, str):
        page = bytes(page).decode("utf-8", errors="replace")
    page = page.removeprefix("﻿")
    root = Node("", {})
    open_ = [root]
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            open_[-1].children.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if start := m["start"]:
            name = start.lower()
            closes = _CLOSES.get(name)
            while closes and open_[-1].name in closes:
                open_.pop()
            source = m["attrs"]
            node = Node(name, _attributes(source) if source else {})
            open_[-1].children.append(node)
            if name in _RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                node.children.append(page[at : end.start() if end else n])
                at = end.end() if end else n
            elif name not in _VOID:
                open_.append(node)
        elif end := m["end"]:
            name = end.lower()
            rank = _RANK.get(name, 100)
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name == name:
                    del open_[i:]
                    break
                if _RANK.get(open_[i].name, 100) > rank:
                    break
    return root
