"""A small document tree on the standard library's HTML tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements without content, elements whose content is no text, and elements that close others of their kind.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
NO_TEXT = frozenset({"script", "style", "template"})
SIBLINGS = {
    "li": ({"li"}, {"ol", "ul"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)


@dataclass(eq=False)
class Node:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = self.elements[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements[::-1])

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def find(self, names: set[str] | frozenset[str]) -> Node | None:
        return next((n for n in self.walk() if n.name in names), None)

    def following(self, limit: int) -> list[Node]:
        """The next sibling elements."""
        if self.parent is None:
            return []
        siblings = self.parent.elements
        at = next(k for k, n in enumerate(siblings) if n is self)
        return siblings[at + 1 : at + 1 + limit]

    def raw_text(self) -> str:
        parts, stack = [], list(reversed(self.children))
        while stack:
            child = stack.pop()
            if isinstance(child, str):
                parts.append(child)
            elif child.name not in NO_TEXT:
                stack.extend(reversed(child.children))
        return "".join(parts)

    def text(self) -> str:
        """Text as a browser shows it: white space collapsed and trimmed."""
        return re.sub(r"\s+", " ", self.raw_text()).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def _close(self, names: set[str], until: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k].name
            if name in until:
                return
            if name in names:
                del self.open[k:]
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, {"table", "td", "th", "li", "div", "section", "article", "blockquote"})
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        if tag == "a":
            self._close({"a"}, {"table", "td", "th"})
        attributes: dict[str, str] = {}
        for key, value in attrs:
            attributes.setdefault(key, value or "")
        node = Node(tag, attributes, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # On elements that can have content HTML ignores the slash.

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; an empty document for null."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
