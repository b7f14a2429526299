"""A lenient HTML tree from the standard library's tokenizer: void elements, raw text, and implied ends of p, li, table and option parts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
#: What an opening tag ends, if it is open: the tag's own kind, looked for up to a boundary.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.children) if isinstance(x, Node))

    def all(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags)

    def texts(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            else:
                stack.extend(reversed(x.children))

    def text(self) -> str:
        """All text below, white space collapsed."""
        return " ".join("".join(self.texts()).split())

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end({"p"}, {"button", "table"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        held: dict[str, str] = {}
        for k, v in attrs:
            held.setdefault(k, v or "")
        node = Node(tag, held, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def _end(self, tags: set[str], limits: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in limits:
            if node.tag in tags:
                self.at = node.parent
                if tags == {"p"}:
                    return
            node = node.parent

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and self.at.parent is not None and any(n.tag in ("svg", "math") for n in (self.at, *self.at.above())):
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def matches(node: Node, selector: str) -> bool:
    """A simple selector: tag, #id, .class and [attr], [attr=value] parts joined."""
    import re

    for part in re.findall(r"[#.]?[\w-]+|\[[^\]]+\]|\*", selector):
        if part == "*":
            continue
        if part[0] == "#":
            ok = node.attrs.get("id") == part[1:]
        elif part[0] == ".":
            ok = part[1:] in node.attrs.get("class", "").split()
        elif part[0] == "[":
            name, _, value = part[1:-1].partition("=")
            ok = name in node.attrs and (not value or node.attrs[name] == value.strip("\"'"))
        else:
            ok = node.tag == part.lower()
        if not ok:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Elements by a list of selectors with descendant steps, in document order."""
    found = []
    ways = [w.split() for w in selector.split(",") if w.strip()]
    for node in root.walk():
        for way in ways:
            if node.parent is not None and matches(node, way[-1]):
                rest, chain = way[:-1], node.above()
                while rest:
                    hit = next((a for a in chain if matches(a, rest[-1])), None)
                    if hit is None:
                        break
                    rest = rest[:-1]
                else:
                    found.append(node)
                    break
    return found
