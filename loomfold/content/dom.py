"""A small tree of HTML elements from the standard library's parser, with implied end tags."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Start tags that end an open element, and the elements beyond which they don't look.
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})} | {t: ({"p"}, {"td", "th", "button", "li", "div", "article", "section", "body"} - {t}) for t in BLOCKS}


class Element:
    """An element with its children, which are elements and strings."""

    __slots__ = ("_below", "attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None = None):
        self.tag, self.attrs, self.parent, self.children, self._below = tag, attrs, parent, [], None

    def below(self) -> list[Element]:
        """Descendants in document order, listed once: a tree is searched many times, and only when it is whole."""
        if self._below is None:
            self._below, stack = [], [c for c in reversed(self.children) if isinstance(c, Element)]
            while stack:
                e = stack.pop()
                self._below.append(e)
                if e.children:
                    stack += [c for c in reversed(e.children) if isinstance(c, Element)]
        return self._below

    def __iter__(self) -> Iterator[Element]:
        """Descendants in document order."""
        return iter(self.below())

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in ("script", "style"):
                stack += reversed(c.children)
        return "".join(out)

    def classes(self) -> set[str]:
        return set(self.get("class").split())

    def styled(self, name: str, value: str) -> bool:
        rules = (r.partition(":") for r in self.get("style").split(";"))
        return any(k.strip().lower() == name and v.strip().lower() == value for k, _, v in rules)

    def all(self, test: Callable[[Element], bool]) -> list[Element]:
        return [e for e in self.below() if test(e)]

    def one(self, test: Callable[[Element], bool]) -> Element | None:
        for e in self.below():
            if test(e):
                return e
        return None

    def up(self, test: Callable[[Element], bool]) -> Element | None:
        """The element itself or the nearest around it that passes."""
        e: Element | None = self
        while e is not None and not test(e):
            e = e.parent
        return e

    def within(self, other: Element) -> bool:
        return self.up(lambda e: e is other) is not None

    def without(self, test: Callable[[Element], bool]) -> Element:
        """A copy without the descendants that pass."""
        copy = Element(self.tag, dict(self.attrs))
        for c in self.children:
            if isinstance(c, str):
                copy.children.append(c)
            elif not test(c):
                inner = c.without(test)
                inner.parent = copy
                copy.children.append(inner)
        return copy


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#document", {})

    def handle_starttag(self, tag, attrs):
        closes, beyond = ENDS.get(tag, (set(), set()))
        e = self.at
        while e.parent is not None and e.tag not in beyond:
            if e.tag in closes:
                self.at = e.parent
                break
            e = e.parent
        made = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.parent is not None:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Element:
    """The tree of any text; what is malformed is put right or taken as it comes, never refused."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def testid(value: str) -> Callable[[Element], bool]:
    return lambda e: e.attrs.get("data-testid") == value


def role(value: str) -> Callable[[Element], bool]:
    return lambda e: e.attrs.get("role") == value


def tagged(*names: str) -> Callable[[Element], bool]:
    return lambda e: e.tag in names


def linked(*parts: str) -> Callable[[Element], bool]:
    return lambda e: e.tag == "a" and all(p in e.get("href") for p in parts)
