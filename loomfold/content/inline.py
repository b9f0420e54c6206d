"""Inline nodes: text with entities, styled runs, and the small markdown of table cells.

A node is a dict with ``type``: text (value), break, link (url, children), entity (kind, value, url),
strong and emphasis (children), inlineCode (value).
"""

from __future__ import annotations

import bisect
import itertools
import re

SITE = "https://x.com"
#: Entity decoding in order, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def text(value: str) -> dict:
    return {"type": "text", "value": value}


def link(url: str, children: list[dict]) -> dict:
    return {"type": "link", "url": url, "children": children}


def decoded(value: str) -> str:
    if "&" not in value:
        return value
    for old, new in ENTITIES:
        value = value.replace(old, new)
    return value


def lines(value: str) -> list[dict]:
    """Text nodes with breaks where lines end; empty lines give no text."""
    if "\n" not in value:
        return [text(value)] if value else []
    out: list[dict] = []
    for n, part in enumerate(value.split("\n")):
        out += [{"type": "break"}] * (n > 0) + [text(part)] * bool(part)
    return out


def is_break(node: dict) -> bool:
    return node["type"] == "break"


def without_edge_breaks(nodes: list[dict]) -> list[dict]:
    low, high = 0, len(nodes)
    while low < high and is_break(nodes[low]):
        low += 1
    while low < high and is_break(nodes[high - 1]):
        high -= 1
    return nodes[low:high]


def trimmed(nodes: list[dict]) -> list[dict]:
    """No breaks at the edges and no white space at the edges of a first or last text; empty texts are dropped."""
    nodes, empty = without_edge_breaks(nodes), text("")
    for at, strip in ((0, str.lstrip), (-1, str.rstrip)):
        if nodes and nodes[at]["type"] == "text":
            nodes[at] = text(strip(nodes[at]["value"]))
    return [n for n in nodes if n != empty]


def _entity_nodes(entities: dict) -> list[tuple[int, int, dict | None]]:
    """(start, end, node) of every entity, media with no node; kinds one after the other."""
    out: list[tuple[int, int, dict | None]] = []

    def add(kind: str, make, needs: str | None = None) -> None:
        for e in entities.get(kind) or []:
            if e.get("indices") and (needs is None or e.get(needs)):
                out.append((e["indices"][0], e["indices"][1], make(e)))

    def address(e: dict) -> str:
        return e["expanded_url"] if e.get("expanded_url") is not None else e.get("url") or ""

    def named(kind: str, key: str, path: str):
        return lambda e: {"type": "entity", "kind": kind, "value": e[key], "url": f"{SITE}/{path}{e[key]}"}

    add("urls", lambda e: link(address(e), [text(e["display_url"] if e.get("display_url") is not None else address(e))]))
    add("user_mentions", named("mention", "screen_name", ""), "screen_name")
    add("hashtags", named("hashtag", "text", "hashtag/"), "text")
    add("symbols", named("cashtag", "text", "search?q=%24"), "text")
    add("media", lambda _: None)
    return out


def from_entities(value: str, entities: dict | None) -> list[dict]:
    """Nodes of a post's text; entities are placed by code points, and one that overlaps an earlier one is skipped."""
    if not entities and "\n" not in value:  # one text, or none
        return [text(only)] if (only := decoded(value).strip()) else []
    out: list[dict] = []
    at = 0
    for start, end, node in sorted(_entity_nodes(entities), key=lambda s: s[0]) if entities else ():
        if start >= at:
            if start > at:
                out += lines(decoded(value[at:start]))
            out += [node] if node else []
            at = end
    if at < len(value):
        out += lines(decoded(value[at:]))
    return trimmed(out)


def _units(value: str) -> list[int]:
    """For each code point the UTF-16 unit at which it begins, and the length in units at the end."""
    return [0, *itertools.accumulate(1 + (ord(c) > 0xFFFF) for c in value)]


def from_ranges(block: dict, entities: dict[str, dict]) -> list[dict]:
    """Nodes of a rich-text block: runs of the same bold, italic and link, as emphasis in strong in link.

    Ranges count UTF-16 units. A range that ends inside a surrogate pair takes the whole character.
    """
    value = block.get("text") or ""
    begin = _units(value)
    styles: list[list] = [[False, False, None] for _ in value]

    def paint(r: dict, slot: int, what) -> None:
        low = r.get("offset") or 0
        high = low + (r.get("length") or 0)
        # From the character that the range begins in, up to the first that begins at its end.
        for i in range(max(0, bisect.bisect_right(begin, low) - 1), min(len(value), bisect.bisect_left(begin, high))):
            styles[i][slot] = what

    for r in block.get("inlineStyleRanges") or []:
        name = (r.get("style") or "").lower()
        if name in ("bold", "italic"):
            paint(r, int(name == "italic"), True)
    for r in block.get("entityRanges") or []:
        entity = entities.get(str(r.get("key"))) if r.get("key") is not None else None
        url = ((entity or {}).get("data") or {}).get("url")
        if entity and entity.get("type") == "LINK" and url:
            paint(r, 2, url)

    out: list[dict] = []
    for (bold, italic, url), run in itertools.groupby(range(len(value)), key=lambda i: tuple(styles[i])):
        nodes = lines("".join(value[i] for i in run))
        if nodes and italic:
            nodes = [{"type": "emphasis", "children": nodes}]
        if nodes and bold:
            nodes = [{"type": "strong", "children": nodes}]
        out += [link(url, nodes)] if nodes and url else nodes
    return trimmed(out)


#: What may stand in a table cell, the first that fits wins.
_CELL = re.compile(r"`(?P<code>[^`]+)`|\[(?P<label>[^\]]*)\]\((?P<url>[^)\s]+)\)|\*\*(?P<strong>[\s\S]+?)\*\*|\*(?P<em>[^*]+)\*")


def from_markdown(source: str) -> list[dict]:
    out: list[dict] = []
    at = 0
    for m in _CELL.finditer(source):
        out += [text(source[at : m.start()])] if m.start() > at else []
        at = m.end()
        if m["code"] is not None:
            out.append({"type": "inlineCode", "value": m["code"]})
        elif m["url"] is not None:
            out.append(link(m["url"], from_markdown(m["label"])))
        elif m["strong"] is not None:
            out.append({"type": "strong", "children": from_markdown(m["strong"])})
        else:
            out.append({"type": "emphasis", "children": from_markdown(m["em"])})
    return out + ([text(source[at:])] if at < len(source) else [])


def merged(nodes: list[dict]) -> list[dict]:
    """Neighbouring texts as one."""
    out: list[dict] = []
    for same, group in itertools.groupby(nodes, key=lambda n: n["type"] == "text"):
        group = list(group)
        out += [text("".join(n["value"] for n in group))] if same else group
    return out


def tidied(nodes: list[dict]) -> list[dict]:
    """Nodes from a page: texts merged, runs of spaces collapsed, no spaces beside breaks, no breaks at the edges."""
    nodes = [text(re.sub(r"[ \t]{2,}", " ", n["value"])) if n["type"] == "text" else n for n in merged(nodes)]
    for i, n in enumerate(nodes):
        if n["type"] == "text":
            value = n["value"]
            value = value.rstrip(" \t") if i + 1 < len(nodes) and is_break(nodes[i + 1]) else value
            value = value.lstrip(" \t") if i and is_break(nodes[i - 1]) else value
            nodes[i] = text(value)
    return without_edge_breaks([n for n in nodes if n != text("")])
