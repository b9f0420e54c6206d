"""Markdown of a document."""

from __future__ import annotations

import itertools
import re

#: Marks of entities, and characters that show nothing; below, the signs and words of cards, covers and media ("📝", "🔗", "🎥 Video", "Article cover", "Link card preview").
SIGILS = {"mention": "@", "hashtag": "#", "cashtag": "$"}
INVISIBLE = re.compile("[​-‍⁠﻿]")


def emphasised(inner: str, mark: str) -> str:
    """Marks around what shows; white space at the edges stays outside, and nothing visible gets no marks."""
    core = inner.strip()
    if not INVISIBLE.sub("", core):
        return inner
    at = inner.index(core)
    return f"{inner[:at]}{mark}{core}{mark}{inner[at + len(core):]}"


def inline(nodes: list[dict], in_article: bool) -> str:
    """Two breaks or more in a row make a paragraph break."""
    if not any([n["type"] == "break" for n in nodes]):
        return "".join([_one(n, in_article) for n in nodes])
    out = []
    for is_break, group in itertools.groupby(nodes, key=lambda n: n["type"] == "break"):
        group = list(group)
        out.append(("  \n" if len(group) == 1 else "  \n  \n") if is_break else "".join(_one(n, in_article) for n in group))
    return "".join(out)


def _one(node: dict, in_article: bool) -> str:
    kind = node["type"]
    if kind == "text":
        return node["value"]
    if kind == "inlineCode":
        return f"`{node['value']}`"
    if kind == "entity":
        shown = SIGILS[node["kind"]] + node["value"]
        target = f"https://x.com/@{node['value']}" if node["kind"] == "mention" else node["url"]
        return f"[{shown}]({target})" if in_article else shown
    inner = inline(node["children"], in_article)
    if kind == "link":
        url = node["url"]
        bare = re.sub("^https?://", "", inner)
        return f"[{bare if bare and bare != inner and url in (inner, 'https://' + bare) else inner}]({url})"
    return emphasised(inner, "**" if kind == "strong" else "*")


def quoted(parts: list[str]) -> str:
    return "\n> \n".join("\n".join(f"> {line}" for line in part.split("\n")) for part in parts)


def _titled(sign: str, card: dict) -> str:
    return f"{sign} [**{card['title']}**]({card['url']})" if card.get("url") else f"{sign} **{card['title']}**"


def article_card_parts(card: dict) -> list[str]:
    parts = [f"![Article cover]({card['imageUrl']})" if card.get("imageUrl") else "", _titled("📝", card), card.get("description") or ""]
    return [p for p in parts if p]


def link_card(card: dict) -> str:
    parts = [f"![Link card preview]({card['imageUrl']})" if card.get("imageUrl") else "", _titled("🔗", card), card.get("description") or "", f"_From {card['domain']}_" if card.get("domain") else ""]
    return "\n> \n".join(f"> {p}" for p in parts if p)  # lines inside a part aren't quoted again


def media_line(item: dict) -> str:
    if item["kind"] in ("video", "gif"):
        return f"![🎥 Video]({item['posterUrl'] if item.get('posterUrl') is not None else item['url']})"
    return f"![Image]({item['url']})"


def percent(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def poll(node: dict) -> str:
    choices = [f"- {c['label']}" + (f" — {percent(c['percent'])}%" if c.get("percent") is not None else "") for c in node["choices"]]
    return "**Poll**\n" + "\n".join(choices) + (f"\n\n_{node['footer']}_" if node.get("footer") else "")


def quoted_post(post: dict) -> str:
    """Of a quoted post: author, article card, text and media; what it quotes itself isn't shown."""
    author, card = post["author"], post.get("articleCard")
    parts = [f"**{author['name']} (@{author['handle']})**", *(article_card_parts(card) if card else []), inline(post["text"], False), "\n".join(map(media_line, post["media"]))]
    return quoted([p for p in parts if p])


def embed(post: dict) -> str:
    """The first of quoted post, article card and link card."""
    if post.get("quotedTweet"):
        return quoted_post(post["quotedTweet"])
    if post.get("articleCard"):
        return quoted(article_card_parts(post["articleCard"]))
    return link_card(post["linkCard"]) if post.get("linkCard") else ""


def post_lines(post: dict) -> list[str]:
    """Text and poll, then media, then what is embedded; joined by line ends they make the post's body."""
    head = "\n\n".join(p for p in (inline(post["text"], False), poll(post["poll"]) if post.get("poll") else "") if p)
    media, card = [media_line(m) for m in post["media"]], embed(post)
    if card:
        before = "\n\n".join(p for p in (head, "\n".join(media)) if p)
        return [f"{before}\n\n{card}" if before else card]
    return ([head] if head else []) + (["", *media] if media else [])


def thread_lines(posts: list[dict]) -> list[str]:
    return [line for n, post in enumerate(posts) for line in ((["", "---", ""] if n else []) + post_lines(post))]


def table(node: dict) -> str:
    rows = [[cell_text(c) for c in row["children"]] for row in ([node.get("header") or {"children": []}] + node["children"])]
    width = max(1, *map(len, rows))
    shown = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
    return "\n".join([shown[0], f"| {' | '.join(['---'] * width)} |", *shown[1:]])


def cell_text(cell: dict) -> str:
    one_line = re.sub(r"\s*\n\s*", " ", inline(cell["children"], True))
    return one_line.replace("\\", "\\\\").replace("|", "\\|").strip()


def _list(node: dict) -> str:
    marks = (f"{n}. " for n in itertools.count(1)) if node["ordered"] else itertools.repeat("- ")
    return "\n".join(mark + "\n".join(map(block, item["children"])) for mark, item in zip(marks, node["children"], strict=False))


#: Blocks that have a form in the flow of an article; others show nothing there.
BLOCKS = {
    "paragraph": lambda b: inline(b["children"], True),
    "heading": lambda b: f"{'#' * b['depth']} {inline(b['children'], True)}",
    "list": _list,
    "code": lambda b: f"```{b.get('lang') or ''}\n{b['value']}\n```",
    "image": lambda b: f"![{b['alt'] if b.get('alt') is not None else 'Image'}]({b['url']})",
    "video": lambda b: f"![🎥 Video]({b['posterUrl']})",
    "thematicBreak": lambda b: "---",
    "table": table,
    "blockquote": lambda b: "\n".join(f"> {line}" for line in "\n\n".join(map(block, b["children"])).split("\n")),
    "articleCard": lambda b: quoted(article_card_parts(b)),
    "tweet": quoted_post,
}


def block(node: dict) -> str:
    return BLOCKS.get(node["type"], lambda _: "")(node)


def article_body(blocks: list[dict]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(p for p in map(block, blocks) if p)).strip()


def flow(doc: dict) -> list[str]:
    """Lines of the content, which ``body_of`` and ``document`` both show."""
    body = doc["body"]
    if body["type"] == "article":
        content = article_body(body["children"])
        return [content] if content else []
    return thread_lines(body["tweets"] if body["type"] == "thread" else [body])


def body_of(doc: dict, lines: list[str] | None = None) -> str:
    """The content alone, without header and footer; its lines are made unless they are given."""
    return "\n".join(flow(doc) if lines is None else lines).strip()


def document(doc: dict, lines: list[str] | None = None) -> str:
    meta, body = doc["metadata"], doc["body"]
    lines = flow(doc) if lines is None else lines
    by = f"{meta['author']['name']} (@{meta['author']['handle']})"
    if body["type"] == "article":
        parts = [f"# {meta['title']}", "", f"*By {by}*", ""] if meta.get("title") else [f"# Article by {by}", ""]
        parts += [f"![Banner]({body['banner']['url']})", ""] if body.get("banner") else []
    else:
        parts = [f"# {by}", ""]
    return "\n".join([*parts, *lines, "", "---", "", f"> Source: {meta['sourceUrl']}", f"> Date: {meta['date']}"])


def digest(docs: list[dict]) -> str:
    """Several documents with a rule between them."""
    return "\n\n---\n\n".join(document(d).strip() for d in docs) + "\n"
