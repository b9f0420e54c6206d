"""HTML of a document: a page of its own, a fragment, or many on one page."""

from __future__ import annotations

import math
from datetime import UTC, datetime
from decimal import ROUND_HALF_UP, Decimal
from html import escape

from .markdown import SIGILS, percent

#: The look of a page; everything is under one class, so that a fragment leaves other styles alone.
STYLE = """
.document { font: 16px/1.5 system-ui, sans-serif; max-width: 42rem; margin: 1rem auto; color: #111 }
.document img { max-width: 100% }
.document .avatar { width: 40px; height: 40px; border-radius: 50% }
.document .tweet-card { border: 1px solid #ccc; border-radius: 12px; padding: 1rem; margin: 0 0 1rem }
.document table { border-collapse: collapse } .document th, .document td { border: 1px solid #ccc; padding: .25rem .5rem }
"""
#: Counts in the order shown, and their signs.
STATS = [("replies", "💬"), ("reposts", "🔁"), ("likes", "❤️"), ("bookmarks", "🔖"), ("views", "👁")]

# Fixed output format: the elements and class names of the functions below, which style sheets of exported pages go by.


def text(value: str) -> str:
    return escape(value, quote=True).replace("&#x27;", "&#39;")


def attribute(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")


def tenth(n: float) -> str:
    """One decimal, half up, of the exact value."""
    return str(Decimal(n).quantize(Decimal("0.1"), ROUND_HALF_UP))


def count(n: int) -> str:
    if n < 1000:
        return str(n)
    unit, suffix = (1000, "K") if n < 1_000_000 else (1_000_000, "M")
    return (tenth(n / unit) if n / unit < 10 else str(math.floor(n / unit + 0.5))) + suffix


def stats(counts: dict) -> str:
    return " · ".join(f"{sign} {count(counts[key])}" for key, sign in STATS if counts.get(key) is not None)


def shown_date(iso: str) -> str:
    """``Jan 5, 2024`` in UTC; empty for what is no date."""
    try:
        at = datetime.fromisoformat(iso)
    except ValueError:
        return ""
    at = at.astimezone(UTC) if at.tzinfo else at
    return f"{at:%b} {at.day}, {at.year}"


def inline(nodes: list[dict]) -> str:
    return "".join(map(_one, nodes))


def _one(node: dict) -> str:
    kind = node["type"]
    if kind == "text":
        return text(node["value"])
    if kind == "break":
        return "<br>"
    if kind == "inlineCode":
        return f"<code>{text(node['value'])}</code>"
    if kind == "entity":
        return f'<a class="entity entity-{node["kind"]}" href="{attribute(node["url"])}">{SIGILS[node["kind"]]}{text(node["value"])}</a>'
    inner = inline(node["children"])
    if kind == "link":
        return f'<a href="{attribute(node["url"])}">{inner}</a>'
    tag = "strong" if kind == "strong" else "em"
    return f"<{tag}>{inner}</{tag}>"


def box(tag: str, name: str, inner: str) -> str:
    """An element of a class, or nothing around nothing."""
    return f'<{tag} class="{name}">{inner}</{tag}>' if inner else ""


def head(post: dict) -> str:
    by = post["author"]
    face = f'<img class="avatar" src="{attribute(by["avatarUrl"])}" alt="">' if by.get("avatarUrl") else f'<div class="avatar avatar-placeholder">{text((by["name"][:1] or "?").upper())}</div>'
    sign = '<span class="verified" aria-label="Verified">✓</span>' if by.get("verified") else ""
    on = shown_date(post["date"]) if post.get("date") else ""
    return f'<header class="tweet-head">{face}<div class="author"><div class="name">{text(by["name"])}{sign}</div><div class="handle">@{text(by["handle"])}{f" · {text(on)}" if on else ""}</div></div></header>'


def media(items: list[dict]) -> str:
    def tile(m: dict) -> str:
        moving = m["kind"] in ("video", "gif")
        url = (m.get("posterUrl") or m["url"]) if moving else m["url"]
        return f'<div class="media-tile"><img src="{attribute(url)}" alt="{attribute(m.get("alt") or "")}" loading="lazy">{box("div", "media-overlay", "▶" if moving else "")}</div>'

    return box("div", "tweet-media", "".join(map(tile, items)))


def poll(node: dict) -> str:
    def choice(c: dict) -> str:
        share = None if c.get("percent") is None else percent(c["percent"])
        bar = f'<div class="poll-bar"><div class="poll-bar-fill" style="width:{share}%"></div></div>' if share is not None else ""
        return f'<div class="poll-choice">{bar}<span class="poll-label">{text(c["label"])}</span>{box("span", "poll-pct", f"{share}%" if share is not None else "")}</div>'

    return f'<div class="poll">{"".join(map(choice, node["choices"]))}{box("div", "poll-footer", text(node.get("footer") or ""))}</div>'


def card(node: dict, eyebrow: str, name: str) -> str:
    picture = f'<div class="link-card-image"><img src="{attribute(node["imageUrl"])}" alt=""></div>' if node.get("imageUrl") else ""
    body = box("div", "link-card-domain", text(eyebrow)) + f'<div class="link-card-title">{text(node["title"])}</div>' + box("div", "link-card-desc", text(node.get("description") or ""))
    inner = f'{picture}<div class="link-card-body">{body}</div>'
    return f'<a class="{name}" href="{attribute(node["url"])}">{inner}</a>' if node.get("url") or name == "link-card" else f'<div class="{name}">{inner}</div>'


def article_card(node: dict) -> str:
    return card(node, "📝 Article", "link-card article-card")


def quoted(post: dict) -> str:
    return f'<aside class="tweet-card is-quote">{head(post)}{box("div", "tweet-body", inline(post["text"]))}{media(post["media"])}{article_card(post["articleCard"]) if post.get("articleCard") else ""}</aside>'


def source(meta: dict) -> str:
    url = meta["sourceUrl"]
    return f'<div class="source-footer"><a href="{attribute(url)}">{text(url)}</a></div>'


def engagement(counts: dict | None, wanted: bool) -> str:
    return box("footer", "engagement", text(stats(counts))) if wanted and counts else ""


def post(node: dict, meta: dict | None, counts: bool) -> str:
    """A post with everything that it has; cards stand beside quoted posts here."""
    parts = [
        head(node), box("div", "tweet-body", inline(node["text"])), media(node["media"]), poll(node["poll"]) if node.get("poll") else "",
        card(node["linkCard"], node["linkCard"].get("domain") or "", "link-card") if node.get("linkCard") else "", article_card(node["articleCard"]) if node.get("articleCard") else "",
        quoted(node["quotedTweet"]) if node.get("quotedTweet") else "", engagement(node.get("engagement"), counts), source(meta) if meta else "",
    ]
    return f'<article class="tweet-card">{"".join(parts)}</article>'


def table(node: dict) -> str:
    row = lambda r, tag: "<tr>" + "".join(f"<{tag}>{inline(c['children'])}</{tag}>" for c in r["children"]) + "</tr>"
    top = f"<thead>{row(node['header'], 'th')}</thead>" if node.get("header") else ""
    return f"<table>{top}<tbody>{''.join(row(r, 'td') for r in node['children'])}</tbody></table>"


def figure(url: str, alt: str | None, caption: str | None = None) -> str:
    return f'<figure class="article-image"><img src="{attribute(url)}" alt="{attribute(alt or "")}">{f"<figcaption>{text(caption)}</figcaption>" if caption else ""}</figure>'


def blocks(nodes: list[dict], between: str = "") -> str:
    return between.join(map(block, nodes))


def _wrapped(tag: str, inner: str) -> str:
    return f"<{tag}>{inner}</{tag}>"


BLOCKS = {
    "paragraph": lambda b: _wrapped("p", inline(b["children"])),
    "heading": lambda b: _wrapped(f"h{b['depth']}", inline(b["children"])),
    "list": lambda b: _wrapped("ol" if b["ordered"] else "ul", blocks(b["children"])),
    "listItem": lambda b: _wrapped("li", blocks(b["children"])),
    "code": lambda b: f"<pre><code{f' class="lang-{attribute(b["lang"])}"' if b.get('lang') else ''}>{text(b['value'])}</code></pre>",
    "blockquote": lambda b: _wrapped("blockquote", blocks(b["children"])),
    "image": lambda b: figure(b["url"], b.get("alt"), b.get("caption")),
    "video": lambda b: figure(b["posterUrl"], b.get("alt")),
    "thematicBreak": lambda b: "<hr>",
    "table": table,
    "articleCard": article_card,
    "tweet": quoted,
}


def block(node: dict) -> str:
    return BLOCKS.get(node["type"], lambda _: "")(node)


def article(node: dict, meta: dict, counts: bool) -> str:
    on = shown_date(meta["date"]) if meta.get("date") else ""
    by = f'<p class="article-byline">By {text(meta["author"]["name"])} <span class="handle">@{text(meta["author"]["handle"])}</span>{f" · {text(on)}" if on else ""}</p>'
    top = f'<img class="article-banner" src="{attribute(node["banner"]["url"])}" alt="">' if node.get("banner") else ""
    return f'<article class="article">{box("h1", "article-title", text(meta.get("title") or ""))}{by}{top}{engagement(meta.get("engagement"), counts)}<div class="article-body">{blocks(node["children"], chr(10))}</div>{source(meta)}</article>'


def body(doc: dict, counts: bool = False) -> str:
    """The content; a thread says its source under the first post and once more at its end."""
    node, meta = doc["body"], doc["metadata"]
    if node["type"] == "article":
        return article(node, meta, counts)
    if node["type"] == "thread":
        return f'<div class="thread">{"".join(post(p, None if n else meta, counts) for n, p in enumerate(node["tweets"]))}</div>{source(meta)}'
    return post(node, meta, counts)


def _page(title: str, content: str) -> str:
    return f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{text(title)}</title>\n<style>{STYLE}</style></head><body>{content}</body></html>'


def fragment(doc: dict, counts: bool = False) -> str:
    return f'<style>{STYLE}</style><div class="document">{body(doc, counts)}</div>'


def document(doc: dict, counts: bool = False) -> str:
    meta = doc["metadata"]
    title = meta.get("title") or f"{'Thread' if meta['type'] == 'thread' else 'Post'} by @{meta['author']['handle']}"
    return _page(title, f'<div class="document">{body(doc, counts)}</div>')


def card(doc: dict, counts: bool = False) -> str:
    return f'<div class="document">{body(doc, counts)}</div>'


#: What stands between two documents of one page.
CARD_RULE = "\n<hr>\n"


def around_cards(n: str) -> tuple[str, str]:
    """What stands before and behind the cards of a page of n documents."""
    head, _, foot = _page(f"Export ({n})", "\1").partition("\1")
    return head, foot


def many(docs: list[dict], counts: bool = False) -> str:
    return _page(f"Export ({len(docs)})", CARD_RULE.join(card(d, counts) for d in docs))
