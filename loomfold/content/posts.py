"""Documents from posts, articles and conversations as the feed gives them."""

from __future__ import annotations

import math
import re
from datetime import UTC, datetime

from .inline import SITE, from_entities, from_markdown, from_ranges, link, text


def dig(value, *path):
    """What lies at a path of keys and indexes; None where it breaks off."""
    for step in path:
        if isinstance(value, dict):
            value = value.get(step)
        elif isinstance(value, list) and isinstance(step, int) and step < len(value):
            value = value[step]
        else:
            return None
    return value


def first(*values):
    """The first value that is there."""
    for value in values:
        if value is not None:
            return value
    return None


def of(value, key: str):
    """``dig`` for one key, which most of a post is read by."""
    return value.get(key) if isinstance(value, dict) else None


def unwrapped(raw) -> dict:
    """The post inside a visibility wrapper, whatever the wrapper calls itself."""
    raw = raw if isinstance(raw, dict) else {}
    return raw["tweet"] if isinstance(raw.get("tweet"), dict) and raw["tweet"] else raw


def unwrapped_by_name(raw) -> dict:
    """The post inside a wrapper of the one known type."""
    raw = raw if isinstance(raw, dict) else {}
    return raw["tweet"] if raw.get("__typename") == "TweetWithVisibilityResults" and raw.get("tweet") else raw


def is_repost(raw) -> bool:
    return dig(unwrapped(raw), "legacy", "retweeted_status_result") is not None


def author_of(post: dict) -> dict:
    user = dig(post, "core", "user_results", "result") or {}
    core, legacy = of(user, "core"), of(user, "legacy")
    out = {"name": first(of(core, "name"), of(legacy, "name"), ""), "handle": first(of(core, "screen_name"), of(legacy, "screen_name"), "")}
    if avatar := first(of(legacy, "profile_image_url_https"), of(of(user, "avatar"), "image_url")):
        out["avatarUrl"] = avatar
    if user.get("is_blue_verified") or of(legacy, "verified"):
        out["verified"] = True
    return out


#: A date as the feed writes it, in UTC. Reading it by its places takes a tenth of the time of ``strptime``, which reads all others.
_FEED_DATE = re.compile(r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) ([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2}) \+0000 ([1-9][0-9]{3})")
_MONTHS = {name: n for n, name in enumerate(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), 1)}


def _feed_date(created: str) -> str | None:
    """``iso`` of a date in the feed's usual form; None for any other, and for what is no date."""
    if not (m := _FEED_DATE.fullmatch(created)):
        return None
    try:
        return datetime(int(m[6]), _MONTHS[m[1]], int(m[2]), int(m[3]), int(m[4]), int(m[5])).isoformat() + ".000Z"
    except ValueError:
        return None


def iso(created: str | None) -> str:
    """A feed date or an ISO date with milliseconds in UTC; what can't be read stays."""
    if not created:
        return ""
    if usual := _feed_date(created):
        return usual
    for read in (lambda s: datetime.strptime(s, "%a %b %d %H:%M:%S %z %Y"), datetime.fromisoformat):
        try:
            at = read(created)
        except ValueError:
            continue
        at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
        return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
    return created


#: A post's counts and where the feed has them.
COUNTS = [("replies", ("legacy", "reply_count")), ("reposts", ("legacy", "retweet_count")), ("likes", ("legacy", "favorite_count")), ("bookmarks", ("legacy", "bookmark_count")), ("views", ("views", "count"))]


def counts_of(post: dict) -> dict | None:
    out, held = {}, {at: of(post, at) for at in ("legacy", "views")}
    for name, (at, key) in COUNTS:
        value = of(held[at], key)
        if value is not None:
            try:
                out[name] = int(value)
            except (TypeError, ValueError):
                continue
    return out or None


_MEDIA_FILE = re.compile(r"(https://pbs\.twimg\.com/media/[^./?#]+)\.(jpg|jpeg|png|webp)", re.IGNORECASE)


def media_url(url: str) -> str:
    m = _MEDIA_FILE.fullmatch(url)
    return f"{m[1]}?format={m[2].lower()}&name=large" if m else url


def best_variant(variants: list[dict]) -> str | None:
    """The mp4 of the highest bitrate, the first of equals, or else the first that has an address."""
    there = [v for v in variants if v.get("url")]
    mp4 = [v for v in there if v.get("content_type") == "video/mp4"]
    return max(mp4, key=lambda v: v.get("bitrate") or 0)["url"] if mp4 else (there[0]["url"] if there else None)


def media_of(items: list[dict]) -> list[dict]:
    out = []
    for m in items:
        poster, alt = m.get("media_url_https"), m.get("ext_alt_text")
        item = None
        if m.get("type") == "photo" and poster:
            item = {"kind": "image", "url": media_url(poster)}
        elif m.get("type") in ("video", "animated_gif") and (url := best_variant(dig(m, "video_info", "variants") or [])):
            item = {"kind": "gif" if m["type"] == "animated_gif" else "video", "url": url} | ({"posterUrl": media_url(poster)} if poster else {})
        if item:
            out.append(item | ({"alt": alt} if alt else {}))
    return out


def card_of(card: dict | None) -> dict:
    """{poll: ...}, {linkCard: ...} or nothing."""
    if not card:
        return {}
    name = dig(card, "legacy", "name") or ""
    bound: dict[str, dict] = {}
    for b in dig(card, "legacy", "binding_values") or []:
        bound.setdefault(b.get("key"), b.get("value") or {})
    get = lambda key: first(dig(bound.get(key), "string_value"), dig(bound.get(key), "image_value", "url"))
    if re.search(r"poll\d", name):
        labels = []
        for n in range(1, 5):
            if (label := get(f"choice{n}_label")) is None:
                break
            labels.append((label, int(float(get(f"choice{n}_count") or 0))))
        total = sum(n for _, n in labels)
        return {"poll": {"type": "poll", "choices": [{"label": a} | ({"percent": math.floor(n / total * 100 + 0.5)} if total > 0 else {}) for a, n in labels]}}
    if "summary" in name and (title := get("title")):
        more = {"description": get("description"), "imageUrl": first(get("thumbnail_image_large"), get("thumbnail_image"), get("photo_image_full_size_large")), "domain": first(get("domain"), get("vanity_url"))}
        return {"linkCard": {"type": "linkCard", "url": get("card_url") or "", "title": title} | {k: v for k, v in more.items() if v}}
    return {}


def post_node(raw) -> dict:
    """A post with the posts it quotes. Long text brings its own entities; the two are never mixed."""
    post = unwrapped(raw)
    legacy, note = post.get("legacy") or {}, dig(post.get("note_tweet"), "note_tweet_results", "result")
    if of(note, "text") is not None:
        value, entities = note["text"], note.get("entity_set")
    else:
        value, entities = legacy.get("full_text") or "", legacy.get("entities")
    node = {
        "type": "tweet", "author": author_of(post), "date": iso(legacy.get("created_at")), "tweetId": first(post.get("rest_id"), legacy.get("id_str"), ""),
        "text": from_entities(value, entities), "media": media_of(of(legacy.get("extended_entities"), "media") or []),
    }
    if counts := counts_of(post):
        node["engagement"] = counts
    node |= card_of(post.get("card"))
    if quoted := of(post.get("quoted_status_result"), "result"):
        node["quotedTweet"] = post_node(quoted)
    return node


def _document(kind: str, url: str, node: dict, body: dict) -> dict:
    meta = {"type": kind, "sourceUrl": url, "tweetId": node["tweetId"], "author": node["author"], "date": node["date"]}
    return {"version": 1, "metadata": meta | ({"engagement": node["engagement"]} if node.get("engagement") else {}), "body": body}


def post_url(node: dict) -> str:
    return f"{SITE}/{node['author']['handle']}/status/{node['tweetId']}"


def post_document(raw, url: str | None = None) -> dict:
    """The document of a post, or of the article that it carries."""
    post = unwrapped(raw)
    if article := dig(post, "article", "article_results", "result"):
        return article_document(post, article, url)
    node = post_node(raw)
    return _document("tweet", url if url is not None else post_url(node), node, node)


# Articles


def heading_children(nodes: list[dict]) -> list[dict]:
    """A heading that is bold as a whole isn't bold."""
    return nodes[0]["children"] if len(nodes) == 1 and nodes[0]["type"] == "strong" else nodes


def table_cells(line: str) -> list[str] | None:
    """The cells of a table line; \\| is a pipe, and the last pipe may be missing. None if it doesn't begin with a pipe."""
    if not line.startswith("|"):
        return None
    cells = [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line[1:])]
    return cells if cells[-1] else cells[:-1]


def table(source: str) -> dict | None:
    rows = [c for line in source.split("\n") if (c := table_cells(line.strip())) is not None]
    rule = lambda cells: bool(cells) and all(re.fullmatch(r":?-+:?", c) for c in cells)
    row = lambda cells: {"type": "tableRow", "children": [{"type": "tableCell", "children": from_markdown(c)} for c in cells]}
    headed = len(rows) > 1 and rule(rows[1])
    body = [row(c) for c in rows[headed:] if not rule(c)]
    if not headed and not body:
        return None
    return {"type": "table"} | ({"header": row(rows[0])} if headed else {}) | {"children": body}


def markdown_block(source: str | None) -> dict | None:
    """A fenced piece of code or a table; anything else is dropped."""
    source = (source or "").strip()
    if fence := re.fullmatch(r"```([^\n]*)\n([\s\S]*?)\n?```", source):
        language = fence[1].strip()
        return {"type": "code", "value": fence[2].rstrip()} | ({"lang": language} if language else {})
    return table(source) if source.startswith("|") else None


def atomic(block: dict, entities: dict[str, dict], media: dict[str, dict]) -> dict | None:
    key = dig(block, "entityRanges", 0, "key")
    entity = entities.get(str(key)) if key is not None else None
    kind = (entity or {}).get("type")
    if kind == "DIVIDER":
        return {"type": "thematicBreak"}
    if kind == "MARKDOWN":
        return markdown_block(dig(entity, "data", "markdown"))
    if kind == "MEDIA":
        url = dig(media.get(dig(entity, "data", "mediaItems", 0, "mediaId")), "media_info", "original_img_url")
        return {"type": "image", "url": media_url(url)} if url else None
    return None


HEADINGS = {"header-one": 1, "header-two": 2, "header-three": 3}
LISTS = {"unordered-list-item": False, "ordered-list-item": True}


def article_blocks(state: dict, media_entities: list[dict]) -> list[dict]:
    """Blocks of an article's body.

    Items of one kind of list, and quotes, are gathered while they follow each other. An item without
    text adds nothing and doesn't end a run of its own kind, but ends one of the other.
    """
    entities = {str(e["key"]): e["value"] for e in state.get("entityMap") or [] if e.get("key") is not None and e.get("value")}
    media = {m["media_id"]: m for m in media_entities if m.get("media_id")}
    out: list[dict] = []
    run = None  # what is being gathered: "quote", or whether the list is ordered
    for block in state.get("blocks") or []:
        kind = block.get("type") or "unstyled"
        if kind in LISTS or kind == "blockquote":
            wanted = "quote" if kind == "blockquote" else LISTS[kind]
            if (run == "quote") != (wanted == "quote"):
                run = None
            nodes = from_ranges(block, entities)
            if not nodes:
                continue
            if run is None or run != wanted:
                out.append({"type": "blockquote", "children": []} if wanted == "quote" else {"type": "list", "ordered": wanted, "children": []})
                run = wanted
            paragraph = {"type": "paragraph", "children": nodes}
            out[-1]["children"].append(paragraph if wanted == "quote" else {"type": "listItem", "children": [paragraph]})
            continue
        run = None
        if kind == "atomic":
            made = atomic(block, entities, media)
        else:
            nodes = from_ranges(block, entities)
            nodes = heading_children(nodes) if kind in HEADINGS else nodes
            made = ({"type": "heading", "depth": HEADINGS[kind], "children": nodes} if kind in HEADINGS else {"type": "paragraph", "children": nodes}) if nodes else None
        out += [made] if made else []
    return out


def article_document(post: dict, article: dict, url: str | None = None) -> dict:
    """An article with its body, or with its preview and a link where the feed leaves the body out."""
    number = first(post.get("rest_id"), dig(post, "legacy", "id_str"), "")
    own = dig(post, "legacy", "entities", "urls", 0, "expanded_url")
    own = re.sub("^http:", "https:", own) if own is not None else f"{SITE}/i/article/{first(article.get('rest_id'), number)}"
    state = article.get("content_state") or {}
    if state.get("blocks"):
        children = article_blocks(state, article.get("media_entities") or [])
    else:
        preview = article.get("preview_text")
        children = [{"type": "paragraph", "children": nodes} for nodes in ([text(preview)] if preview else [], [link(own, [text("Read the full article on X")])]) if nodes]
    body = {"type": "article", "children": children}
    if cover := dig(article, "cover_media", "media_info", "original_img_url"):
        body["banner"] = {"type": "image", "url": media_url(cover)}
    node = {"tweetId": number, "author": author_of(post), "date": iso(dig(post, "legacy", "created_at"))} | ({"engagement": c} if (c := counts_of(post)) else {})
    out = _document("article", url if url is not None else own, node, body)
    out["metadata"]["title"] = (article.get("title") or "").strip()
    return out


# Feeds and conversations


def timeline_of(raw, depth: int = 6) -> dict | None:
    """The object with the instructions: at a known place, or the first that a search finds down to a depth."""
    data = dig(raw, "data")
    for path in (("bookmark_timeline_v2", "timeline"), ("bookmark_timeline", "timeline"), ("user", "result", "timeline_v2", "timeline"), ("user", "result", "timeline", "timeline")):
        if dig(data, *path, "instructions") is not None:
            return dig(data, *path)
    return _search(data, depth) if data else None


def _search(value, depth: int) -> dict | None:
    if depth < 0 or not isinstance(value, dict | list):
        return None
    if isinstance(value, dict) and isinstance(value.get("instructions"), list):
        return value
    return next((found for v in (value.values() if isinstance(value, dict) else value) if (found := _search(v, depth - 1))), None)


def _entries(instructions) -> list[dict]:
    return [e for i in instructions or [] if i.get("type") == "TimelineAddEntries" for e in i.get("entries") or []]


def _result(holder):
    return dig(holder, "itemContent", "tweet_results", "result")


def feed_page(raw) -> dict:
    """posts in order, the cursor of the next page, and whether the feed ends here (no posts)."""
    posts, cursor = [], None
    for entry in _entries(dig(timeline_of(raw), "instructions")):
        content = entry.get("content") or {}
        if content.get("cursorType") == "Bottom" and isinstance(content.get("value"), str):
            cursor = content["value"]
        elif (own := _result(content)) is not None:
            posts.append(own)
        else:
            posts += [r for it in content.get("items") or [] if (r := _result(it.get("item"))) is not None]
    return {"posts": posts, "cursor": cursor, "done": not posts}


def conversation(raw) -> list[dict]:
    """The posts of a conversation in the order shown."""
    out = []
    for entry in _entries(dig(raw, "data", "threaded_conversation_with_injections_v2", "instructions")):
        content = entry.get("content") or {}
        found = [_result(content)] if content.get("entryType") == "TimelineTimelineItem" else [_result(it.get("item")) for it in content.get("items") or []] if content.get("entryType") == "TimelineTimelineModule" else []
        out += [r for r in found if r is not None]
    return out


def conversation_document(raw, url: str | None = None) -> dict | None:
    """A thread of the first post's author up to the first post by another, or the post or article alone; None without posts."""
    results = conversation(raw)
    if not results:
        return None
    nodes = [] if unwrapped_by_name(results[0]).get("article") else [post_node(r) for r in results]
    handle = nodes[0]["author"]["handle"].lower() if nodes else None
    thread = []
    for node in nodes:
        if node["author"]["handle"].lower() != handle:
            break
        thread.append(node)
    if len(thread) < 2:
        return post_document(results[0], url)
    return _document("thread", url if url is not None else post_url(thread[0]), thread[0], {"type": "thread", "tweets": thread})
