"""Posts with everything that a feed can hold, articles, pages and combined files, each from a row of the customers' table.

The feed's JSON is filled in from columns, and the SQL says what is shown of it.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..content import columns, html
from ..functions import text, urls
from ..operators import checks, export, jobs, ledger, routing
from ..operators.shared import kept, spread
from ..sources import details
from ..streaming import incremental
from .registry import query, table

#: What a template's marks stand for, in both languages.
_MARKS = {"k": "CAST(c_custkey AS STRING)", "seg": "c_mktsegment", "name": "c_name", "n": "CAST(c_nationkey AS STRING)"}


def _filled(template: str, **more: Column) -> Column:
    """A template with ``{{k}}`` and the like from columns."""
    parts = re.split(r"\{\{(\w+)\}\}", template)
    return F.concat(*[(more[p] if p in more else F.expr(_MARKS[p])) if n % 2 else F.lit(p) for n, p in enumerate(parts)])


def _sql(template: str, **more: str) -> str:
    """The same template as SQL."""
    parts = re.split(r"\{\{(\w+)\}\}", template)
    return "(" + " || ".join((more[p] if p in more else _MARKS[p]) if n % 2 else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for n, p in enumerate(parts)) + ")"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def _writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of whom posts and pages are made, which takes far longer than reading their rows."""
    return spread(_customers(spark, sf_dir))


_USER = '"core":{"user_results":{"result":{"core":{"name":"{{name}}","screen_name":"u{{k}}"}}}}'


def _bodies(rows: DataFrame, raw: Column) -> DataFrame:
    """c_custkey, body: the Markdown of raw posts."""
    return rows.select("c_custkey", columns.posts_shown(raw, "body")["body"].alias("body"))


_PIECES = ["Hi ", "@u{{k}}", " see ", "https://t.co/{{k}}", " now ", "#{{seg}}", " ", "${{seg}}", " R&amp;D &lt;{{k}}&gt; \U0001f600\nnext ", "https://t.co/pic{{k}}"]


@query(f"SELECT c_custkey, {_sql('Hi @u{{k}} see [ex.org/{{seg}}](https://ex.org/{{seg}}?a={{k}}) now #{{seg}} ${{seg}} R&D <{{k}}> ' + chr(0x1F600) + '  ' + chr(10) + 'next')} AS body FROM customer")
def post_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions, links, hashtags, cashtags and media by their places in code points; one that overlaps is passed over, entities are decoded."""
    ends, places = F.lit(0), {}
    for n, piece in enumerate(_PIECES):
        start, ends = ends, ends + F.length(_filled(piece))
        places[f"p{n}"] = F.concat(F.lit("["), start.cast("string"), F.lit(","), ends.cast("string"), F.lit("]"))
    raw = _filled(
        '{"rest_id":"{{k}}",' + _USER + ',"legacy":{"full_text":"' + "".join(_PIECES).replace("\n", "\\n") + '","entities":{"hashtags":[{"text":"{{seg}}","indices":{{p5}}},{"text":"inside","indices":{{p3}}}],'
        '"urls":[{"expanded_url":"https://ex.org/{{seg}}?a={{k}}","display_url":"ex.org/{{seg}}","indices":{{p3}}}],"user_mentions":[{"screen_name":"u{{k}}","indices":{{p1}}},{"indices":{{p1}}}],'
        '"symbols":[{"text":"{{seg}}","indices":{{p7}}}],"media":[{"indices":{{p9}}}]}}}',
        **places,
    )
    return _bodies(_writers(spark, sf_dir), raw)


_HIGH = "CASE WHEN c_custkey % 2 = 1 THEN 'hi' ELSE 'mid' END"


@query(f"""
SELECT c_custkey, {_sql('T{{k}}' + chr(10) + chr(10) + '![Image](https://pbs.twimg.com/media/P{{k}}?format=jpg&name=large)' + chr(10) + '![🎥 Video](https://pbs.twimg.com/media/V{{k}}?format=png&name=large)' + chr(10) + '![🎥 Video](https://v/gif{{k}})')} AS body,
       'https://v/' || {_HIGH} || c_custkey AS video, 'alt ' || c_mktsegment AS alt FROM customer
""")
def post_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos in their sized form, videos by their best variant with a poster, animated pictures, and what is no media passed over."""
    rate = F.expr("CASE WHEN c_custkey % 2 = 1 THEN '2000' ELSE '900' END")
    raw = _filled(
        '{"rest_id":"{{k}}",' + _USER + ',"legacy":{"full_text":"T{{k}}","extended_entities":{"media":[{"type":"photo","media_url_https":"https://pbs.twimg.com/media/P{{k}}.JPG","ext_alt_text":"alt {{seg}}"},'
        '{"type":"video","media_url_https":"https://pbs.twimg.com/media/V{{k}}.png","video_info":{"variants":[{"bitrate":100,"content_type":"video/mp4","url":"https://v/low{{k}}"},{"bitrate":1000,"content_type":"video/mp4","url":"https://v/mid{{k}}"},'
        '{"bitrate":{{rate}},"content_type":"video/mp4","url":"https://v/hi{{k}}"},{"bitrate":1000,"content_type":"video/mp4","url":"https://v/late{{k}}"},{"bitrate":9000,"content_type":"video/mp4"},{"content_type":"hls","url":"https://v/m3u8"}]}},'
        '{"type":"animated_gif","video_info":{"variants":[{"url":"https://v/gif{{k}}"}]}},{"type":"video","video_info":{"variants":[]}},{"type":"model3d","media_url_https":"x"}]}}}',
        rate=rate,
    )
    rows = _writers(spark, sf_dir).select("c_custkey", columns.posts_shown(raw, "document", "body").alias("s")).select("c_custkey", "s.*")
    return rows.select("c_custkey", "body", F.get_json_object("document", "$.body.media[1].url").alias("video"), F.get_json_object("document", "$.body.media[0].alt").alias("alt"))


_VOTES = ["c_custkey % 7", "c_custkey % 5", "c_custkey % 3"]
_SHARE = "CASE WHEN total = 0 THEN '' ELSE ' — ' || CAST(floor(100.0 * v{} / total + 0.5) AS INT) || '%' END"


@query(f"""
SELECT c_custkey, 'Q' || c_custkey || chr(10) || chr(10) || '**Poll**' || {" || ".join(f"chr(10) || '- Choice {n + 1}' || {_SHARE.format(n)}" for n in range(3))} AS body
FROM (SELECT *, v0 + v1 + v2 AS total FROM (SELECT c_custkey, {", ".join(f"{v} AS v{n}" for n, v in enumerate(_VOTES))} FROM customer))
""")
def post_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls with shares of the votes, halves up, and none without votes."""
    bound = "".join(f'{{"key":"choice{n + 1}_label","value":{{"string_value":"Choice {n + 1}"}}}},{{"key":"choice{n + 1}_count","value":{{"string_value":"{{{{v{n}}}}}"}}}},' for n in range(3))
    raw = _filled('{"rest_id":"{{k}}",' + _USER + ',"legacy":{"full_text":"Q{{k}}"},"card":{"legacy":{"name":"poll3choice_text_only","binding_values":[' + bound + '{"key":"choice1_label","value":{"string_value":"second of a key"}}]}}}', **{f"v{n}": F.expr(f"CAST({v} AS STRING)") for n, v in enumerate(_VOTES)})
    return _bodies(_writers(spark, sf_dir), raw)


@query(f"""
SELECT c_custkey, {_sql('L{{k}}' + chr(10) + chr(10) + '> ![Link card preview](https://i/{{k}})' + chr(10) + '> ' + chr(10) + '> 🔗 [**{{seg}}**](https://t.co/{{k}})')}
  || CASE WHEN c_custkey % 2 = 1 THEN {_sql(chr(10) + '> ' + chr(10) + '> about {{name}}')} ELSE '' END || {_sql(chr(10) + '> ' + chr(10) + '> _From ex.org_')} AS body FROM customer
""")
def post_link_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of links: picture, title, description where there is one, and domain."""
    about = F.expr("""CASE WHEN c_custkey % 2 = 1 THEN concat('{"key":"description","value":{"string_value":"about ', c_name, '"}},') ELSE '' END""")
    raw = _filled(
        '{"rest_id":"{{k}}",' + _USER + ',"legacy":{"full_text":"L{{k}}"},"card":{"legacy":{"name":"summary_large_image","binding_values":[{{about}}{"key":"title","value":{"string_value":"{{seg}}"}},{"key":"vanity_url","value":{"string_value":"ex.org"}},'
        '{"key":"card_url","value":{"string_value":"https://t.co/{{k}}"}},{"key":"thumbnail_image","value":{"image_value":{"url":"https://i/{{k}}"}}}]}}}',
        about=about,
    )
    return _bodies(_writers(spark, sf_dir), raw)


@query(f"""
SELECT c_custkey, {_sql('Main {{seg}}' + chr(10) + chr(10) + '> **Bob (@bob{{k}})**' + chr(10) + '> ' + chr(10) + '> one  ' + chr(10) + '> two' + chr(10) + '> ' + chr(10) + '> ![Image](https://pbs.twimg.com/media/P{{k}}?format=png&name=large)')} AS body FROM customer
""")
def post_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted posts behind wrappers, with lines and media; what they quote themselves isn't shown. Long text stands for the short one."""
    inner = '{"rest_id":"9","core":{"user_results":{"result":{"legacy":{"name":"Bob","screen_name":"bob{{k}}"}}}},"legacy":{"full_text":"one\\ntwo","extended_entities":{"media":[{"type":"photo","media_url_https":"https://pbs.twimg.com/media/P{{k}}.png"}]}},"quoted_status_result":{"result":{"rest_id":"1","legacy":{"full_text":"deep"}}}}'
    main = '{"rest_id":"{{k}}",' + _USER + ',"legacy":{"full_text":"short"},"note_tweet":{"note_tweet_results":{"result":{"text":"Main {{seg}}"}}},"quoted_status_result":{"result":{"__typename":"TweetWithVisibilityResults","tweet":' + inner + "}}}"
    return _bodies(_writers(spark, sf_dir), _filled('{"__typename":"TweetWithVisibilityResults","tweet":' + main + "}"))


@query("""
SELECT c_custkey, CAST(c_custkey AS BIGINT) AS likes, CAST(c_custkey % 10 AS BIGINT) AS replies, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS BIGINT) END AS bookmarks,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey * 3 AS BIGINT) END AS views, c_custkey % 3 = 0 AS is_repost, 'u' || c_custkey AS handle, '2024-03-02T07:08:09.000Z' AS date FROM customer
""")
def post_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, author and date of posts as columns; what is no number is no count. Reposts are told before any tree is built."""
    marks = F.expr("""CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('"bookmark_count":', c_custkey % 4, ',') END""")
    views, again = F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_custkey * 3 AS STRING) END"), F.expr("""CASE WHEN c_custkey % 3 = 0 THEN ',"retweeted_status_result":{"result":{}}' ELSE '' END""")
    few = F.expr("CAST(c_custkey % 10 AS STRING)")
    raw = _filled('{"tweet":{"rest_id":"{{k}}",' + _USER + ',"views":{"count":"{{views}}"},"legacy":{{{marks}}"created_at":"Sat Mar 02 07:08:09 +0000 2024","favorite_count":{{k}},"reply_count":{{few}},"full_text":"x"{{again}}}}}'.replace("{{{", "{{{"), marks=marks, views=views, again=again, few=few)
    rows = columns.post_rows(_writers(spark, sf_dir).withColumn("raw", raw), F.col("raw"))
    return rows.select("c_custkey", "counts.likes", "counts.replies", "counts.bookmarks", "counts.views", columns.is_repost("raw").alias("is_repost"), "author.handle", "date")


_ARTICLE = "\n\n".join(["## Head {{seg}}", "plain **bold** [site](https://ex.org/{{k}})", "- one\n- two {{k}}", "1. first", "> q1\n> \n> q2", "---", "```py\nx = {{k}}\n```", "| a | {{seg}} |\n| --- | --- |\n| 1 | c\\|d |", "![Image](https://pbs.twimg.com/media/A{{k}}?format=jpg&name=large)", "end"])


@query(f"SELECT c_custkey, {_sql(_ARTICLE)} AS body, 'Title ' || c_mktsegment AS title, 'article' AS type FROM customer")
def article_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of headings, styled runs, links, lists, quotes, rules, code, tables and pictures."""
    block = lambda kind, value, more="": f'{{"type":"{kind}","text":"{value}"{more}}}'
    atom = lambda key: block("atomic", " ", f',"entityRanges":[{{"offset":0,"length":1,"key":{key}}}]')
    blocks = ",".join([
        block("header-two", "Head {{seg}}", ',"inlineStyleRanges":[{"offset":0,"length":{{whole}},"style":"Bold"}]'),
        block("unstyled", "plain bold site", ',"inlineStyleRanges":[{"offset":6,"length":4,"style":"BOLD"}],"entityRanges":[{"offset":11,"length":4,"key":5}]'),
        block("unordered-list-item", "one"), block("unordered-list-item", ""), block("unordered-list-item", "two {{k}}"), block("ordered-list-item", "first"), block("blockquote", "q1"), block("blockquote", "q2"),
        atom(1), atom(2), atom(3), atom(4), atom(99), block("unstyled", ""), block("unstyled", "end"),
    ])
    entities = (
        '[{"key":1,"value":{"type":"DIVIDER"}},{"key":"2","value":{"type":"MARKDOWN","data":{"markdown":"```py\\nx = {{k}}\\n```"}}},{"key":3,"value":{"type":"MARKDOWN","data":{"markdown":"| a | {{seg}} |\\n|---|---|\\n| 1 | c\\\\|d |"}}},'
        '{"key":4,"value":{"type":"MEDIA","data":{"mediaItems":[{"mediaId":"m"}]}}},{"key":5,"value":{"type":"LINK","data":{"url":"https://ex.org/{{k}}"}}}]'
    )
    raw = _filled(
        '{"rest_id":"{{k}}",' + _USER + ',"legacy":{},"article":{"article_results":{"result":{"title":" Title {{seg}} ","content_state":{"blocks":[' + blocks + '],"entityMap":' + entities + '},"media_entities":[{"media_id":"m","media_info":{"original_img_url":"https://pbs.twimg.com/media/A{{k}}.jpg"}}]}}}}',
        whole=F.length(_filled("Head {{seg}}")).cast("string"),
    )
    rows = _writers(spark, sf_dir).select("c_custkey", columns.posts_shown(raw, "metadata", "body").alias("s")).select("c_custkey", "s.*")
    return rows.select("c_custkey", "body", F.get_json_object("metadata", "$.title").alias("title"), F.get_json_object("metadata", "$.type").alias("type"))


_PREVIEW = "# T {{k}}\n\n*By {{name}} (@u{{k}})*\n\n![Banner](https://pbs.twimg.com/media/B{{k}}?format=png&name=large)\n\nShort {{seg}}\n\n[Read the full article on X](https://x.com/i/article/7{{k}})\n\n---\n\n> Source: https://x.com/i/article/7{{k}}\n> Date: 2024-03-02T07:08:09.000Z"


@query(f"SELECT c_custkey, {_sql(_PREVIEW)} AS markdown FROM customer")
def article_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose body the feed leaves out, with their cover."""
    raw = _filled(
        '{"rest_id":"{{k}}",' + _USER + ',"legacy":{"created_at":"Sat Mar 02 07:08:09 +0000 2024"},"article":{"article_results":{"result":{"rest_id":"7{{k}}","title":"T {{k}}","preview_text":"Short {{seg}}","cover_media":{"media_info":{"original_img_url":"https://pbs.twimg.com/media/B{{k}}.png"}}}}}}'
    )
    return _writers(spark, sf_dir).select("c_custkey", columns.posts_shown(raw, "markdown")["markdown"].alias("markdown"))


_PAGE = (
    '<main><article role="article"><div data-testid="User-Name"><a href="/u{{k}}">{{name}}</a><a href="/u{{k}}">@u{{k}}</a></div><div data-testid="tweetText"><span>Hello  {{seg}} </span><img alt="x{{n}}" src="e.svg"><a href="https://ex.org/{{k}}">ex.org/{{k}}</a></div>'
    '<div data-testid="tweetPhoto"><img alt="Pic" src="https://pbs.twimg.com/media/P{{k}}?format=jpg&amp;name=small"></div><div data-testid="tweetPhoto"><img src="https://pbs.twimg.com/emoji/x.png"></div><a href="/u{{k}}/status/{{k}}"><time datetime="2024-03-02T07:08:09.000Z"></time></a></article>'
    '<article role="article"><div data-testid="User-Name"><a href="/ad">Ad</a><a href="/ad">@ad</a><span>Promoted</span></div><div data-testid="tweetText">buy</div></article>'
    '<article role="article"><div data-testid="User-Name"><a href="/u{{k}}">{{name}}</a><a href="/u{{k}}">@u{{k}}</a></div><div data-testid="tweetText">second</div><a href="/u{{k}}/status/9{{k}}"><time datetime="2024-03-02T07:09:09.000Z"></time></a></article>'
    '<article role="article"><div data-testid="User-Name"><a href="/other">Other</a><a href="/other">@other</a></div><div data-testid="tweetText">reply</div></article></main>'
)


@query(f"""
SELECT c_custkey, {_sql('Hello {{seg}} x{{n}}[ex.org/{{k}}](https://ex.org/{{k}})' + chr(10) + chr(10) + '![Image](https://pbs.twimg.com/media/P{{k}}?format=jpg&name=large)' + chr(10) + chr(10) + '---' + chr(10) + chr(10) + 'second')} AS body,
       'thread' AS type, 'u' || c_custkey AS handle, c_name AS author, '2024-03-02T07:08:09.000Z' AS date, 'https://x.com/u' || c_custkey || '/status/' || c_custkey AS source_url FROM customer
""")
def page_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads from pages: authors, text with pictures of signs and links, media, dates; advertisements and others' posts left out."""
    rows = _writers(spark, sf_dir)
    made = columns.documents_of_pages(rows.select("c_custkey", _filled("https://x.com/u{{k}}/status/{{k}}").alias("url"), _filled(_PAGE).alias("html")), id_col="c_custkey")
    read = columns.wire_rows(made)
    return read.select("c_custkey", columns.markdown_body_of("document").alias("body"), "type", "author.handle", F.col("author.name").alias("author"), "date", "source_url")


def _of_list(values: list, key: str = "c_custkey") -> Column:
    """The value at a row's place in a list, going round."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _sql_list(values: list, key: str = "c_custkey") -> str:
    shown = ", ".join("NULL" if v is None else str(v) if isinstance(v, bool | int | float) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{shown}][{key} % {len(values)} + 1]"


#: (address, allowed image, permalink, post's number, path on the site, sized media, of the site's hosts)
_URLS = [
    ("https://pbs.twimg.com/media/Ab.PNG", True, None, None, None, "https://pbs.twimg.com/media/Ab?format=png&name=large", False),
    ("http://pbs.twimg.com/media/Ab.png", False, None, None, None, "http://pbs.twimg.com/media/Ab.png", False),
    ("https://x.com/ana/status/12/photo/1?s=20", False, "https://x.com/ana/status/12", "12", "/ana/status/12/photo/1?s=20", "https://x.com/ana/status/12/photo/1?s=20", True),
    ("https://evil.org/https://pbs.twimg.com/a.jpg", False, None, None, None, "https://evil.org/https://pbs.twimg.com/a.jpg", False),
    ("/ana/status/34", False, None, "34", "/ana/status/34", "/ana/status/34", True),
    ("//video.twimg.com/x.mp4", False, None, None, "//video.twimg.com/x.mp4", "//video.twimg.com/x.mp4", False),
    ("https://abs.twimg.com.evil.org/x.png", False, None, None, None, "https://abs.twimg.com.evil.org/x.png", False),
    ("https://www.x.com/bob/status/56#m", False, "https://www.x.com/bob/status/56", "56", "/bob/status/56#m", "https://www.x.com/bob/status/56#m", False),
]


@query("SELECT c_custkey, " + ", ".join(f"{_sql_list([u[n] for u in _URLS])} AS {name}" for n, name in enumerate(["url", "allowed", "permalink", "number", "path", "media", "of_site"])) + " FROM customer")
def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow-list, permalink, number, path and sized form of addresses, sound ones and ones that only look so."""
    url = F.col("url")
    rows = _customers(spark, sf_dir).select("c_custkey", _of_list([u[0] for u in _URLS]).alias("url"))
    return rows.select("c_custkey", "url", urls.allowed_image(url).alias("allowed"), urls.permalink(url).alias("permalink"), urls.status_id(url).alias("number"), urls.site_path(url).alias("path"), urls.media_url(url).alias("media"), urls.host_matches(url, ["x.com"]).alias("of_site"))


#: (link, its text, target), and (label, replies), and (status, what it means), and (token, format, mode)
_LINKS = [("https://t.co/a", "https://ex.org/long", "https://ex.org/long"), ("https://t.co/a", "ex.org/x", "https://ex.org/x"), ("https://t.co/a", "no address", "https://t.co/a"), ("//ex.org/y", "y", "https://ex.org/y"), ("https://ex.org/z", "q.org/z", "https://ex.org/z")]
_LABELS = [("12 replies, 3 likes", 12), ("1,234 Replies", 1234), ("3.4K replies", 3400), ("2M replies", 2_000_000), ("no such", None), ("5 likes", None)]
_STATUS = [(429, "rate_limit"), (503, "transient"), (None, "transient"), (404, "permanent"), (500, "transient")]
_TOKENS = [("copy-txt", "txt", "copy"), ("csv", "csv", "download"), ("download", None, "download"), ("copy", None, "copy"), ("nope", None, None), ("json", "json", "download")]


@query(
    f"SELECT c_custkey, {_sql_list([x[2] for x in _LINKS])} AS target, CAST({_sql_list([x[1] for x in _LABELS])} AS BIGINT) AS replies, {_sql_list([x[1] for x in _STATUS])} AS error, {_sql_list([x[1] for x in _TOKENS])} AS format, {_sql_list([x[2] for x in _TOKENS])} AS mode, "
    "CAST(CASE WHEN c_nationkey = 0 THEN 0 ELSE floor(100.0 * (c_custkey % (c_nationkey + 1)) / c_nationkey + 0.5) END AS INT) AS percent, "
    "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'BUILDING' END AS coerced, c_custkey % 4 IN (0, 3) AND c_custkey % 3 <> 0 AS valid FROM customer"
)
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of shortened links, counts in labels, classes of errors, actions, progress, known choices and valid results."""
    rows = _customers(spark, sf_dir)
    key = F.col("c_custkey")
    act = routing.action(_of_list([x[0] for x in _TOKENS]))
    done = key % (F.col("c_nationkey") + 1)
    return rows.select(
        "c_custkey", urls.external_url(_of_list([x[0] for x in _LINKS]), _of_list([x[1] for x in _LINKS])).alias("target"), text.engagement_count(_of_list([x[0] for x in _LABELS]), "replies").alias("replies"),
        jobs.error_class(_of_list([x[0] for x in _STATUS])).alias("error"), act["format"].alias("format"), act["mode"].alias("mode"), jobs.progress_percent(F.floor(done / 2), done - F.floor(done / 2), F.col("c_nationkey")).alias("percent"),
        export.coerced(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], "BUILDING").alias("coerced"), jobs.valid_result(key % 4 != 1, F.when(key % 4 != 2, F.lit("m")), F.when(key % 3 != 0, F.lit("n"))).alias("valid"),
    )


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""
SELECT doc_id, sha256({_TRIM.format(r"replace(replace(regexp_replace(t, '\s*\n\s*', ' ', 'g'), '\', '\\'), '|', '\|')")}) AS cell_sha256, sha256(regexp_replace(t, '[ \t]{{2,}}', ' ', 'g')) AS runs_sha256,
       sha256(CASE WHEN {_TRIM.format('t')} = '' THEN t ELSE regexp_extract(t, '^\s*') || '**' || {_TRIM.format('t')} || '**' || regexp_extract(t, '\s*$') END) AS strong_sha256, sha256(regexp_replace(t, '^@', '')) AS bare_sha256
FROM (SELECT doc_id, '@ ' || coalesce(text, '') || ' ' AS t FROM documents)
""")
def text_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as table cells, with runs of spaces as one, in marks that leave edge white space outside, and without a handle's sign."""
    t = F.col("t")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("@ "), F.coalesce("text", F.lit("")), F.lit(" ")).alias("t"))
    return rows.select("doc_id", F.sha2(text.table_cell(t), 256).alias("cell_sha256"), F.sha2(text.space_runs_collapsed(t), 256).alias("runs_sha256"), F.sha2(text.emphasised(t, "**"), 256).alias("strong_sha256"), F.sha2(text.bare_handle(t), 256).alias("bare_sha256"))


# The order and the ledger of a run


@query("""
SELECT event_id, event_type IN ('purchase', 'error') AS needs_detail FROM events
WHERE event_type <> 'click' AND user_id = 3 AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-06'
""")
def run_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner's own posts of a range of days, and which need their details."""
    events = table(spark, sf_dir, "events")
    items = events.select("event_id", F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("handle"), (F.col("event_type") == "click").alias("is_repost"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").isin("purchase", "error").alias("is_article"))
    taken = incremental.filtered(items, incremental.Rules(owner="uSER3", first_day="2024-01-05", last_day="2024-01-02"))
    return incremental.with_expansion(taken, incremental.Rules()).select("event_id", "needs_detail")


@query("""
WITH d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AS old FROM documents),
l AS (SELECT doc_id FROM d WHERE NOT old ORDER BY doc_id LIMIT 50)
SELECT (SELECT count(*) FROM l) AS taken, (SELECT count(*) FROM d WHERE old AND (doc_id < (SELECT max(doc_id) FROM l) OR (SELECT count(*) FROM l) < 50)) AS skipped
""")
def ledger_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many exported items a run passes until it has its number."""
    return ledger.exclusion_counts(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", 50, "doc_id")


@query("SELECT count(*) AS n_new FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND doc_id % 5 <> 0")
def ledger_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items are neither queued nor exported."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return ledger.new_count(docs, docs.where("doc_id % 5 = 0"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT key, min(seq) AS seq FROM (SELECT o_orderkey AS key, o_orderkey AS seq FROM orders UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 3 = 0) GROUP BY key")
def ledger_both_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ids that an item is known by enter the ledger, each once."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE WHEN o_custkey % 3 = 0 THEN o_custkey END").alias("other"), F.col("o_orderkey").alias("at"))
    return ledger.ledger_entries(rows, ["o_orderkey", "other"], "at")


@query("""
WITH s AS (SELECT min(event_id) AS stop FROM events WHERE event_type = 'purchase' AND event_id > 50),
o AS (SELECT event_id, user_id, CASE WHEN event_id > (SELECT stop FROM s) THEN 'pending' WHEN event_type = 'error' THEN 'gone' WHEN event_type = 'purchase' AND event_id > 50 THEN 'rate_limit' WHEN event_type = 'purchase' THEN 'gone' ELSE 'done' END AS status FROM events)
SELECT event_id, user_id, status, status IN ('done', 'gone') OR user_id % 7 = 0 AS settled FROM o
""")
def run_settles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run leaves pending once the rate limit stops it, and what may enter the ledger: what is done, gone, or needs no detail."""
    status = F.when(F.col("event_type") == "error", "gone").when((F.col("event_type") == "purchase") & (F.col("event_id") > 50), "rate_limit").when(F.col("event_type") == "purchase", "gone").otherwise("done")
    run = ledger.stopped(table(spark, sf_dir, "events").select("event_id", "user_id", status.alias("status")), "event_id", "status")
    return run.withColumn("settled", ledger.settled(F.col("status"), F.col("user_id") % 7 != 0))


@query("""
SELECT user_id AS key, max(event_id) AS last, min(event_id) AS pos FROM events WHERE user_id % 3 = 0 GROUP BY user_id
""")
def run_finalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged documents that a job's index names, the last of each, with their places."""
    events = table(spark, sf_dir, "events")
    wanted = events.where("user_id % 3 = 0").groupBy(F.col("user_id").alias("key")).agg(F.min("event_id").alias("pos"))
    return ledger.finalised(events.select(F.col("user_id").alias("key"), F.col("event_id").alias("staged_at"), F.col("event_id").alias("last")), wanted, "key", "pos").select("key", "last", "pos")


@query("""
SELECT user_id, 'c' || max(page) AS cursor FROM (
  SELECT user_id, page, min(CASE WHEN whole THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY page) AS every_one
  FROM (SELECT user_id, event_id // 200 AS page, bool_and(event_type <> 'error') AS whole FROM events GROUP BY user_id, event_id // 200)) WHERE every_one = 1 GROUP BY user_id
""")
def run_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursor from which each source goes on: that of the last page before one that wasn't taken as a whole."""
    items = table(spark, sf_dir, "events").select("user_id", "event_type", F.expr("event_id div 200").alias("page")).withColumn("cursor", F.concat(F.lit("c"), F.col("page").cast("string")))
    return routing.resume_frontier(items, "user_id", "page", "cursor", F.col("event_type") != "error")


# Combined files


_RUN_POST = '{"rest_id":"{{k}}",' + _USER + ',"legacy":{"full_text":"**Hi** {{seg}}, \\"{{k}}\\"","favorite_count":{{k}},"created_at":"Sat Mar 02 07:08:09 +0000 2024"}}'


def _runs(spark: SparkSession, sf_dir: str, **parts) -> DataFrame:
    """Posts in runs of 100, with what every format needs, or only the parts that are named as in ``post_rows``."""
    rows = _writers(spark, sf_dir).select("c_custkey", F.expr("c_custkey div 100").alias("run"), _filled(_RUN_POST).alias("_raw"))
    return columns.post_rows(rows, F.col("_raw"), **(parts or {"body": True, "document": True})).drop("_raw")


_TAIL = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
_TXT = f"c_name || ' (@u' || c_custkey || ')' || chr(10) || chr(10) || 'Hi ' || c_mktsegment || ', \"' || c_custkey || '\"' || {_TAIL} || 'Source: https://x.com/u' || c_custkey || '/status/' || c_custkey || chr(10) || 'Date: 2024-03-02T07:08:09.000Z' || chr(10)"
_CSV = "'2024-03-02T07:08:09.000Z,' || c_name || ',u' || c_custkey || ',tweet,' || c_custkey || ',,,,,https://x.com/u' || c_custkey || '/status/' || c_custkey || ',\"Hi ' || c_mktsegment || ', \"\"' || c_custkey || '\"\"\"'"


def _file_sql(content: str) -> str:
    return f"SELECT run, n_items, ext, mime, sha256(content) AS content_sha256, name FROM (SELECT c_custkey // 100 AS run, count(*) AS n_items, {content} FROM customer GROUP BY run)"


def _files(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    parts = {"body": True, "markdown": False} if fmt == "csv" else {}
    made = export.combined_files(_runs(spark, sf_dir, **parts), "run", "c_custkey", fmt, export.Options())
    return made.select("run", "n_items", "ext", "mime", F.sha2("content", 256).alias("content_sha256"), F.lit(export.combined_name(fmt, "2024-03-02")).alias("name"))


@query(_file_sql(f"'txt' AS ext, 'text/plain' AS mime, 'x-compilation-20240302.txt' AS name, string_agg({_TXT}, {_TAIL} ORDER BY c_custkey) || chr(10) AS content"))
def combined_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as one text each."""
    return _files(spark, sf_dir, "txt")


@query(_file_sql(f"'csv' AS ext, 'text/csv' AS mime, 'x-compilation-20240302.csv' AS name, 'date,author,handle,type,likes,reposts,replies,bookmarks,views,source,text' || chr(10) || string_agg({_CSV}, chr(10) ORDER BY c_custkey) || chr(10) AS content"))
def combined_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as one table each."""
    return _files(spark, sf_dir, "csv")


@query("SELECT c_custkey // 100 AS run, count(*) AS n_items, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS ids, 'json' AS ext, '[' || chr(10) || '  {' AS opening FROM customer GROUP BY run")
def combined_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as one array each, read back into its posts' ids."""
    made = export.combined_files(_runs(spark, sf_dir), "run", "c_custkey", "json", export.Options())
    ids = F.from_json(F.get_json_object("content", "$[*].metadata.tweetId"), "array<string>")
    return made.select("run", "n_items", F.array_join(ids, ",").alias("ids"), "ext", F.substring("content", 1, 5).alias("opening"))


_SEGMENT = "'**Hi** ' || c_mktsegment || ', "
_PAGE_HEAD = "'<!doctype html>' || chr(10) || '<html lang=\"en\"><head><meta charset=\"utf-8\"><title>' || {} || '</title>' || chr(10) || '<style>" + html.STYLE.replace("{", "{{").replace("}", "}}") + "</style></head><body>'"
_CARD = (
    "'<div class=\"document\"><article class=\"tweet-card\"><header class=\"tweet-head\"><div class=\"avatar avatar-placeholder\">C</div><div class=\"author\"><div class=\"name\">' || c_name || '</div><div class=\"handle\">@u' || c_custkey || ' · Mar 2, 2024</div></div></header>'"
    f" || '<div class=\"tweet-body\">' || {_SEGMENT}&quot;' || c_custkey || '&quot;</div><div class=\"source-footer\"><a href=\"https://x.com/u' || c_custkey || '/status/' || c_custkey || '\">https://x.com/u' || c_custkey || '/status/' || c_custkey || '</a></div></article></div>'"
)
_MD = (
    "'---' || chr(10) || 'author: \"' || c_name || '\"' || chr(10) || 'handle: \"u' || c_custkey || '\"' || chr(10) || 'source: \"https://x.com/u' || c_custkey || '/status/' || c_custkey || '\"' || chr(10) || 'date: 2024-03-02T07:08:09.000Z' || chr(10) || 'type: tweet' || chr(10) || 'likes: ' || c_custkey || chr(10) || '---' || chr(10)"
    f" || '# ' || c_name || ' (@u' || c_custkey || ')' || chr(10) || chr(10) || {_SEGMENT}\"' || c_custkey || '\"'"
)


def _pretty(value) -> str:
    """A template's JSON, two spaces a level, as an SQL string in which ${k}, ${name} and ${seg} are columns."""
    said = json.dumps(value, ensure_ascii=False, indent=2).replace("'", "''")
    for name, column in (("${k}", "c_custkey"), ("${name}", "c_name"), ("${seg}", "c_mktsegment")):
        said = said.replace(f'"#{name}"', name).replace(name, f"' || {column} || '")
    return "'" + said.replace("\n", "' || chr(10) || '") + "'"


_WHO = {"name": "${name}", "handle": "u${k}"}
_JSON = _pretty({
    "version": 1, "metadata": {"type": "tweet", "sourceUrl": "https://x.com/u${k}/status/${k}", "tweetId": "${k}", "author": _WHO, "date": "2024-03-02T07:08:09.000Z", "engagement": {"likes": "#${k}"}},
    "body": {"type": "tweet", "author": _WHO, "date": "2024-03-02T07:08:09.000Z", "tweetId": "${k}", "text": [{"type": "text", "value": '**Hi** ${seg}, "${k}"'}], "media": [], "engagement": {"likes": "#${k}"}},
})


@query(f"""
SELECT c_custkey // 100 AS run, count(*) AS n_items, 'html' AS ext, 'Export (' || count(*) || ')' AS title,
  sha256({_PAGE_HEAD.format("'Export (' || count(*) || ')'")} || string_agg({_CARD}, chr(10) || '<hr>' || chr(10) ORDER BY c_custkey) || '</body></html>') AS content_sha256
FROM customer GROUP BY run
""")
def combined_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as one page each under one style sheet, a rule between posts, by their whole contents."""
    made = export.combined_files(_runs(spark, sf_dir), "run", "c_custkey", "html", export.Options())
    return made.select("run", "n_items", "ext", F.regexp_extract("content", "<title>([^<]*)</title>", 1).alias("title"), F.sha2("content", 256).alias("content_sha256"))


@query(f"""
SELECT c_custkey, ext, 'u' || c_custkey || '-' || c_custkey || '.' || ext AS name, CASE ext WHEN 'md' THEN 'text/markdown' WHEN 'txt' THEN 'text/plain' WHEN 'json' THEN 'application/json' ELSE 'text/html' END AS mime,
  sha256(CASE ext WHEN 'md' THEN {_MD} WHEN 'txt' THEN {_TXT} WHEN 'json' THEN {_JSON} ELSE {_PAGE_HEAD.format("'Post by @u' || c_custkey")} || {_CARD} || '</body></html>' END) AS content_sha256
FROM customer, (SELECT unnest(['md', 'txt', 'json', 'html']) AS ext)
""")
def item_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each post as a file of its own in every format that has one, by their whole contents."""
    rows = _runs(spark, sf_dir, more=("html", "json")).withColumn("made", F.struct("markdown", "html", "json"))
    files = export.every_item_file(export.post_processed(rows, export.Options()), ("md", "txt", "json", "html"), F.col("made"))
    return files.select("c_custkey", "ext", "name", "mime", F.sha2("content", 256).alias("content_sha256"))


# Notes, fragments, links and choices

_SAID = ["<Hi> \"{{seg}}\"\nnext ", "https://t.co/1", " ", "#{{seg}}"]
_SHOWN = (
    '<article class="tweet-card"><header class="tweet-head"><div class="avatar avatar-placeholder">C</div><div class="author"><div class="name">{{name}}</div><div class="handle">@u{{k}} · Mar 2, 2024</div></div></header>'
    '<div class="tweet-body">&lt;Hi&gt; &quot;{{seg}}&quot;<br>next <a href="https://ex.org/{{seg}}?a=1&amp;b">ex.org</a> <a class="entity entity-hashtag" href="https://x.com/hashtag/{{seg}}">#{{seg}}</a></div>'
    '<div class="tweet-media"><div class="media-tile"><img src="https://pbs.twimg.com/media/P{{k}}?format=png&amp;name=large" alt="a &quot;b&quot;" loading="lazy"></div></div>'
    '<div class="poll"><div class="poll-choice"><div class="poll-bar"><div class="poll-bar-fill" style="width:100%"></div></div><span class="poll-label">A</span><span class="poll-pct">100%</span></div></div>'
    '<div class="source-footer"><a href="https://x.com/u{{k}}/status/{{k}}">https://x.com/u{{k}}/status/{{k}}</a></div></article>'
)


@query(f"SELECT c_custkey, {_sql(_SHOWN)} AS fragment FROM customer")
def html_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as pieces of HTML: heads, escaped text, entities, media, polls and sources."""
    ends, places = F.lit(0), {}
    for n, piece in enumerate(_SAID):
        start, ends = ends, ends + F.length(_filled(piece))
        places[f"p{n}"] = F.concat(F.lit("["), start.cast("string"), F.lit(","), ends.cast("string"), F.lit("]"))
    said = "".join(_SAID).replace('"', '\\"').replace("\n", "\\n")
    raw = _filled(
        '{"rest_id":"{{k}}",' + _USER + ',"legacy":{"full_text":"' + said + '","created_at":"Sat Mar 02 07:08:09 +0000 2024","entities":{"urls":[{"expanded_url":"https://ex.org/{{seg}}?a=1&b","display_url":"ex.org","indices":{{p1}}}],'
        '"hashtags":[{"text":"{{seg}}","indices":{{p3}}}]},"extended_entities":{"media":[{"type":"photo","media_url_https":"https://pbs.twimg.com/media/P{{k}}.png","ext_alt_text":"a \\"b\\""}]}},'
        '"card":{"legacy":{"name":"poll2choice","binding_values":[{"key":"choice1_label","value":{"string_value":"A"}},{"key":"choice1_count","value":{"string_value":"1"}}]}}}',
        **places,
    )
    page = columns.posts_shown(raw, "fragment")["fragment"]
    return _writers(spark, sf_dir).select("c_custkey", F.regexp_extract(page, "(?s)<article.*</article>", 0).alias("fragment"))


_NOTES = export.Options(for_notes=True, inline_stats=True, download_images=True, filename_template="{date} {handle} {slug}", tags_template="clippings, {type}, {handle}, {nope}", run_date="2024-03-05", fields={"views": False})
_LIKES = "(1 + c_custkey % 900)"
_SLUG = f"substr(regexp_replace(regexp_replace(lower({_sql('Hi {{seg}} Source: https://x.com/u{{k}}/status/{{k}} Date: 2024-03-02T07:08:09.000Z')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60)"
_NOTE = (
    '---\ntitle: "Post by u{{k}} on X"\nsource: "https://x.com/u{{k}}/status/{{k}}"\nauthor: "[[u{{k}}]]"\nauthor_name: "{{name}}"\nhandle: "u{{k}}"\npublished: 2024-03-02\ncreated: 2024-03-05\ntype: tweet\ndescription: "Hi {{seg}}"\n'
    "tags: [clippings, tweet, u{{k}}]\nlikes: {{likes}}\n---\n# {{name}} (@u{{k}})\n\nHi {{seg}}\n\n![Image]({{folder}}/P{{k}}.png)\n\n❤️ {{likes}}\n"
)


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _filled(
        '{"rest_id":"{{k}}",' + _USER + ',"legacy":{"full_text":"Hi {{seg}}","favorite_count":{{likes}},"created_at":"Sat Mar 02 07:08:09 +0000 2024","extended_entities":{"media":[{"type":"photo","media_url_https":"https://pbs.twimg.com/media/P{{k}}.png"}]}}}',
        likes=F.expr(f"CAST({_LIKES} AS STRING)"),
    )
    rows = _writers(spark, sf_dir).select("c_custkey", raw.alias("_raw"))
    return columns.post_rows(rows, F.col("_raw"), body=True).drop("_raw")


@query(
    f"SELECT c_custkey, folder || '.md' AS filename, {_sql(_NOTE, likes='likes', folder='folder')} AS markdown, {_sql('https://pbs.twimg.com/media/P{{k}}?format=png&name=large')} AS image, folder || '/P' || c_custkey || '.png' AS image_file "
    f"FROM (SELECT *, CAST({_LIKES} AS VARCHAR) AS likes, '2024-03-02 u' || c_custkey || ' ' || {_SLUG} AS folder FROM customer)"
)
def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as notes: title, tags, description, stats, templated names and local images."""
    rows = export.post_processed(_notes(spark, sf_dir), _NOTES)
    # Images are read off the same pass over the notes; a join would make every note twice.
    images = routing.image_manifest(rows.withColumn("note", F.struct("filename", "markdown")), "c_custkey", "note")
    return images.select("c_custkey", "note.filename", "note.markdown", F.col("url").alias("image"), F.col("filename").alias("image_file"))


@query(f"""
SELECT c_custkey, {_sql('2024-03-02,2024-03-05,u{{k}},{{name}},u{{k}},Post by u{{k}} on X,tweet,Hi {{seg}},clippings tweet u{{k}},')} || {_LIKES} || {_sql(',,,,https://x.com/u{{k}}/status/{{k}},"Hi {{seg}}' + chr(10) + chr(10) + 'Image: https://pbs.twimg.com/media/P{{k}}?format=png&name=large"')} AS csv_line,
       'published,created,author,author_name,handle,title,type,description,tags,likes,reposts,replies,bookmarks,source,text' AS header, 'date,source,text' AS bare FROM customer
""")
def csv_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines by the fields of notes, and the headers with and without metadata."""
    lines = export.csv_lines(_notes(spark, sf_dir), _NOTES)
    return lines.select("c_custkey", "csv_line", F.lit(export.csv_header(_NOTES)).alias("header"), F.lit(export.csv_header(export.Options(include_metadata=False))).alias("bare"))


_CODED = "replace(replace(replace(replace(replace(url_encode({}), '%21', '!'), '%28', '('), '%29', ')'), '%27', ''''), '%2A', '*')"


@query(f"""
SELECT c_custkey, 'obsidian://new?' || CASE WHEN c_custkey % 2 = 1 THEN 'vault=My%20%26%20vault&' ELSE '' END || 'file=' || {_CODED.format("'Clips/' || c_mktsegment || '/note ' || c_custkey")} || '&content=' || {_CODED.format("'# ' || c_name || chr(10) || 'é (a) & b'")} AS link,
       'https://x.com/ana/status/' || CASE c_custkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '3' END AS target,
       {_sql_list(["signed out", "sign-in asked for", "rate limit", None, "rate limit"])} AS wall, {_sql_list(["likes", "bookmarks", "timeline", "likes", "profile", None, None])} AS source, {_sql_list([None, None, None, "ana", "ana", None, None])} AS handle
FROM customer
""")
def links_and_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that make notes, the target of a click, what keeps a page from showing its post, and the kind of a page."""
    rows, key = _customers(spark, sf_dir), F.col("c_custkey")
    address = lambda n: F.lit(f"https://x.com/ana/status/{n}/photo/1")
    target = routing.target_url(F.when(key % 3 == 0, address(1)).otherwise("https://x.com/home"), F.when(key % 3 == 1, address(2)), address(3))
    walls = [("/i/flow/login", False, ""), ("/ana/status/1", True, ""), ("/ana/status/1", False, "Sorry, Rate Limit exceeded"), ("/ana/status/1", False, "gone"), ("/ana", False, "Something went wrong. Try reloading.")]
    page = urls.page_source(_of_list(["/i/history/likes", "/i/bookmarks/12", "/home/", "/ana/likes", "/ana", "/search", "/settings/likes"]))
    return rows.select(
        "c_custkey", urls.note_link(_filled("# {{name}}\né (a) & b"), _filled("note {{k}}.md"), F.when(key % 2 == 1, "My & vault").otherwise(""), _filled("/Clips/../ {{seg}} /.")).alias("link"),
        target.alias("target"), routing.interstitial(_of_list([w[0] for w in walls]), _of_list([w[1] for w in walls]), _of_list([w[2] for w in walls])).alias("wall"), page["source"].alias("source"), page["handle"].alias("handle"),
    )


@query("""
WITH old AS (SELECT o_custkey AS key, o_orderkey AS seq FROM orders WHERE o_orderkey % 3 = 0), new AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 1),
b AS (SELECT key, min(seq) AS seq FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY key)
SELECT key, seq FROM b WHERE key NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0) ORDER BY seq DESC LIMIT 40
""")
def backlog_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to try again: old entries and new stubs without those that are settled, the last within the cap."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"))
    return ledger.new_backlog(orders.where("seq % 3 = 0"), orders.where("seq % 3 = 1"), orders.where("seq % 10 = 0"), "key", "seq", 40)


@query("SELECT CAST(row_number() OVER (ORDER BY rank, doc_id) AS BIGINT) AS place, doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 0 ELSE 1 END AS rank FROM documents WHERE doc_id // 20 < 5)")
def output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed backlog first and then the first pages of the feed, in order."""
    docs = routing.pages_within(table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 20").alias("page")), "page", 5).select("doc_id")
    return ledger.ordered_output(docs.where("doc_id % 7 = 3"), docs.where("doc_id % 7 <> 3"), "doc_id").select("place", "doc_id")


@query("SELECT event_id, strftime(ts, 'batch-%Y%m%d-%H%M%S') AS folder, CASE event_type WHEN 'click' THEN 'combined' ELSE 'both' END AS output FROM events")
def run_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by the time of a run, and the output that a format allows."""
    from ..functions import dates

    kept = {fmt: export.effective_output(fmt, "both", True, True) for fmt in ("csv", "md")}
    events = table(spark, sf_dir, "events")
    return events.select("event_id", dates.folder_name(F.col("ts").cast("timestamp")).alias("folder"), F.when(F.col("event_type") == "click", kept["csv"][0]).otherwise(kept["md"][0]).alias("output"))


# Requests, senders, marks, visits, details and results


@query("""
SELECT c_custkey, '{"userId":"' || c_custkey || '","count":20,"all":[1,true,null,"' || c_mktsegment || '"]' || CASE WHEN c_custkey % 3 = 0 THEN ',"cursor":"old"' ELSE '' END || '}' AS variables,
  'https://x.com/g/F' || c_custkey || '?a=b+c&variables=' || '%7B%22userId%22%3A%22' || c_custkey || '%22%2C%22count%22%3A20%2C%22all%22%3A%5B1%2Ctrue%2Cnull%2C%22' || c_mktsegment || '%22%5D%2C%22cursor%22%3A%22D%2FA%3D' || c_custkey || '%22%7D&f=%7B%7D' AS url
FROM customer
""")
def feed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variables of a feed request, and the request that goes on from a cursor."""
    held = _filled('{"userId":"{{k}}","count":20,"all":[1,true,null,"{{seg}}"]{{old}}}', old=F.expr("""CASE WHEN c_custkey % 3 = 0 THEN ',"cursor":"old"' ELSE '' END"""))
    url = F.concat(_filled("https://x.com/g/F{{k}}?a=b%20c&variables="), F.url_encode(held), F.lit("&f=%7B%7D&variables=no"))
    known = routing.variables(F.col("url"))
    rows = _customers(spark, sf_dir).select("c_custkey", url.alias("url"))
    return rows.select("c_custkey", known.alias("variables"), routing.with_variables(F.col("url"), routing.cursor_in(known, F.concat(F.lit("D/A="), F.col("c_custkey").cast("string")))).alias("url"))


#: A sender's address, origin and tab, and whether it is trusted, as page and as the application's own.
_SENDERS = [
    ("https://x.com/a", None, None, True), ("https://X.com:443?q", None, None, True), ("http://x.com/a", None, None, False), ("https://x.com.evil.org/", None, None, False), ("https://evil.org/x.com", "https://x.com", None, False),
    ("about:blank", "https://x.com", None, True), (None, "https://x.com", None, True), ("no address", "https://x.com", None, True), (None, None, "https://x.com/a", True), ("about:blank", None, "https://x.com/a", False), (None, None, None, False),
]


@query(f"SELECT c_custkey, {_sql_list([s[3] for s in _SENDERS])} AS trusted, c_custkey % 4 <> 3 AS own FROM customer")
def sender_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which senders are pages of the site, and which the application's own."""
    url, origin, tab = (F.nullif(_of_list([s[n] or "" for s in _SENDERS]), F.lit("")) for n in range(3))
    sender = F.when(F.expr("c_custkey % 4 = 3"), "other").otherwise("app")
    own = F.when(F.expr("c_custkey % 2 = 0"), "ext://app/popup.html")
    return _customers(spark, sf_dir).select("c_custkey", checks.trusted_page(url, origin, tab, "x.com").alias("trusted"), checks.own_page(sender, own, F.lit("ext://app"), "ext", "app").alias("own"))


_MARKED = [("https://x.com/a", "https://x.com/a#export="), ("https://x.com/a#", "https://x.com/a#export="), ("https://x.com/a#top", "https://x.com/a#top&export="), ("https://x.com/a#export=copy-txt&export_single=1", "https://x.com/a#export="), ("https://x.com/a#top&export=copy&x=1", "https://x.com/a#top&x=1&export=")]
_DO = ["download", "copy", "copy-txt", "pdf", "json", "csv"]


@query(f"""
SELECT c_custkey, {_sql_list([m[1] for m in _MARKED])} || {_sql_list(_DO)} || CASE WHEN c_custkey % 2 = 0 THEN '&export_single=1' ELSE '' END AS url, {_sql_list(_DO)} AS action, c_custkey % 2 = 0 AS single,
  replace({_sql_list([m[1] for m in _MARKED])}, CASE WHEN contains({_sql_list([m[1] for m in _MARKED])}, '&') THEN '&export=' ELSE '#export=' END, '') AS bare FROM customer
""")
def job_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that carry what to do with the page, read back and cleaned."""
    url = checks.with_job(_of_list([m[0] for m in _MARKED]), _of_list(_DO), F.expr("c_custkey % 2 = 0"))
    rows = _customers(spark, sf_dir).select("c_custkey", url.alias("url"))
    return rows.select("c_custkey", "url", checks.job_of(F.col("url")).alias("j"), checks.without_job(F.col("url")).alias("bare")).select("c_custkey", "url", "j.action", "j.single", "bare")


@query("""
WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'timeline' WHEN 'click' THEN 'profile:u1' WHEN 'error' THEN NULL ELSE 'bookmarks' END AS source_key, 'u' || (event_id % 3) AS who, event_id % 5 AS post FROM events),
c AS (SELECT *, CASE WHEN source_key IS NOT DISTINCT FROM lag(source_key) OVER w THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
v AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS visit FROM c)
SELECT user_id, CAST(visit AS BIGINT) AS visit, source_key, 'https://x.com/' || who || '/status/' || post AS url, min(event_id) AS first_at FROM v
WHERE source_key IS NOT NULL AND (source_key <> 'profile:u1' OR who = 'u1') GROUP BY ALL
""")
def harvest_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permalinks that each user saw on each visit to a source; a visit ends where the source changes."""
    kind = F.col("event_type")
    path = F.when(kind == "view", "/home").when(kind == "click", "/U1").when(kind == "error", "/settings").otherwise("/i/bookmarks/all")
    link = F.concat(F.lit("https://x.com/u"), F.expr("event_id % 3").cast("string"), F.lit("/status/"), F.expr("event_id % 5").cast("string"), F.lit("/photo/1"))
    seen = table(spark, sf_dir, "events").select("user_id", "event_id", path.alias("path"), link.alias("link"))
    return routing.harvested(seen, "user_id", "event_id", "path", "link")


@query("""
SELECT c_name AS name FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 15 <> 0
""")
def unused_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that no source names, in quotes or as a message."""
    rows = _customers(spark, sf_dir)
    key = F.replace("c_name", F.lit("#"), F.lit("_"))
    named = _filled("get('{{key}}')\"{{key}}\", __MSG_{{key}}__", key=key)
    sources = rows.select(F.when(F.expr("c_custkey % 5 <> 0"), named).when(F.expr("c_custkey % 15 = 0"), _filled("{{key}} and __MSG_{{key}}__", key=key)).otherwise(_filled("'x{{key}}' {{key}} \"{{key}}", key=key)).alias("content"))
    return checks.unreferenced(rows.select(key.alias("name")), sources, "name", "content").select(F.replace("name", F.lit("_"), F.lit("#")).alias("name"))


def _answer(identity: str) -> str:
    """A detail by its id: every seventh is gone, every eleventh times out."""
    n = int(identity)
    if n % 7 == 0:
        raise details.Refused(404)
    if n % 11 == 0:
        raise details.Refused()
    return f'{{"id":{n}}}'


@query("""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN NULL ELSE '{"id":' || doc_id || '}' END AS raw, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'gone' ELSE 'done' END AS status,
  CASE WHEN doc_id % 7 = 0 THEN 'status 404' WHEN doc_id % 11 = 0 THEN 'no answer' END AS error FROM documents
""")
def details_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of items, a few at a time, with further tries for what may pass."""
    return details.fetched(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", _answer, wait=0)


@query("""
SELECT page_id, page_id % 3 = 0 AS has_document, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'signed out' WHEN page_id % 2 = 0 THEN 'rate limit' ELSE 'no post found' END AS error,
  page_id % 3 = 1 OR (page_id % 3 = 2 AND page_id % 2 = 0) AS wall FROM pages
""")
def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading each page came to: a document, a wall before it, or nothing."""
    number = F.col("page_id").cast("string")
    post = F.concat(F.lit('<article role="article"><div data-testid="User-Name"><a>Site</a><a>@site</a></div><div data-testid="tweetText">Post '), number, F.lit("</div></article>"))
    body = F.when(F.expr("page_id % 3 = 0"), post).when(F.expr("page_id % 2 = 0"), F.lit("<p>Something went <b>wrong</b>. Try  reloading.</p><p>Rate limit exceeded</p>")).otherwise(F.lit("<script>'rate limit'</script><p>Nothing</p>"))
    url = F.concat(F.when(F.expr("page_id % 3 = 1"), "https://x.com/login?to=").otherwise("https://x.com/site/status/"), number)
    made = columns.results_of_pages(table(spark, sf_dir, "pages").select("page_id", url.alias("url"), body.alias("html")))
    return made.select("page_id", F.col("document").isNotNull().alias("has_document"), "error", "wall")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'held-' || c_custkey || '.json' ELSE 'u' || c_custkey || '-' || c_custkey || '.json' END AS name, CAST(c_custkey AS VARCHAR) AS id FROM customer")
def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents as entries of an archive, made anew from their trees under their stored names."""
    document = columns.posts_shown(_filled(_RUN_POST), "document")["document"]
    rows = _writers(spark, sf_dir).select("c_custkey", document.alias("document"), F.when(F.expr("c_custkey % 2 = 0"), _filled("held-{{k}}.md")).alias("filename"))
    made = export.stored_entries(rows, "json", export.Options(download_images=True))
    return made.select("c_custkey", "name", F.get_json_object("content", "$.metadata.tweetId").alias("id"))


_ACTED = ["download", "copy", "obsidian", "copy-txt", "json", "csv", "pdf"]


#: The note of a post, and how it stands in a link: what addresses may hold as it is, stays.
_NOTE = (
    "'---' || chr(10) || 'title: \"Post by u' || c_custkey || ' on X\"' || chr(10) || 'source: \"https://x.com/u' || c_custkey || '/status/' || c_custkey || '\"' || chr(10) || 'author: \"[[u' || c_custkey || ']]\"' || chr(10) || 'author_name: \"' || c_name || '\"' || chr(10)"
    " || 'handle: \"u' || c_custkey || '\"' || chr(10) || 'published: 2024-03-02' || chr(10) || 'created: 2024-03-05' || chr(10) || 'type: tweet' || chr(10) || 'description: \"Hi ' || c_mktsegment || ', \\\"' || c_custkey || '\\\"\"' || chr(10) || 'tags: [clippings, x, tweet]' || chr(10) || 'likes: ' || c_custkey || chr(10) || '---' || chr(10)"
    f" || '# ' || c_name || ' (@u' || c_custkey || ')' || chr(10) || chr(10) || {_SEGMENT}\"' || c_custkey || '\"'"
)
_IN_LINK = f"replace(replace(replace(url_encode({_NOTE}), '%28', '('), '%29', ')'), '%2A', '*')"


@query(f"""
SELECT c_custkey, action, 'u' || c_custkey || '-' || c_custkey || CASE action WHEN 'copy-txt' THEN '.txt' WHEN 'json' THEN '.json' WHEN 'csv' THEN '.csv' WHEN 'pdf' THEN '.html' ELSE '.md' END AS name,
  CASE action WHEN 'copy-txt' THEN 'text/plain' WHEN 'json' THEN 'application/json' WHEN 'csv' THEN 'text/csv' WHEN 'pdf' THEN 'text/html' ELSE 'text/markdown' END AS mime,
  CASE action WHEN 'copy' THEN 'copy' WHEN 'copy-txt' THEN 'copy' WHEN 'obsidian' THEN 'link' ELSE 'download' END AS mode,
  sha256(CASE action WHEN 'download' THEN {_MD} WHEN 'copy' THEN {_MD} WHEN 'obsidian' THEN {_NOTE} WHEN 'json' THEN {_JSON} WHEN 'copy-txt' THEN {_TXT}
    WHEN 'csv' THEN 'date,author,handle,type,likes,reposts,replies,bookmarks,views,source,text' || chr(10) || {_CSV} || chr(10) ELSE {_PAGE_HEAD.format("'Post by @u' || c_custkey")} || {_CARD} || '</body></html>' END) AS content_sha256,
  CASE WHEN action = 'obsidian' THEN 'obsidian://new?vault=V%20a&file=F%2Fu' || c_custkey || '-' || c_custkey || '&content=' || {_IN_LINK} END AS link
FROM customer, (SELECT unnest(['download', 'copy', 'obsidian', 'copy-txt', 'json', 'csv', 'pdf']) AS action)
""")
def single_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each action makes of one post: its file's name, type and whole content, and the link that makes a note."""
    rows, every = kept(_runs(spark, sf_dir)), None
    for action in _ACTED:
        made = export.single_export(rows, action, export.Options(run_date="2024-03-05"), " V a ", "F")
        one = made.select("c_custkey", F.lit(action).alias("action"), "name", "mime", "mode", F.sha2("content", 256).alias("content_sha256"), "link")
        every = one if every is None else every.unionByName(one)
    return every
