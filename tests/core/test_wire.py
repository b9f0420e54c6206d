"""Posts and pages read as variants, against the reader that makes the trees."""

import itertools
import json
import random

from pyspark.sql import functions as F

from loomfold.content import columns, posts, wire

DATES = ["Tue Jan 02 03:04:05 +0000 2024", "Sat Mar 9 23:59:59 +0530 2024", "2024-03-02T07:08:09.123Z", "2024-03-02T07:08:09+02:00", "2024-03-02", "2024-03-02 07:08:09", "yesterday", "", None]


def post(some, depth=0):
    pick = lambda *v: some.choice(v)
    user = {"core": pick({"name": "Ana", "screen_name": "ana"}, {"name": None}, {}), "legacy": pick({"name": "Old", "screen_name": "old", "profile_image_url_https": "p", "verified": True}, {"profile_image_url_https": ""}, None), "avatar": pick({"image_url": "a"}, None), "is_blue_verified": pick(True, False, None)}
    legacy = {"created_at": pick(*DATES), "full_text": pick("hi", "", None, "é \U0001f600"), "id_str": pick("9", None), "reply_count": pick(1, "2", "x", None, 2.7), "retweet_count": pick(0, True, None), "favorite_count": pick(12, " 7 ", {}, None), "bookmark_count": pick(3, None)}
    if some.random() < 0.3:
        legacy["retweeted_status_result"] = pick({"result": {}}, {}, None)
    out = {"rest_id": pick("5", None), "core": pick({"user_results": {"result": user}}, None, {}), "legacy": pick(legacy, legacy, legacy, None), "views": pick({"count": "44"}, {}, None)}
    if some.random() < 0.3:
        out["note_tweet"] = {"note_tweet_results": {"result": {"text": pick("long", "", None)}}}
    if some.random() < 0.3:
        out["article"] = {"article_results": {"result": pick({"title": "t"}, {}, None)}}
    if depth < 2 and some.random() < 0.4:
        out["quoted_status_result"] = {"result": post(some, depth + 1)}
    return pick({"__typename": "Other", "tweet": out}, out, out, out | {"tweet": pick({}, None, "no")})


def want_of(raw):
    inner, node = posts.unwrapped(raw), posts.post_node(raw)
    note = posts.dig(inner, "note_tweet", "note_tweet_results", "result", "text")
    counts = node.get("engagement") or {}
    author = node["author"]
    return (
        node["tweetId"], author["name"], author["handle"], author.get("avatarUrl"), author.get("verified", False), node["date"], *[counts.get(n) for n, _ in posts.COUNTS], posts.is_repost(raw),
        bool(posts.dig(inner, "article", "article_results", "result")), note if note is not None else posts.dig(inner, "legacy", "full_text") or "", bool(posts.dig(inner, "quoted_status_result", "result")),
    )


def read(frame):
    got = wire.headers(frame, "post")
    return got.select("n", "post_id", "author.*", "date", "counts.*", "is_repost", "is_article", "text", F.col("quoted").isNotNull().alias("quotes"))


def test_headers_are_those_of_the_trees(spark):
    some = random.Random(2)
    raws = [post(some) for _ in range(400)] + [{}, {"legacy": None}, {"tweet": {"rest_id": "1"}}, {"tweet": []}, {"legacy": []}]
    frame = spark.createDataFrame([(n, json.dumps(r)) for n, r in enumerate(raws)], "n int, raw string").select("n", wire.variant("raw").alias("post"))
    assert {r.n: tuple(r)[1:] for r in read(frame).collect()} == {n: want_of(r) for n, r in enumerate(raws)}
    odd = spark.createDataFrame([(0, None), (1, "no json {"), (2, "[]"), (3, "7"), (4, "null")], "n int, raw string").select("n", wire.variant("raw").alias("post"), F.lit(1).alias("text"))
    assert {tuple(r)[1:] for r in read(odd).collect()} == {("", "", "", None, False, "", None, None, None, None, None, False, False, "", False)}


def page(some):
    pick = lambda *v: some.choice(v)
    serial = itertools.count()
    result = lambda: pick({"rest_id": str(next(serial))}, {"rest_id": str(next(serial))}, None)
    held = lambda: {"itemContent": pick({"tweet_results": {"result": result()}}, {}, None)}
    entry = lambda: {"content": pick(held() | {"entryType": "TimelineTimelineItem"}, {"items": [{"item": held()} for _ in range(some.randrange(4))], "entryType": "TimelineTimelineModule"}, {"cursorType": "Bottom", "value": pick("c1", "c2", 7, None)}, {"cursorType": "Top", "value": "t"}, None)}
    said = lambda: {"instructions": [{"type": pick("TimelineAddEntries", "TimelineAddEntries", "Other"), "entries": pick(*[[entry() for _ in range(some.randrange(1, 9))]] * 4, [], None)} for _ in range(some.choice([0, 2, 3, 4]))]}
    deep = said()
    for _ in range(some.choice([0, 1, 2, 4, 5, 6, 7])):
        deep = pick({"z": {"x": 1}, "b": deep}, {"y": deep, "a": said()}, [1, deep], {"instructions": "no", "k": deep})
    return {"data": pick({"bookmark_timeline_v2": {"timeline": said()}}, {"user": {"result": {"timeline": said(), "timeline_v2": pick({"timeline": {"instructions": None}}, {})}}}, deep, deep, deep, {"other": deep, "threaded_conversation_with_injections_v2": said()}, {"threaded_conversation_with_injections_v2": said()}, {}, None)}


def test_pages_and_conversations_have_the_posts_of_the_walk(spark):
    some = random.Random(11)
    raws = [json.dumps(page(some)) for _ in range(500)] + ["", "null", "[]", "{", '{"data":7}', '{"data":[{"instructions":[]}]}', None]
    frame = spark.createDataFrame(list(enumerate(raws)), "n int, raw string")
    ids = F.transform("posts", lambda p: F.try_variant_get(p, "$.rest_id", "string"))
    got = wire.feed_pages(frame, "raw").select("n", ids.alias("ids"), "cursor", "done")
    want, talks = {}, {}
    for n, raw in enumerate(raws):
        try:
            whole = json.loads(raw or "null")
        except ValueError:
            whole = None
        made = posts.feed_page(whole)
        want[n] = ([p.get("rest_id") for p in made["posts"]], made["cursor"], made["done"])
        talks[n] = [p.get("rest_id") for p in posts.conversation(whole)]
    assert {r.n: (r.ids, r.cursor, r.done) for r in got.collect()} == want
    assert sum(bool(w[0]) for w in want.values()) > 100 and sum(bool(t) for t in talks.values()) > 20
    said = wire.conversation_posts(frame, "raw").select("n", ids.alias("ids"))
    assert {r.n: r.ids for r in said.collect()} == talks
    for plan in (got, said):
        assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_filters_come_before_trees(spark):
    frame = spark.createDataFrame([("a",)], "raw string").select("raw", wire.variant("raw").alias("post"))
    chosen = wire.headers(frame, "post").where("author.handle = 'ana' AND counts.likes > 3 AND date < '2025' AND NOT is_repost")
    plan = chosen.select(columns.post_documents("raw").alias("document"))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    tree, kept = next(n for n, x in enumerate(lines) if "ArrowEvalPython" in x), next(n for n, x in enumerate(lines) if "Filter" in x)
    assert tree < kept and "Python" not in "\n".join(lines[kept:])
