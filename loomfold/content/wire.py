"""Posts and pages of a feed read as variants: no Python worker, so that filters on authors, dates and counts come before any tree.

Values are those of ``posts``, which makes the trees. A variant keeps the members of an object by name and not as they came; only the search for a timeline
at an unknown place depends on that order, so it walks the JSON text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .posts import COUNTS

#: Where a page has its timeline, the first that is there.
TIMELINES = ("bookmark_timeline_v2.timeline", "bookmark_timeline.timeline", "user.result.timeline_v2.timeline", "user.result.timeline.timeline")
#: How deep a timeline at another place is looked for.
DEPTH = 6
_ENTRY = "content.itemContent.tweet_results.result"


def variant(raw: Column | str) -> Column:
    """raw JSON as a variant; null for null and for what is no JSON."""
    return F.try_parse_json(raw)


def _there(v: Column) -> Column:
    """v, or null where it is JSON's null."""
    return F.when(~F.is_variant_null(v), v)


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    found = F.try_variant_get(v, f"$.{path}", kind)
    return _there(found) if kind == "variant" else found


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _list(v: Column, path: str) -> Column:
    """The members of a list; none where there is no list."""
    return F.coalesce(_at(v, path, "array<variant>"), F.array().cast("array<variant>"))


def iso(created: Column) -> Column:
    """A feed date or an ISO date with milliseconds in UTC; what can't be read stays, null becomes empty."""
    feed = F.when(created.rlike(r"^(?i)(mon|tue|wed|thu|fri|sat|sun) "), F.try_to_timestamp(F.substring(created, 5, 100), F.lit("MMM d HH:mm:ss Z yyyy")))
    zoned = r"(Z|[+-]\d\d:?\d\d)$"
    dated = F.when(created.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(created, F.lit("T00:00:00Z"))).when(created.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{3}(\d{3})?)?)?(Z|[+-]\d\d:?\d\d)?$"), F.when(created.rlike(r"T.*" + zoned + r"| .*" + zoned), created).otherwise(F.concat(created, F.lit("Z"))))
    ts = F.coalesce(feed, dated.try_cast("timestamp"))
    shown = F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.coalesce(shown, created, F.lit(""))


def _author(post: Column) -> Column:
    user = "core.user_results.result"
    name = lambda key: F.coalesce(_at(post, f"{user}.core.{key}", "string"), _at(post, f"{user}.legacy.{key}", "string"), F.lit(""))
    avatar = F.coalesce(_at(post, f"{user}.legacy.profile_image_url_https", "string"), _at(post, f"{user}.avatar.image_url", "string"))
    verified = F.coalesce(_at(post, f"{user}.is_blue_verified", "boolean"), F.lit(False)) | F.coalesce(_at(post, f"{user}.legacy.verified", "boolean"), F.lit(False))
    return F.struct(name("name").alias("name"), name("screen_name").alias("handle"), F.nullif(avatar, F.lit("")).alias("avatarUrl"), verified.alias("verified"))


def headers(frame: DataFrame, post: str) -> DataFrame:
    """frame with what is asked of a post before its tree is made, from the variant column ``post``.

    A post inside a visibility wrapper is unwrapped, whatever the wrapper calls itself. post_id, author (name, handle, avatarUrl, verified), date, counts (replies, reposts, likes, bookmarks, views), is_repost, is_article, text (a long text in place of
    its beginning), quoted (the variant of the post that this one quotes, for which the same can be asked). Where nothing is known, ids, names, dates and texts are
    empty, counts and quoted null. A column of frame with one of these names gives way.
    """
    names = ["post_id", "author", "date", "counts", "is_repost", "is_article", "text", "quoted"]
    read = frame.withColumn("_inner", _at(F.col(post), "tweet"))
    read = read.withColumn("_post", F.when(F.coalesce(F.size(F.try_variant_get("_inner", "$", "map<string,variant>")) > 0, F.lit(False)), F.col("_inner")).otherwise(F.col(post)))
    p = F.col("_post")
    read = read.withColumn("_created", _at(p, "legacy.created_at", "string"))
    note = _at(p, "note_tweet.note_tweet_results.result.text", "string")
    values = [
        F.coalesce(_at(p, "rest_id", "string"), _at(p, "legacy.id_str", "string"), F.lit("")), _author(p), iso(F.col("_created")),
        F.struct(*[_at(p, ".".join(path), "bigint").alias(name) for name, path in COUNTS]), _at(p, "legacy.retweeted_status_result").isNotNull(),
        F.coalesce(F.size(_at(p, "article.article_results.result", "map<string,variant>")) > 0, F.lit(False)), F.coalesce(note, _at(p, "legacy.full_text", "string"), F.lit("")), _at(p, "quoted_status_result.result"),
    ]
    return read.withColumns(dict(zip(names, values, strict=True))).drop("_inner", "_post", "_created")


def _entries(timeline: Column) -> Column:
    added = F.filter(_list(timeline, "instructions"), lambda i: _at(i, "type", "string") == "TimelineAddEntries")
    return F.flatten(F.transform(added, lambda i: _list(i, "entries")))


def _results(entry: Column, own: Column) -> Column:
    """The posts of an entry: its own, else those of its items."""
    items = F.filter(F.transform(_list(entry, "content.items"), lambda it: _at(it, "item.itemContent.tweet_results.result")), lambda r: r.isNotNull())
    return F.when(own.isNotNull(), F.array(own)).otherwise(items)


def _searched(frame: DataFrame, text: str, out: str) -> DataFrame:
    """frame with the first object that has a list of instructions, in the order in which a walk meets them, from JSON text down to ``DEPTH``."""
    kind = "array<struct<path:array<int>,json:string>>"
    none = F.array().cast(kind)
    frame = frame.withColumn("_level", F.when(F.col(text).isNotNull(), F.array(F.struct(F.array().cast("array<int>").alias("path"), F.col(text).alias("json")))).otherwise(none).cast(kind)).withColumn("_found", none)
    for depth in range(DEPTH + 1):
        holds = F.filter("_level", lambda n: F.startswith(F.ltrim(F.get_json_object(n["json"], "$.instructions")), F.lit("[")))
        frame = frame.withColumn("_found", F.concat("_found", holds))
        if depth < DEPTH:
            # What lies beneath an object that was found comes after it, so it isn't looked at.
            open_ = F.filter("_level", lambda n: ~F.coalesce(F.startswith(F.ltrim(F.get_json_object(n["json"], "$.instructions")), F.lit("[")), F.lit(False)))
            inner = lambda n: F.when(F.startswith(n["json"], F.lit("{")), F.map_values(F.from_json(n["json"], "map<string,string>"))).when(F.startswith(n["json"], F.lit("[")), F.from_json(n["json"], "array<string>")).otherwise(F.array().cast("array<string>"))
            below = F.flatten(F.transform(open_, lambda n: F.transform(F.coalesce(inner(n), F.array().cast("array<string>")), lambda j, i: F.struct(F.concat(n["path"], F.array(i)).alias("path"), j.alias("json")))))
            frame = frame.withColumn("_level", F.filter(below, lambda n: F.coalesce(n["json"].rlike(r"^[\[{]"), F.lit(False))).cast(kind))
    return frame.withColumn(out, F.array_min("_found")["json"]).drop("_level", "_found")


def feed_pages(frame: DataFrame, raw: str) -> DataFrame:
    """frame with posts (variants, in order), cursor and done of each feed page in the JSON column ``raw``; what is no JSON, or null, is an empty last page."""
    read = frame.withColumn("_data", _at(variant(F.col(raw)), "data"))
    # A place counts if instructions of any kind are there.
    known = F.coalesce(*[F.when(_at(F.col("_data"), f"{path}.instructions").isNotNull(), _at(F.col("_data"), path)) for path in TIMELINES])
    read = read.withColumn("_known", known).withColumn("_text", F.when(F.col("_known").isNull() & F.col("_data").isNotNull(), F.get_json_object(raw, "$.data")))
    read = _searched(read, "_text", "_text").withColumn("_entries", _entries(F.coalesce("_known", variant("_text"))))
    cursor = lambda e: F.when(_at(e, "content.cursorType", "string") == "Bottom", F.when(_is(_at(e, "content.value"), "STRING"), _at(e, "content.value", "string")))
    cursors = F.filter(F.transform("_entries", cursor), lambda c: c.isNotNull())
    posts = F.flatten(F.transform(F.filter("_entries", lambda e: cursor(e).isNull()), lambda e: _results(e, _at(e, _ENTRY))))
    made = read.withColumn("posts", posts).withColumn("cursor", F.try_element_at(cursors, F.lit(-1)))
    return made.withColumn("done", F.size("posts") == 0).drop("_data", "_known", "_text", "_entries")


def conversation_posts(frame: DataFrame, raw: str) -> DataFrame:
    """frame with posts (variants, in the order shown) of each conversation in the JSON column ``raw``; none for what is no JSON, or null."""
    read = frame.withColumn("_entries", _entries(_at(variant(F.col(raw)), "data.threaded_conversation_with_injections_v2")))
    none = F.array().cast("array<variant>")
    shown = lambda e: F.when(_at(e, "content.entryType", "string") == "TimelineTimelineItem", F.filter(F.array(_at(e, _ENTRY)), lambda r: r.isNotNull())).when(_at(e, "content.entryType", "string") == "TimelineTimelineModule", _results(e, F.lit(None).cast("variant"))).otherwise(none)
    return read.withColumn("posts", F.flatten(F.transform("_entries", shown))).drop("_entries")
