"""Choices that a run makes before it reads: targets, actions, settings, cursors and walls."""

from __future__ import annotations

import json
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls

#: Actions and the format and mode that each means; None for those that aren't format exports.
ACTIONS = {"download": None, "copy": None, "obsidian": None, "pdf": None, "copy-txt": ("txt", "copy"), "txt": ("txt", "download"), "html": ("html", "download"), "json": ("json", "download"), "csv": ("csv", "download")}


def target_url(link: Column, context: Column, page: Column) -> Column:
    """The permalink of the link that was chosen, else of the post under the cursor, else of the page; null without any."""
    return F.coalesce(urls.permalink(link), urls.permalink(context), urls.permalink(page))


def action(token: Column) -> Column:
    """struct(action, format, mode) of a token; null for an unknown one."""
    out = F.lit(None)
    for name, export in ACTIONS.items():
        fmt, mode = export or (None, "copy" if name == "copy" else "download")
        out = F.when(token == name, F.struct(F.lit(name).alias("action"), F.lit(fmt).cast("string").alias("format"), F.lit(mode).alias("mode"))).otherwise(out)
    return out


def interstitial(path: Column, asks_sign_in: Column, text: Column) -> Column:
    """What keeps a page without a post from showing one, if it concerns the session and not the post; else null."""
    low = F.lower(text)
    return (
        F.when(path.rlike("^/(i/flow/login|login|account/access)"), "signed out")
        .when(asks_sign_in, "sign-in asked for")
        .when(low.contains("rate limit") | low.contains("try reloading"), "rate limit")
    )


def merged_settings(saved: dict, defaults: dict, sections: list[str], legacy: dict | None = None, most_open: int = 2) -> dict:
    """Saved settings over legacy ones over defaults; maps are merged key by key, so that a field without a saved choice keeps its default.

    Of open sections those that exist count, each once, the first two.
    """
    out = dict(defaults)
    for source in (legacy or {}, saved):
        for key, value in source.items():
            out[key] = {**out[key], **value} if isinstance(out.get(key), dict) and isinstance(value, dict) else value
    if isinstance(out.get("open_sections"), list):
        out["open_sections"] = [s for s in dict.fromkeys(x for x in out["open_sections"] if isinstance(x, str)) if s in sections][:most_open]
    return out


def feed_template(templates: dict[str, str], names: list[str]) -> str | None:
    """The request that was seen under the newest of an operation's names."""
    return next((templates[n] for n in names if n in templates), None)


def with_cursor(url: str, cursor: str) -> str:
    """A feed request that goes on from a cursor: it is a member of the JSON in the parameter ``variables``."""
    at = urlsplit(url)
    query = parse_qsl(at.query, keep_blank_values=True)
    known = dict(reversed(query)).get("variables", "{}")
    value = json.dumps(json.loads(known) | {"cursor": cursor}, separators=(",", ":"), ensure_ascii=False)
    first = next((n for n, (k, _) in enumerate(query) if k == "variables"), len(query))
    rest = [p for p in query[first:] if p[0] != "variables"]
    return urlunsplit(at._replace(query=urlencode([*query[:first], ("variables", value), *rest])))


_QUERY = r"^([^?#]*)(?:\?([^#]*))?(#.*)?$"


def _parameters(url: Column) -> Column:
    """An array of struct(key, value), decoded; what can't be decoded stays as it is."""
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    pieces = F.filter(F.split(F.regexp_extract(url, _QUERY, 2), "&", -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(plain(F.regexp_extract(p, "^[^=]*", 0)).alias("key"), plain(F.regexp_replace(p, "^[^=]*=?", "")).alias("value")))


def variables(url: Column) -> Column:
    """The JSON in a feed request's first parameter ``variables``; ``{}`` without one, null for a null address."""
    found = F.filter(_parameters(url), lambda p: p["key"] == "variables")
    return F.when(url.isNotNull(), F.coalesce(F.get(found, F.lit(0))["value"], F.lit("{}")))


def with_variables(url: Column, value: Column) -> Column:
    """A feed request with other variables, where the first stood or at the end; a second set of them goes, all else stays in order. Null variables give null."""
    joined = lambda ps: F.transform(ps, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"])))
    ours = lambda p: p["key"] == "variables"
    one = F.concat(F.lit("variables="), F.url_encode(value))

    def set_in(all_: Column) -> Column:
        first = F.array_position(F.transform(all_, lambda p: ours(p)), True).cast("int")
        before, after = F.slice(all_, F.lit(1), F.greatest(first - 1, F.lit(0))), F.filter(F.slice(all_, F.greatest(first, F.lit(1)), F.size(all_)), lambda p: ~ours(p))
        return F.when(first > 0, F.concat(joined(before), F.array(one), joined(after))).otherwise(F.concat(joined(all_), F.array(one)))

    query = F.array_join(text.bound(_parameters(url), set_in), "&")
    return F.when(value.isNotNull(), F.concat(F.regexp_extract(url, _QUERY, 1), F.lit("?"), query, F.regexp_extract(url, _QUERY, 3)))


def cursor_in(variables_: Column, cursor: Column) -> Column:
    """Variables with a cursor, in its place if they have one and last if not; null for what is no JSON object."""
    value = F.parse_json(F.to_json(F.struct(cursor.alias("c"))))
    value = F.variant_get(value, "$.c", "variant")

    def with_it(held: Column) -> Column:
        put = F.transform_values(held, lambda k, v: F.when(k == "cursor", value).otherwise(v))
        return F.when(F.map_contains_key(held, "cursor"), put).otherwise(F.map_concat(held, F.create_map(F.lit("cursor"), value)))

    return F.to_json(text.bound(F.from_json(variables_, "map<string,variant>"), with_it))


def harvested(rows: DataFrame, viewer: str, order: str, path: str, link: str, reposts: bool = False) -> DataFrame:
    """viewer, visit, source_key, url, first_at: distinct permalinks that a viewer saw on each visit to a source, from rows in order.

    A source is a kind of page, with its account where the path names one. A viewer who goes elsewhere and comes back
    starts anew, so that what was removed meanwhile isn't exported. On a profile only its owner's posts count, unless reposts
    are wanted. Rows without a source or a permalink give nothing; those without a source still end a visit.
    """
    page, url = urls.page_source(F.col(path)), urls.permalink(F.col(link))
    key = F.when(page["handle"].isNotNull(), F.concat_ws(":", page["source"], F.lower(page["handle"]))).otherwise(page["source"])
    seen = rows.select(viewer, F.col(order).alias("_at"), key.alias("source_key"), page.alias("_page"), url.alias("url"))
    in_order = Window.partitionBy(viewer).orderBy("_at")
    visits = seen.withColumn("_new", (~F.col("source_key").eqNullSafe(F.lag("source_key").over(in_order))).cast("int")).withColumn("visit", F.sum("_new").over(in_order))
    own = F.lower(F.regexp_extract("url", "://[^/]+/([^/]+)/status/", 1)) == F.lower("_page.handle")
    kept = visits.where("source_key IS NOT NULL AND url IS NOT NULL")
    if not reposts:
        kept = kept.where(F.coalesce(F.col("_page.source") != "profile", F.lit(True)) | own)
    return kept.groupBy(viewer, "visit", "source_key", "url").agg(F.min("_at").alias("first_at"))


def resume_frontier(items: DataFrame, source: str, page: str, cursor: str, taken: Column) -> DataFrame:
    """source, cursor: where each source goes on, which is the cursor of the last page before the first that wasn't taken as a whole."""
    pages = items.groupBy(source, page, cursor).agg(F.bool_and(taken).alias("_whole"))
    whole = pages.withColumn("_all", F.min(F.col("_whole").cast("int")).over(Window.partitionBy(source).orderBy(page)))
    return whole.where("_all = 1").groupBy(source).agg(F.max_by(cursor, page).alias(cursor))


def pages_within(items: DataFrame, page: str, most: int) -> DataFrame:
    """Items of the first pages."""
    return items.where(F.col(page) < most)


def image_manifest(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """key, url, filename of every image that exported rows refer to, with ``more`` columns of its row; nothing is fetched."""
    # An inner explode is met with a filter on the array's size, which repeats all that made the array for every row.
    return rows.select(key, *more, F.explode_outer("images").alias("_i")).where("_i IS NOT NULL").select(key, *more, "_i.url", "_i.filename")
