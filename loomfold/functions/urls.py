"""URLs, routes and paths as column expressions; only Unicode normalisation takes an Arrow function."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: Hosts that images may come from, and first path parts that name no account.
IMAGE_HOSTS = ["pbs.twimg.com", "video.twimg.com", "abs.twimg.com", "abs-0.twimg.com"]
NOT_ACCOUNTS = [
    "home", "explore", "notifications", "messages", "settings", "search", "compose", "jobs", "communities", "premium", "verified-orgs", "about",
    "tos", "privacy", "login", "logout", "signup", "share", "intent", "hashtag", "places", "topics", "account", "follower_requests", "i",
]
SITE = "https://x.com"


def allowed_image(url: Column, hosts: list[str] = IMAGE_HOSTS) -> Column:
    """https and one of the hosts exactly; false for null and for what is no URL."""
    return F.coalesce((F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(hosts), F.lit(False))


def resolved(url: Column) -> Column:
    """Relative and protocol-relative references against the site."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url).otherwise(F.concat(F.lit(f"{SITE}/"), F.regexp_replace(url, "^/", "")))


def host_matches(url: Column, hosts: list[str]) -> Column:
    return F.coalesce((url != "") & F.lower(F.try_parse_url(resolved(url), F.lit("HOST"))).isin(hosts), F.lit(False))


_MEDIA = r"(?i)^(https://pbs\.twimg\.com/media/[^./?#]+)\.(jpg|jpeg|png|webp)$"


def media_url(url: Column) -> Column:
    """A media file's address in the sized form that pages use."""
    return F.when(url.rlike(_MEDIA), F.concat(F.regexp_extract(url, _MEDIA, 1), F.lit("?format="), F.lower(F.regexp_extract(url, _MEDIA, 2)), F.lit("&name=large"))).otherwise(url)


def video_thumb_url(url: Column) -> Column:
    """A video thumbnail's sized address as a plain file."""
    base, kind = F.regexp_extract(url, r"^([^?#]+)", 1), F.try_parse_url(url, F.lit("QUERY"), F.lit("format"))
    has = F.coalesce(url.rlike(r"_video_thumb/|/amplify_video_thumb/|/tweet_video_thumb/"), F.lit(False))
    return F.when(has & kind.isNotNull(), F.concat(base, F.lit("."), kind)).otherwise(url)


def external_url(href: Column, text: Column) -> Column:
    """The target of a link: a shortened one by its text, where the text is an address."""
    short = href.rlike(r"^https?://t\.co/")
    return (
        F.when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(short & text.rlike("^https?://"), text)
        .when(short & text.rlike(r"(?i)^[a-z0-9.-]+\.[a-z]{2,}(/|$)"), F.concat(F.lit("https://"), text))
        .otherwise(href)
    )


def site_path(href: Column) -> Column:
    return F.when(href.startswith("/"), href).otherwise(F.nullif(F.regexp_extract(href, r"^https?://(?:www\.|m\.)?x\.com(/.*)$", 1), F.lit("")))


def status_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/status/(\d+)", 1), F.lit(""))


def permalink(url: Column) -> Column:
    """A post's address without what follows its id; null for anything else."""
    return F.nullif(F.regexp_extract(url, r"^(https?://(?:www\.)?x\.com/[^/]+/status/\d+)", 1), F.lit(""))


def without_query(url: Column) -> Column:
    """What stands before the first ``?`` or ``#`` of a line, by which addresses are told apart."""
    return F.regexp_replace(url, r"[?#].*$", "")


def percent_encoded(c: Column) -> Column:
    """As a URI component: spaces as %20, and ~!*()' as they are."""
    c = F.url_encode(c)
    for coded, plain in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%28", "("), ("%29", ")"), ("%27", "'")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def vault_folder(c: Column) -> Column:
    parts = F.transform(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1), lambda p: F.trim(p))
    return F.array_join(F.filter(parts, lambda p: (p != "") & (p != ".") & (p != "..")), "/")


def note_link(content: Column, filename: Column, vault: Column, folder: Column, scheme: str = "obsidian") -> Column:
    """A link that makes a note in a note-taking application."""
    where, name = vault_folder(F.coalesce(folder, F.lit(""))), F.regexp_replace(filename, r"\.md$", "")
    path = F.when(where == "", name).otherwise(F.concat(where, F.lit("/"), name))
    parts = F.concat_ws("&", F.when(vault != "", F.concat(F.lit("vault="), percent_encoded(vault))), F.concat(F.lit("file="), percent_encoded(path)), F.concat(F.lit("content="), percent_encoded(content)))
    return F.concat(F.lit(f"{scheme}://new?"), parts)


def page_source(pathname: Column) -> Column:
    """struct(source, handle) of a page that posts can be taken from; null for other pages.

    The branches' order matters: the likes tab before the bare history page, which is the bookmarks tab.
    """
    path = F.regexp_replace(pathname, "/+$", "")
    liked, profile = F.regexp_extract(path, "^/([A-Za-z0-9_]{1,15})/likes$", 1), F.regexp_extract(path, "^/([A-Za-z0-9_]{1,15})$", 1)
    found = lambda source, handle=None: F.struct(F.lit(source).alias("source"), (F.lit(None).cast("string") if handle is None else handle).alias("handle"))
    return (
        F.when(path == "/i/history/likes", found("likes"))
        .when((path == "/i/history") | (path == "/i/bookmarks") | path.startswith("/i/bookmarks/"), found("bookmarks"))
        .when(path == "/home", found("timeline"))
        .when((liked != "") & ~F.lower(liked).isin(NOT_ACCOUNTS), found("likes", liked))
        .when((profile != "") & ~F.lower(profile).isin(NOT_ACCOUNTS), found("profile", profile))
    )


def safe_path(name: str | None, default: str = "document.md", segment: int = 80, most: int = 200) -> str:
    """A relative file path without traversal, reserved characters or white space, within two lengths; the extension is kept."""
    parts = [p for p in unicodedata.normalize("NFKC", name or "").replace("\\", "/").split("/") if p not in ("", ".", "..")]
    parts = [re.sub("-{2,}", "-", re.sub(r"\s+", "-", re.sub(r'[<>:"|?*\x00-\x1f]', "_", p)))[:segment] for p in parts]
    path = "/".join(p for p in parts if p)
    if len(path) > most:
        stem, dot, extension = path.rpartition("/")[2].rpartition(".")
        ending = dot + extension if stem and extension and len(extension) + 1 < most else ""
        path = path[: most - len(ending)].rstrip("/") + ending
    return path or default


@arrow_udf(StringType())
def safe_paths(names: pa.Array) -> pa.Array:
    return pa.array([safe_path(x) for x in names.to_pylist()], pa.string())
