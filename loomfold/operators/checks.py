"""Who a message comes from, which job an address carries, and which keys nothing refers to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .routing import ACTIONS


def https_at(url: Column, host: str) -> Column:
    """Whether an address is https at exactly this host, with any port; false for null."""
    return F.coalesce(url.rlike(rf"(?i)^\s*https://(?:[^/?#]*@)?{re.escape(host)}(?::\d*)?(?:[/?#]|$)"), F.lit(False))


def trusted_page(url: Column, origin: Column, tab: Column, host: str) -> Column:
    """Whether a message comes from a page of the host.

    Its own address decides; where that is none, or a blank page's, its origin; and where both are missing, its tab.
    """
    missing = lambda c: F.coalesce(c == "", F.lit(True))
    no_address = missing(url) | ~url.rlike(r"^\s*[A-Za-z][A-Za-z0-9+.-]*:") | url.rlike(r"(?i)^\s*about:")
    return https_at(url, host) | (F.coalesce(no_address, F.lit(True)) & https_at(origin, host)) | (missing(url) & missing(origin) & https_at(tab, host))


def own_page(sender: Column, url: Column, origin: Column, scheme: str, own: str) -> Column:
    """Whether a message comes from a page of the application itself, by its id and by its address or origin."""
    at = rf"^{re.escape(scheme)}://{re.escape(own)}(?:[/?#]|$)"
    return F.coalesce(F.lit(own != "") & (sender == own), F.lit(False)) & (F.coalesce(url.rlike(at), F.lit(False)) | F.coalesce(origin.rlike(at), F.lit(False)))


#: Longer actions first, so that none is taken for the start of another; 1 is an item of a job.
_TOKENS = "|".join([*sorted(ACTIONS, key=lambda a: (-len(a), a)), "1"])


def without_job(url: Column, marker: str = "export") -> Column:
    """An address without the marks that ``with_job`` leaves in its fragment."""
    return F.regexp_replace(F.regexp_replace(url, rf"[#&]{marker}(?:_single)?=(?:{_TOKENS})", ""), r"#\z", "")


def with_job(url: Column, action: Column, single: Column, marker: str = "export") -> Column:
    """An address whose fragment says what to do with the page, in place of what it said before; an unknown single is no."""
    clean = without_job(url, marker)
    return F.concat(clean, F.when(F.contains(clean, F.lit("#")), "&").otherwise("#"), F.lit(f"{marker}="), action, F.when(F.coalesce(single, F.lit(False)), f"&{marker}_single=1").otherwise(""))


def job_of(url: Column, marker: str = "export") -> Column:
    """struct(action, single) of a marked address; null without a mark."""
    action = F.regexp_extract(url, rf"[#&]{marker}=({_TOKENS})", 1)
    return F.when(action != "", F.struct(action.alias("action"), url.rlike(f"[#&]{marker}_single=1").alias("single")))


def unreferenced(keys: DataFrame, sources: DataFrame, key: str, content: str, only_message: list[str] | None = None) -> DataFrame:
    """Keys (of letters, digits, ``_``, ``@``) that no source names: in quotes of either kind, or as ``__MSG_key__``.

    Those in ``only_message`` count in the last form alone. Sources are cut into names and joined by them, so no key is
    searched for in every source; null keys and contents name nothing.
    """
    # The closing mark is looked at and not taken, as it may open the next name.
    quoted = F.concat(*[F.regexp_extract_all(content, F.lit(f"{q}([A-Za-z0-9_@]+)(?={q})"), 1) for q in ("\"", "'")])
    messages = F.regexp_extract_all(content, F.lit("__MSG_([A-Za-z0-9_@]+?)__"), 1)
    marked = lambda names, kind: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("message")))
    named = sources.where(F.col(content).isNotNull()).select(F.explode(F.array_distinct(F.concat(marked(quoted, False), marked(messages, True)))).alias("n")).select("n.*").distinct()
    counts = F.col("message") | ~F.col("name").isin(only_message or [""])
    return keys.where(F.col(key).isNotNull()).join(named.where(counts).select(F.col("name").alias(key)), key, "left_anti")
