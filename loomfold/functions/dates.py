"""Dates as column expressions; timestamps are read and shown in UTC when the session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def legacy_to_iso(c: Column) -> Column:
    """``Sat Mar 02 07:08:09 +0000 2024`` as ISO with milliseconds; what can't be read stays, null becomes empty."""
    ts = F.try_to_timestamp(F.substring(c, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))
    shown = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.coalesce(shown, c, F.lit(""))


def date_only(iso: Column) -> Column:
    """The first ten characters if they are a date, else all."""
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(iso, 1, 10)).otherwise(iso)


def date_and_minute(iso: Column) -> Column:
    """YYYY-MM-DD_HHMM; as ``date_only`` where the value is no timestamp."""
    ts = F.try_to_timestamp(iso)
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd_HHmm"), date_only(iso))


def display_date(iso: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), "MMM d, yyyy"), F.lit(""))


def in_date_range(ts: Column, first: str | None, last: str | None) -> Column:
    """Whether ts lies between two days, both whole; bounds in the wrong order are swapped, and a null ts lies nowhere."""
    if first and last and first > last:
        first, last = last, first
    inside = ts.isNotNull()
    if first:
        inside &= ts >= F.lit(first).cast("timestamp")
    if last:
        inside &= ts <= F.lit(last).cast("timestamp") + F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND")
    return F.coalesce(inside, F.lit(False))


def folder_name(ts: Column, prefix: str = "batch") -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.date_format(ts, "yyyyMMdd-HHmmss"))
