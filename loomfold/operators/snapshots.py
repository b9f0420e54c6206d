"""Rows of a page that is shown a screen at a time: screens that overlap are merged into one order, with the best snapshot of each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_windows(rows: DataFrame, thread: str = "thread", capture: str = "capture", pos: str = "pos", key: str = "key", owner: str = "owner", handle: str = "handle", promoted: str = "promoted", score: tuple[str, ...] = ("media", "chars")) -> DataFrame:
    """thread, key, first_seen (capture, pos) and the other columns of the best snapshot of each row of a thread.

    ``rows`` has a row for each post of each screen: screens of a thread in the order of ``capture``, posts of a screen in that of ``pos``. Promoted posts and those of an unknown author
    (null, empty or ``unknown``) are passed over. A screen counts up to its first post by another than the thread's ``owner``, case aside. Screens overlap, so a post comes in several; its place in the thread is
    where it was seen first, and of its snapshots the one with the largest scores stays, the earlier of equals. Rows without a key are left out. Null scores are the least.
    Only the posts of one screen are ever gathered; a thread may have any number of them.
    """
    known = rows.where(~F.coalesce(F.col(promoted), F.lit(False)) & F.coalesce(~F.lower(handle).isin("", "unknown"), F.lit(False)))
    screen = Window.partitionBy(thread, capture)
    other = ~F.lower(handle).eqNullSafe(F.lower(owner))
    reached = known.withColumn("_stop", F.min(F.when(other, F.col(pos))).over(screen)).where(F.col("_stop").isNull() | (F.col(pos) < F.col("_stop"))).where(F.col(key).isNotNull())
    rest = [c for c in rows.columns if c not in (thread, key)]
    better = F.struct(*[F.col(s) for s in score], (-F.col(capture)).alias("_c"), (-F.col(pos)).alias("_p"))
    best = reached.groupBy(thread, key).agg(F.max_by(F.struct(*rest), better).alias("_best"), F.min(F.struct(F.col(capture).alias("capture"), F.col(pos).alias("pos"))).alias("first_seen"))
    return best.select(thread, key, "first_seen", *[F.col(f"_best.`{c}`").alias(c) for c in rest])


def last_windows(rows: DataFrame, thread: str = "thread", capture: str = "capture", pos: str = "pos", html: str = "html") -> DataFrame:
    """thread, html: what a page still shows of each thread, which is every post of its last screen, in their order. Only posts of a screen are gathered."""
    screens = rows.groupBy(thread, capture).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(html).alias("html")))).alias("_all"))
    last = screens.groupBy(thread).agg(F.max_by("_all", capture).alias("_all"))
    return last.select(thread, F.array_join(F.transform("_all", lambda x: x["html"]), "").alias(html))


def with_snapshots(pages: DataFrame, best: DataFrame, thread: str = "thread", key: str = "key", html: str = "html") -> DataFrame:
    """pages (thread, html and more) with the snapshots of their thread, in the order in which they were first seen, as rehydrated cells at the end of their HTML.

    Where pages are read, rehydrated posts come before those that are still shown, and of a post that is both only the first counts. Pages without snapshots stay as they are.
    """
    cell = F.concat(F.lit('<div data-testid="cellInnerDiv" data-rehydrated="'), F.col(key), F.lit('">'), F.col(html), F.lit("</div>"))
    cells = F.array_sort(F.collect_list(F.struct("first_seen", cell.alias("cell"))))
    host = best.groupBy(F.col(thread).alias("_thread")).agg(F.array_join(F.transform(cells, lambda c: c["cell"]), "").alias("_cells"))
    joined = pages.join(host, pages[thread].eqNullSafe(host["_thread"]), "left")
    return joined.withColumn(html, F.concat(F.coalesce(html, F.lit("")), F.coalesce(F.concat(F.lit("<div data-rehydrate-host>"), F.col("_cells"), F.lit("</div>")), F.lit("")))).drop("_thread", "_cells")
