"""Runs and islands in ordered rows, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leading_run(rows: DataFrame, group: str, order: str, author: str) -> DataFrame:
    """Of each group the rows before the first by another author than the first row's, case aside."""
    w = Window.partitionBy(group).orderBy(order)
    other = (F.lower(author) != F.first(F.lower(F.col(author))).over(w)).cast("int")
    marked = rows.withColumn("_other", other)
    return marked.withColumn("_left", F.max("_other").over(w)).where("_left = 0").drop("_other", "_left")


def page_thread(rows: DataFrame, group: str, order: str, author: str, key: str, unknown: str = "unknown") -> DataFrame:
    """``leading_run`` as pages have it: rows of an unknown author don't end the run, and a key counts once."""
    known = rows.where(F.lower(author) != unknown)
    first = known.withColumn("_nth", F.row_number().over(Window.partitionBy(group, key).orderBy(order))).where("_nth = 1").drop("_nth")
    return leading_run(first, group, order, author)


def focused(rows: DataFrame, group: str, order: str, is_focus: Column) -> DataFrame:
    """Of each group the first row in focus, or else the first row."""
    w = Window.partitionBy(group).orderBy(F.when(is_focus, 0).otherwise(1), order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def islands(rows: DataFrame, group: str, order: str, kind: Column, out: str = "island") -> DataFrame:
    """The number, from 1, of the run of equal kinds that a row stands in."""
    w = Window.partitionBy(group).orderBy(order)
    change = F.when(kind.eqNullSafe(F.lag(kind).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_change", change).withColumn(out, F.sum("_change").over(w)).drop("_change")


def island_lengths(rows: DataFrame, group: str, order: str, kind: str) -> DataFrame:
    """group, island, kind, length, first of each run."""
    return islands(rows, group, order, F.col(kind)).groupBy(group, "island").agg(F.first(kind).alias(kind), F.count("*").alias("run_length"), F.min(order).alias("run_start"))


def failure_runs(rows: DataFrame, group: str, order: str, failed: Column, out: str = "failures_in_a_row") -> DataFrame:
    """How many failures in a row end at each row; a success sets it to 0."""
    w = Window.partitionBy(group).orderBy(order)
    marked = rows.withColumn("_failed", F.coalesce(failed, F.lit(False)).cast("int"))
    marked = marked.withColumn("_successes", F.sum(1 - F.col("_failed")).over(w))
    within = Window.partitionBy(group, "_successes").orderBy(order)
    return marked.withColumn(out, F.sum("_failed").over(within)).drop("_failed", "_successes")


def shares(counts: Column) -> Column:
    """Whole percents of an array of counts, half up; null without any count."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x.cast("bigint"), F.lit(0)))
    return F.when(total > 0, F.transform(counts, lambda x: F.floor(F.coalesce(x, F.lit(0)) * 100 / total + 0.5).cast("int")))


def best_variant(variants: Column) -> Column:
    """The address of the mp4 with the highest bitrate, the first of equals; without an mp4 the first address there is.

    ``variants`` is an array of struct(bitrate, content_type, url).
    """
    placed = F.filter(F.transform(variants, lambda v, i: F.struct((-F.coalesce(v["bitrate"], F.lit(0))).alias("rank"), i.alias("at"), v["content_type"].alias("kind"), v["url"].alias("url"))), lambda v: v["url"].isNotNull() & (v["url"] != ""))
    mp4 = F.filter(placed, lambda v: v["kind"] == "video/mp4")
    return F.coalesce(F.array_min(mp4)["url"], F.try_element_at(placed, F.lit(1))["url"])


def spliced(spans: Column) -> Column:
    """Of spans (start, end, ...) those that begin at or after the end of the last one taken, in order of start.

    Greedy, so a fold and not a window; equal starts keep their order.
    """
    ordered = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("at"), s.alias("span"))))
    state = F.struct(F.lit(0).cast("bigint").alias("cursor"), F.filter(ordered, lambda _: F.lit(False)).alias("taken"))
    step = lambda acc, s: F.when(s["start"] < acc["cursor"], acc).otherwise(F.struct(s["span"]["end"].cast("bigint").alias("cursor"), F.concat(acc["taken"], F.array(s)).alias("taken")))
    return F.transform(F.aggregate(ordered, state, step, lambda acc: acc["taken"]), lambda s: s["span"])
