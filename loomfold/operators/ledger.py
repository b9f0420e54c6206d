"""What has been exported already: exclusion, tails, backlog and names."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import running


def exclude(items: DataFrame, ledger: DataFrame, key: str, ledger_key: str | None = None) -> DataFrame:
    """Items whose key isn't in the ledger; items without a key stay."""
    seen = ledger.select(F.col(ledger_key or key).alias("_seen")).where("_seen IS NOT NULL").distinct()
    return items.join(seen, items[key] == seen["_seen"], "left_anti")


def first_items(items: DataFrame, n: int, *order: str | Column) -> DataFrame:
    return items.orderBy(*order).limit(n)


def limit_then_exclude(items: DataFrame, ledger: DataFrame, key: str, n: int, *order: str | Column) -> DataFrame:
    """The first n items less those in the ledger: what stands behind the first n is never looked at."""
    return exclude(first_items(items, n, *order), ledger, key)


def exclude_then_limit(items: DataFrame, ledger: DataFrame, key: str, n: int, *order: str | Column) -> DataFrame:
    """The first n items that aren't in the ledger."""
    return first_items(exclude(items, ledger, key), n, *order)


def tail(ledger: DataFrame, n: int, seq: str) -> DataFrame:
    """The last n entries by sequence; takeOrdered keeps n rows a task."""
    return ledger.orderBy(F.col(seq).desc()).limit(n)


def appended(ledger: DataFrame, new: DataFrame, key: str, seq: str, cap: int) -> DataFrame:
    """The ledger with new entries at its end, within its cap; an entry that is there already doesn't move."""
    first = ledger.unionByName(new).groupBy(key).agg(F.min(seq).alias(seq))
    return tail(first, cap, seq)


def appended_to_queue(queue: DataFrame, new: DataFrame, exported: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """New items that are neither queued nor exported, the first of each key, within the room that is left; the queue is counted in the same plan."""
    known = queue.select(key).unionByName(exported.select(key))
    fresh = exclude(new.where(F.col(key).isNotNull()), known, key)
    ranked = fresh.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_nth = 1").drop("_nth")
    # At most ``most`` of them, and of these those whose number is within the room: one row of counts, no action of its own.
    first = first_items(ranked, most, order).withColumn("_place", F.row_number().over(Window.orderBy(order)))
    room = queue.agg((F.lit(most) - F.count("*")).alias("_room"))
    return first.join(F.broadcast(room), F.col("_place") <= F.col("_room")).drop("_place", "_room")


def backlog_status(backlog: DataFrame, details: DataFrame, key: str, found: str) -> DataFrame:
    """Each backlog entry as completed, gone or pending: details that say it was found, that it wasn't, or nothing."""
    said = details.groupBy(F.col(key).alias("_of")).agg(F.bool_or(found).alias("_found"))
    joined = backlog.join(said, backlog[key] == said["_of"], "left")
    status = F.when(F.col("_of").isNull(), "pending").when(F.col("_found"), "completed").otherwise("gone")
    return joined.withColumn("backlog_status", status).drop("_of", "_found")


def new_backlog(old: DataFrame, stubs: DataFrame, settled: DataFrame, key: str, seq: str, cap: int) -> DataFrame:
    """Old entries and new stubs, less what is completed or gone, within the cap."""
    return tail(exclude(old.unionByName(stubs).groupBy(key).agg(F.min(seq).alias(seq)), settled, key), cap, seq)


def detail_or_root(roots: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Roots with the columns of their detail where there is one."""
    d = details.select(F.col(key).alias("_of"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = roots.join(d, roots[key] == d["_of"], "left")
    return joined.select(*[F.coalesce(f"_{c}", roots[c]).alias(c) if c in columns else roots[c] for c in roots.columns])


def best_snapshot(rows: DataFrame, key: str, score: list[str], seq: str) -> DataFrame:
    """Of each key the row with the best score; among equals the first seen."""
    names = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*[F.col(s) for s in score], (-F.col(seq)).alias("_first"))).alias("_best"), F.min(seq).alias("first_seen"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in names], "first_seen")


def last_choice(events: DataFrame, key: str, action: str, seq: str, chosen: str) -> DataFrame:
    """Keys whose last action is ``chosen``."""
    return events.groupBy(key).agg(F.max_by(action, seq).alias("_last")).where(F.col("_last") == chosen).select(key)


def numbered_names(rows: DataFrame, name: str, group: str, order: str, out: str = "unique_name") -> DataFrame:
    """Names with -2, -3 before the extension from their second use on, case aside.

    A made name may meet a name that is given as such; ``names.unique_names`` settles that too.
    """
    nth = F.row_number().over(Window.partitionBy(group, F.lower(name)).orderBy(order))
    stem, ext = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 2)
    return rows.withColumn(out, F.when(nth == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), nth.cast("string"), ext)))


#: What stands before a name's number, and its extension; a dot at the start is no extension.
_NAMED = re.compile(r"(.+?)(\.[^.]*)?", re.DOTALL)


class Names:
    """The file names of one run: none is given twice, case aside. A name that is asked for k times costs k steps in all, as its numbers are counted on."""

    def __init__(self, given: Iterable[str] = ()):
        self._given, self._number = {n.lower() for n in given}, Counter()

    def give(self, name: str | None) -> str | None:
        """The name if it is free, else the first free of name-2, name-3 and so on before the extension; none for none."""
        if name is None:
            return None
        made, asked = name, name.lower()
        while made.lower() in self._given:
            stem, extension = _NAMED.fullmatch(name).groups("")
            self._number[asked] += 1
            made = f"{stem}-{self._number[asked] + 1}{extension}"
        self._given.add(made.lower())
        return made


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, first_at, n: distinct keys, where each was first seen and how often; a null key counts as one key."""
    return rows.groupBy(key).agg(F.min(order).alias("first_at"), F.count("*").alias("n"))


def articles_first(rows: DataFrame, group: str, is_article: Column, order: str) -> DataFrame:
    """rows with their ``place`` from 1 in each group's run: articles first, as only a detail has their text, and then the rest, each in order. A null kind is no article."""
    rank = F.when(F.coalesce(is_article, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(rank, order)))


def ledger_entries(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """key, seq of every id that rows are known by, such as a repost's own and that of what it reposts; null ids are none."""
    return rows.select(F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(k) for k in keys])))).alias("key"), F.col(seq).alias("seq")).groupBy("key").agg(F.min("seq").alias("seq"))


def exclusion_counts(items: DataFrame, ledger: DataFrame, key: str, n: int, order: str) -> DataFrame:
    """taken, skipped: how many items ``exclude_then_limit`` takes, and how many ledger entries it passes until it has them; what stands behind isn't looked at."""
    seen = ledger.select(F.col(key).alias("_seen")).where("_seen IS NOT NULL").distinct().withColumn("_old", F.lit(True))
    marked = items.join(seen, items[key] == seen["_seen"], "left").select(F.col(order).alias("at"), F.col("_old").isNotNull().alias("old"))
    last = marked.where("NOT old").orderBy("at").limit(n).agg(F.count("*").alias("taken"), F.max("at").alias("last"))
    passed = marked.where("old").join(F.broadcast(last.where(F.col("taken") == n).select("last")), F.col("at") < F.col("last"), "left_semi")
    all_old = marked.where("old").agg(F.count("*").alias("every"))
    some = passed.agg(F.count("*").alias("some"))
    return last.join(F.broadcast(all_old)).join(F.broadcast(some)).select("taken", F.when(F.col("taken") == n, F.col("some")).otherwise(F.col("every")).alias("skipped"))


def new_count(items: DataFrame, queued: DataFrame, exported: DataFrame, key: str) -> DataFrame:
    """n_new: items that are neither queued nor exported; an item without a key is new."""
    return exclude(items, queued.select(key).unionByName(exported.select(key)), key).agg(F.count("*").alias("n_new"))


def ordered_output(backlog: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """Completed backlog entries first, in the backlog's order, then fresh items in the feed's; all rows of both, with their ``place`` from 1 on, a running sum over ranges of rows."""
    both = backlog.withColumn("_rank", F.lit(0)).unionByName(fresh.withColumn("_rank", F.lit(1)))
    return running(both.withColumn("_one", F.lit(1).cast("bigint")), [], ["_rank", order], "_one", "place").orderBy("place").drop("_rank", "_one")


def stopped(items: DataFrame, order: str, status: str) -> DataFrame:
    """items whose outcomes are known in order, as a run meets them: behind the first rate limit or cancel nothing is asked for, and all is pending."""
    stop = items.where(F.col(status).isin("rate_limit", "cancelled")).agg(F.min(order).alias("_stop"))
    behind = F.coalesce(F.col(order) > F.col("_stop"), F.lit(False))
    return items.join(F.broadcast(stop)).withColumn(status, F.when(behind, "pending").otherwise(F.col(status))).drop("_stop")


def settled(status: Column, needs_detail: Column | None = None) -> Column:
    """Whether an item may enter the ledger.

    One whose detail came may, and one whose detail is not to be had (``gone``), as its root is all there will ever be; one that
    needs no detail may in any case. What met the rate limit, a cancel, or is pending or null waits for another run.
    """
    known = F.coalesce(status.isin("done", "gone"), F.lit(False))
    return known if needs_detail is None else known | F.coalesce(~needs_detail, F.lit(False))


def finalised(staged: DataFrame, wanted: DataFrame, key: str, order: str) -> DataFrame:
    """The staged rows that a job's index (key, order) names, with their order; of a key that is staged twice the last."""
    last = staged.groupBy(key).agg(F.max_by(F.struct(*[c for c in staged.columns if c != key]), "staged_at").alias("_last"))
    return wanted.select(key, order).join(last, key).select(key, order, "_last.*").drop("staged_at")
