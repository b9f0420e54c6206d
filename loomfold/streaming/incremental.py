"""Incremental export: each micro-batch is filtered, written, and only then entered in the ledger.

State is tables in a folder: ``ledger``, ``backlog`` and ``gone`` (keys, as ``KeyLedger`` keeps them), ``held`` (whole items), ``output`` and ``progress``. A batch
writes its files under its own number first and its ledger entries after that, under the same number, each
replacing what an earlier try left. A crash between the two exports the batch again and never loses
it; a batch that is run again changes nothing. Items beyond a batch's cap are held as they came and lead the next batch; the ledger's manifest says
where they lie, so that what a later batch has taken never comes back. What earlier batches left incomplete is tried again at the head of each batch.

A batch's counts come from the write itself, which Spark observes, and from tables that are there anyway; no item is read again for them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import dates
from ..operators import jobs, ledger
from ..operators.keyledger import KeyLedger
from ..operators.shared import kept


#: What is counted of a batch.
COUNTED = ("completed", "failed", "skipped", "incomplete", "held")


@dataclass(frozen=True)
class Rules:
    """What a run takes: an owner's own posts (without reposts), a range of days, a number of items a batch."""

    owner: str | None = None
    reposts: bool = False
    first_day: str | None = None
    last_day: str | None = None
    most_items: int | None = None
    expand_threads: bool = False
    #: Ledger entries that are looked at, the last ones; all without a number.
    ledger_tail: int | None = None


def filtered(items: DataFrame, rules: Rules) -> DataFrame:
    """items (key, handle, is_repost, ts) by the rules, in the order that keeps the costly step last."""
    if rules.owner is not None and not rules.reposts:
        items = items.where(~F.col("is_repost") & (F.lower("handle") == rules.owner.lower()))
    if rules.first_day or rules.last_day:
        items = items.where(dates.in_date_range(F.col("ts"), rules.first_day, rules.last_day))
    return items


def with_expansion(items: DataFrame, rules: Rules) -> DataFrame:
    """Whether an item needs its detail: articles always, others if threads are expanded. Articles come first."""
    return items.withColumn("needs_detail", F.col("is_article") | F.lit(rules.expand_threads))


class Exporter:
    """Writes batches of items (``key``, ``seq`` and what the content needs) and keeps the state.

    ``again`` takes pending entries (key, seq), those that earlier batches left incomplete, and gives the items that it found for them, with the columns of a batch
    and ``outcome``: ``found``, or ``gone`` for good. Found items lead a batch, past its rules and its cap; gone ones are settled; those without
    a row stay pending.
    """

    def __init__(self, folder: str, content: Callable[[DataFrame], DataFrame], rules: Rules | None = None, key_type: str = "string", again: Callable[[DataFrame], DataFrame] | None = None):
        self.folder, self.content, self.rules, self.again = folder.rstrip("/"), content, rules or Rules(), again
        self.known = KeyLedger(f"{self.folder}/ledger", key_type, tail=self.rules.ledger_tail)
        self.left, self.given_up = (KeyLedger(f"{self.folder}/{name}", key_type) for name in ("backlog", "gone"))

    def ledger(self, spark: SparkSession) -> DataFrame:
        return self.known.entries(spark)

    def backlog(self, spark: SparkSession) -> DataFrame:
        return self.left.entries(spark)

    def output(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", f"{self.folder}/output").parquet(f"{self.folder}/output")

    def write(self, batch: DataFrame, number: int) -> None:
        """One batch; those that are incomplete go to the backlog and a folder of their own, and not to the ledger."""
        spark = batch.sparkSession
        came = filtered(batch, self.rules)
        held = self.known.manifest(spark, number)["note"]
        if held is not None:
            came = spark.read.schema(came.schema).parquet(f"{self.folder}/held/{held}").unionByName(came)
        # Of a key the row of the least number; rows without a key are all taken.
        names = came.columns
        first = came.where("key IS NOT NULL").groupBy("key").agg(F.min_by(F.struct(*names), "seq").alias("_first")).select("_first.*")
        items = first.unionByName(came.where("key IS NULL"))
        known = self.known.met(items, "key", number)
        if known is not None:
            known = kept(known.select("key").distinct())
            items = ledger.exclude(items, known, "key")
        over, left_over = None, 0
        if self.rules.most_items is not None:
            items, over, left_over = self._within_cap(items, number)
        complete = F.col("complete") if "complete" in batch.columns else F.lit(True)
        items = items.withColumn("status", F.when(complete, "done").otherwise("incomplete"))
        gone = None
        if self.again is not None:
            # Asked once: what comes of it is written, settled and counted.
            tried = kept(self.again(self.pending(spark, before=number)))
            gone = tried.where("outcome = 'gone'").select("key", "seq")
            found = tried.where("outcome = 'found'").select(*names, F.lit("done").alias("status"))
            items = ledger.exclude(items, found, "key").unionByName(found)
        made, seen = self.content(items), Observation()
        counts = [F.count_if(F.col("status") == status).alias(name) for name, status in (("completed", "done"), ("incomplete", "incomplete"))]
        made.observe(seen, *counts).write.mode("overwrite").partitionBy("status").parquet(f"{self.folder}/output/batch={number}")
        written = spark.read.schema(made.schema).parquet(f"{self.folder}/output/batch={number}")
        # An item may be known by a second id, as a repost is; both enter the ledger.
        keys = ["key", *(c for c in ("canonical_key",) if c in made.columns)]
        self.left.add(written.where("status = 'incomplete'").select("key", "seq"), number)
        if gone is not None:
            self.given_up.add(gone, number)
        self._report(spark, number, seen.get | {"failed": 0 if gone is None else gone.count(), "skipped": 0 if known is None else known.count(), "held": left_over})
        # Last: from here on the batch is done.
        self.known.add(ledger.ledger_entries(written.where("status = 'done'"), keys, "seq"), number, note=over)

    def _within_cap(self, items: DataFrame, number: int) -> tuple[DataFrame, str | None, int]:
        """The first items by number and key, where what stands behind the last of them is held, if anything does, and how many that are. Rows alike in both stay together, above the cap if need be."""
        place = F.struct(F.col("seq"), F.col("key"))
        last = items.select(place.alias("at")).orderBy("at").limit(self.rules.most_items).agg(F.max("at").alias("_last"))
        marked = items.join(F.broadcast(last)).withColumn("_taken", F.coalesce(place <= F.col("_last"), F.lit(False))).drop("_last")
        path = f"batch={number}"
        marked.where("NOT _taken").drop("_taken").write.mode("overwrite").parquet(f"{self.folder}/held/{path}")
        left = items.sparkSession.read.schema(items.schema).parquet(f"{self.folder}/held/{path}").count()  # from the files' footers
        return marked.where("_taken").drop("_taken"), path if left else None, left

    def _report(self, spark: SparkSession, number: int, counts: dict[str, int]) -> None:
        spark.createDataFrame([tuple(int(counts[c]) for c in COUNTED)], ", ".join(f"{c} bigint" for c in COUNTED)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/progress/batch={number}")

    def progress(self, spark: SparkSession) -> DataFrame:
        """batch, completed, failed (gone for good), skipped (in the ledger already), incomplete, held, percent of each batch: of what it had before it, items that are finished, well or not.

        A batch that is run again replaces its row.
        """
        told = spark.read.schema(", ".join(f"{c} bigint" for c in COUNTED) + ", batch bigint").option("basePath", f"{self.folder}/progress").parquet(f"{self.folder}/progress")
        total = F.col("completed") + F.col("failed") + F.col("incomplete") + F.col("held")
        return told.select("batch", *COUNTED, jobs.progress_percent(F.col("completed"), F.col("failed"), total).alias("percent"))

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def pending(self, spark: SparkSession, cap: int = 2000, before: int | None = None) -> DataFrame:
        """Backlog entries (key, seq) that no later batch has exported or given up, the last ones within the cap: what the next batch tries first."""
        once = self.left.entries(spark, before).groupBy("key").agg(F.min("seq").alias("seq"))
        return ledger.tail(self.given_up.exclude(self.known.exclude(once, "key", before), "key", before), cap, "seq")


def start_cursor(cursors: DataFrame, mode: str, source: str, first_day: str | None = None, last_day: str | None = None) -> str | None:
    """Where a run begins: ``recent`` at the top, ``resume`` at the source's cursor, ``date`` at that of the same range of days."""
    if mode == "recent":
        return None
    same = (F.col("mode") == mode) & (F.col("source") == source)
    if mode == "date":
        same &= F.col("date_from").eqNullSafe(F.lit(first_day)) & F.col("date_to").eqNullSafe(F.lit(last_day))
    found = cursors.where(same).select("cursor").limit(1).collect()
    return found[0][0] if found else None
