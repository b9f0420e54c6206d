"""The export job as a state machine: pure transitions, a fold over result tables, and the review prompt's cadence."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import Names
from .runs import failure_runs

#: Items of a job, failures in a row at which it pauses, and milliseconds that an item may take.
MOST_ITEMS, PAUSE_AT, ITEM_MS = 200, 5, 90_000
REVIEW_FIRST, REVIEW_AGAIN = 30, 50

_PERMALINK = re.compile(r"https?://(?:www\.)?x\.com/[^/]+/status/(\d+)")


@dataclass(frozen=True)
class Job:
    id: str
    urls: tuple[str, ...]
    folder: str = ""
    status: str = "running"
    next_index: int = 0
    completed: int = 0
    failures: tuple[tuple[str, str], ...] = ()
    failed_in_a_row: int = 0
    pause_reason: str | None = None
    names: tuple[str, ...] = ()
    awaiting: bool = False
    deadline: int | None = None

    @property
    def current(self) -> str | None:
        return self.urls[self.next_index] if self.status == "running" and self.next_index < len(self.urls) else None


def created(urls: list[str], now: datetime, prefix: str = "batch") -> Job:
    """A job of the first 200 distinct permalinks; other addresses are failures from the start."""
    found = [(u, m[0] if (m := _PERMALINK.match(u)) else None) for u in urls]
    kept = tuple(dict.fromkeys(p for _, p in found if p))[:MOST_ITEMS]
    failed = tuple((u, "no address of a post") for u, p in found if not p)
    return Job(f"{prefix}-{int(now.timestamp() * 1000)}", kept, f"{prefix}-{now:%Y%m%d-%H%M%S}", failures=failed)


def dispatched(job: Job, now_ms: int) -> Job:
    return replace(job, awaiting=True, deadline=now_ms + ITEM_MS) if job.current is not None else job


def recorded(job: Job, success: bool, name_or_error: str, url: str | None = None, pause_at: int = PAUSE_AT) -> tuple[Job, str | None]:
    """The job after a result, and the name to write under.

    Nothing changes unless the job runs, nor for a result of another item than the current one.
    Too many failures in a row pause the job.
    """
    now = job.current
    if now is None or url is not None and _id(url) != _id(now):
        return job, None
    name, after = None, replace(job, awaiting=False, deadline=None, next_index=job.next_index + 1)
    if success:
        name = Names(job.names).give(name_or_error)
        after = replace(after, names=(*job.names, name.lower()), completed=job.completed + 1, failed_in_a_row=0)
    else:
        after = replace(after, failures=(*job.failures, (now, name_or_error)), failed_in_a_row=job.failed_in_a_row + 1)
    if after.next_index >= len(after.urls):
        after = replace(after, status="done")
    elif after.failed_in_a_row >= pause_at:
        after = replace(paused(after), pause_reason=f"{after.failed_in_a_row} failures in a row")
    return after, name


def _id(url: str) -> str | None:
    m = re.search(r"/status/(\d+)", url)
    return m[1] if m else None


def appended(job: Job, urls: list[str], exported: set[str]) -> tuple[Job, int]:
    """The job with new posts at its end, within its room; by id, so that another address of the same post isn't new."""
    if job.status not in ("running", "paused"):
        return job, 0
    seen = {_id(u) for u in job.urls} | exported
    new: list[str] = []
    for u in urls:
        m = _PERMALINK.match(u)
        if m and m[1] not in seen and len(job.urls) + len(new) < MOST_ITEMS:
            seen.add(m[1])
            new.append(m[0])
    return replace(job, urls=(*job.urls, *new)), len(new)


def paused(job: Job) -> Job:
    """The item on its way is given up; its result will be dropped."""
    return replace(job, status="paused", awaiting=False, deadline=None) if job.status == "running" else job


def resumed(job: Job) -> Job:
    return replace(job, status="running", pause_reason=None, failed_in_a_row=0) if job.status == "paused" else job


def cancelled(job: Job) -> Job:
    return replace(job, status="cancelled", awaiting=False, deadline=None)


def ticked(job: Job, now_ms: int) -> Job:
    """An item that is past its deadline has failed."""
    if job.awaiting and job.deadline is not None and now_ms >= job.deadline:
        return recorded(job, False, "timed out")[0]
    return job


def folded(results: DataFrame, job: str, order: str, failed: Column, pause_at: int = PAUSE_AT) -> DataFrame:
    """job, status, completed, failed of each job from its results in order, by windows.

    A job pauses at ``pause_at`` failures in a row, and results after that don't count.
    """
    marked = failure_runs(results.withColumn("_bad", F.coalesce(failed, F.lit(False))), job, order, F.col("_bad"), "_run")
    stop = F.min(F.when(F.col("_run") >= pause_at, F.col(order))).over(Window.partitionBy(job))
    counted = marked.withColumn("_stop", stop).withColumn("_counts", F.coalesce(F.col(order) <= F.col("_stop"), F.lit(True)))
    return counted.groupBy(job).agg(
        F.when(F.max("_stop").isNull(), "done").otherwise("paused").alias("status"), F.count_if(F.col("_counts") & ~F.col("_bad")).alias("completed"), F.count_if(F.col("_counts") & F.col("_bad")).alias("failed")
    )


def error_class(status: Column) -> Column:
    """What an HTTP status means for a retry; without one the network failed."""
    return F.when(status == 429, "rate_limit").when((status >= 500) | status.isNull(), "transient").otherwise("permanent")


@dataclass(frozen=True)
class Review:
    """When to ask for a review: at 30 exports, once more 50 later, then never."""

    count: int = 0
    status: str = "unseen"
    next_at: int = REVIEW_FIRST

    def exported(self) -> Review:
        return self if self.status == "closed" else replace(self, count=self.count + 1)

    def due(self) -> bool:
        return self.status != "closed" and self.count >= (self.next_at if self.status == "snoozed" else REVIEW_FIRST)

    def snoozed(self) -> Review:
        return replace(self, status="closed") if self.status == "snoozed" else replace(self, status="snoozed", next_at=self.count + REVIEW_AGAIN)

    def closed(self) -> Review:
        return replace(self, status="closed")


@dataclass(frozen=True)
class Progress:
    """What a run reports while it runs: items that are finished, well or not, and those that were passed over or came incomplete."""

    total: int
    completed: int = 0
    failed: int = 0
    skipped: int = 0
    incomplete: int = 0

    @classmethod
    def of(cls, job: Job) -> Progress:
        return cls(len(job.urls), job.completed, len(job.failures))

    def percent(self) -> int:
        """Halves are rounded up."""
        return (200 * (self.completed + self.failed) + self.total) // (2 * self.total) if self.total else 0


def progress_percent(completed: Column, failed: Column, total: Column) -> Column:
    """``Progress.percent`` of columns; 0 of nothing."""
    return F.when(total > 0, F.floor(100 * (completed + failed) / total + 0.5)).otherwise(0).cast("int")


def valid_result(success: Column, markdown: Column, name: Column) -> Column:
    """Whether a result counts as a success: it says so, and has both content and a name."""
    return F.coalesce(success, F.lit(False)) & markdown.isNotNull() & name.isNotNull()
