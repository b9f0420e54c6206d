"""The job state machine over a stream of results: one state a job, with a timer for items that never answer."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import jobs

#: An event is a start or append (url holds a JSON list of addresses), result, pause, resume, cancel or tick.
EVENTS = "job STRING, seq BIGINT, kind STRING, url STRING, success BOOLEAN, name STRING, at_ms BIGINT"
STATES = "job STRING, seq BIGINT, status STRING, completed INT, failed INT, failed_in_a_row INT, next_index INT, name STRING"
_STATE = "state STRING"


def stepped(job: jobs.Job | None, event) -> tuple[jobs.Job | None, str | None]:
    """The job after one event, and the name that a successful result is written under.

    A start makes the job from its distinct addresses and sends the first on its way. Whatever lets
    the job go on sends the next, with a deadline; a tick past it counts as that item's failure.
    """
    kind, name = event.kind, None
    at = 0 if pd.isna(event.at_ms) else int(event.at_ms)
    if kind == "start":
        job = jobs.replace(jobs.created(json.loads(event.url), datetime.fromtimestamp(at / 1000, UTC)), id=event.job) if job is None else job
    elif job is None:
        return None, None
    elif kind == "result":
        job, name = jobs.recorded(job, bool(event.success), event.name or "", event.url)
    elif kind == "append":
        job = jobs.appended(job, json.loads(event.url), set())[0]
    elif kind == "tick":
        job = jobs.ticked(job, at)
    else:
        job = {"pause": jobs.paused, "resume": jobs.resumed, "cancel": jobs.cancelled}.get(kind, lambda j: j)(job)
    return (job if job.awaiting else jobs.dispatched(job, at)), name


def _dump(job: jobs.Job, seq: int) -> str:
    return json.dumps({"job": job.__dict__, "seq": seq})


def _load(text: str) -> tuple[jobs.Job, int]:
    read = json.loads(text)
    return jobs.Job(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in read["job"].items()}), read["seq"]


def _shown(job: jobs.Job, seq: int, name: str | None) -> tuple:
    return job.id, seq, job.status, job.completed, len(job.failures), job.failed_in_a_row, job.next_index, name


def run_group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One job's events of a trigger, or its timer; a timer that goes off gives a row of its own, under the last event's number."""
    job, seq = _load(state.get[0]) if state.exists else (None, 0)
    out = []
    if state.hasTimedOut:
        late = job.deadline or 0
        job = jobs.dispatched(jobs.ticked(job, late), late)
        out.append(_shown(job, seq, None))
    else:
        # Events of one job in one trigger; they are bounded by the job's items.
        for event in pd.concat(list(batches)).sort_values("seq").itertuples():
            job, name = stepped(job, event)
            if job is not None:
                seq = int(event.seq)
                out.append(_shown(job, seq, name))
    if job is not None:
        state.update((_dump(job, seq),))
        if job.awaiting:
            state.setTimeoutDuration(jobs.ITEM_MS)
    yield pd.DataFrame(out, columns=["job", "seq", "status", "completed", "failed", "failed_in_a_row", "next_index", "name"])


def without_exported(events: DataFrame, exported: DataFrame) -> DataFrame:
    """events of which appends hold no address of a post in the ledger ``exported`` (key): each address is an event of its own, joined to the ledger before any state."""
    appends = events.where("kind = 'append'").withColumn("url", F.explode(F.from_json("url", "array<string>")))
    known = exported.select(F.col("key").cast("string").alias("_known")).where("_known IS NOT NULL").distinct().withColumn("_there", F.lit(True))
    left = appends.join(known, F.regexp_extract("url", r"/status/(\d+)", 1) == known["_known"], "left").where("_there IS NULL")
    return events.where("kind <> 'append'").unionByName(left.withColumn("url", F.to_json(F.array("url"))).select(*events.columns))


def run_jobs(events: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """A row with the job's state after each event of a stream of ``EVENTS``, and after each timer that goes off.

    Addresses of posts in the ledger ``exported`` aren't appended; it is read anew at each trigger if it is a table of files.
    """
    if exported is not None:
        events = without_exported(events, exported)
    return events.groupBy("job").applyInPandasWithState(run_group, STATES, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
