"""Details of items by their ids, a few at a time: retries, what is gone, and a stop at the rate limit."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from ..operators.sinks import store_of

#: Requests under way at a time, further tries after the first, and seconds before the first of those.
IN_FLIGHT, RETRIES, WAIT = 3, 2, 1.0


class Refused(Exception):
    """A request that failed, with the HTTP status, or without one if the network did."""

    def __init__(self, status: int | None = None):
        super().__init__(f"status {status}" if status else "no answer")
        self.status = status

    def kind(self) -> str:
        """``rate_limit``, ``transient`` or ``permanent``."""
        if self.status == 429:
            return "rate_limit"
        return "transient" if self.status is None or self.status >= 500 else "permanent"


def landed(folder: str) -> Callable[[str], str]:
    """Details from ``<folder>/<id>.json`` in any store that ``pyarrow.fs`` reads; what isn't there is gone."""
    opened: list = []

    def fetch(identity: str) -> str:
        if not opened:
            opened.append(store_of(folder))
        store, root = opened[0]
        path = f"{root}/{identity}.json"
        if store.get_file_info(path).type != fs.FileType.File:
            raise Refused(404)
        with store.open_input_stream(path, compression=None) as f:
            return f.read().decode()

    return fetch


def patiently(fetch: Callable[[str], str], identity: str, retries: int = RETRIES, wait: float = WAIT) -> str:
    """Tries again after what may pass, each time after twice the wait and up to half of it more; what is permanent is raised at once."""
    for attempt in range(retries + 1):
        try:
            return fetch(identity)
        except Refused as e:
            if e.kind() == "permanent" or attempt == retries:
                raise
            time.sleep(wait * 2**attempt * (1 + random.random() / 2))
    raise AssertionError


def fetched(items: DataFrame, key: str, fetch: Callable[[str], str], in_flight: int = IN_FLIGHT, retries: int = RETRIES, wait: float = WAIT) -> DataFrame:
    """key, raw, status, error of each distinct item: ``done``, ``gone`` (no detail to be had, the root stays), ``rate_limit`` or ``pending``.

    Items are split over ``in_flight`` workers by their key. A worker that meets the rate limit asks for nothing more, and the
    rest of its items are pending, to be tried by another run. A null key is gone. A task that runs again asks again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stopped = False
        for batch in batches:
            out = []
            for identity in batch.column(0).to_pylist():
                raw, status, error = None, "pending", None
                if identity is None:
                    status = "gone"
                elif not stopped:
                    try:
                        raw, status = patiently(fetch, identity, retries, wait), "done"
                    except Refused as e:
                        status, error = ("rate_limit" if e.kind() == "rate_limit" else "gone"), str(e)
                        stopped = status == "rate_limit"
                out.append((identity, raw, status, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(4)], [key, "raw", "status", "error"])

    ids = items.select(items[key].cast("string").alias(key)).distinct()
    return ids.repartition(in_flight, key).mapInArrow(run, f"`{key}` string, raw string, status string, error string")
