"""A feed of pages as a Spark source: ``spark.read.format("paged_feed")``, ``spark.readStream``, and ``feed`` over any store that Spark reads.

Pages lie as JSON files, one a page, in a folder that every executor reads (option ``path``), named
``<cursor>.json``; the first is ``start.json`` or what ``cursor`` names. A page says where it goes on
by its bottom cursor. The live feed itself is not fetched.

The source has a partition a page, which an executor reads as Arrow batches. What the driver follows is cursors alone: it looks at
the two ends of a page's file, and at the whole only where these don't tell. ``feed`` doesn't even do that; there executors read the cursors and the
order is found by ranking.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..content import columns
from ..content.posts import feed_page
from ..operators import chains

SCHEMA = "page INT, pos INT, post STRING, cursor STRING"


def pages(fetch: Callable[[str], dict | None], cursor: str = "start", most: int = 50) -> Iterator[tuple[str, dict]]:
    """(cursor, page) of each page until one is empty, has no cursor or isn't there, at most ``most``."""
    for _ in range(most):
        raw = fetch(cursor)
        page = feed_page(raw) if raw is not None else {"posts": [], "cursor": None, "done": True}
        if page["posts"]:
            yield cursor, page
        if page["done"] or not page["cursor"]:
            return
        cursor = page["cursor"]


def from_folder(path: str) -> Callable[[str], dict | None]:
    def fetch(cursor: str) -> dict | None:
        try:
            with open(os.path.join(path.removeprefix("file:"), f"{os.path.basename(cursor)}.json"), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    return fetch


#: Bytes of either end of a page's file that the driver looks at.
EDGE = 16 << 10
_BOTTOM = re.compile(rb'\{[^{}]*"cursorType"\s*:\s*"Bottom"[^{}]*\}')
_POST = re.compile(rb'"tweet_results"\s*:\s*\{\s*"result"\s*:\s*\{\s*"')


def next_cursor(path: str, cursor: str) -> tuple[bool, str | None]:
    """Whether the page of a cursor is there and has posts, and the cursor that it gives.

    A file that begins with a post and ends with one bottom cursor tells both by its ends; any other is read as a whole, as are those with entries that replace others.
    """
    try:
        with open(os.path.join(path.removeprefix("file:"), f"{os.path.basename(cursor)}.json"), "rb") as f:
            head = f.read(EDGE)
            size = f.seek(0, os.SEEK_END)
            f.seek(max(0, size - EDGE))
            tail = f.read()
            found = _BOTTOM.findall(tail)
            if size > EDGE and len(found) == 1 and _POST.search(head) and b"TimelineReplaceEntry" not in head + tail:
                return True, json.loads(found[0]).get("value")
            f.seek(0)
            page = feed_page(json.loads(f.read()))
            return bool(page["posts"]), page["cursor"]
    except FileNotFoundError:
        return False, None


class Chain:
    """The cursors of a feed, followed as far as there are pages."""

    def __init__(self, options: dict):
        self.path, self.first = options["path"], options.get("cursor", "start")
        #: Cursors in the order of their pages, and what the last of them gives: a page that isn't there yet, or none.
        self.order: list[str] = []
        self.ahead: str | None = self.first
        self._seen: set[str] = set()

    def follow(self, most: int | None = None) -> int:
        """How many pages there are now, or ``most``; what has been followed isn't looked at again."""
        while self.ahead and self.ahead not in self._seen and (most is None or len(self.order) < most):
            there, after = next_cursor(self.path, self.ahead)
            if not there:
                break
            self._seen.add(self.ahead)
            self.order.append(self.ahead)
            self.ahead = after
        return len(self.order) if most is None else min(most, len(self.order))


class Page(InputPartition):
    def __init__(self, number: int, cursor: str):
        super().__init__(number)
        self.number, self.cursor = number, cursor


def page_batches(path: str, page: Page) -> Iterator[pa.RecordBatch]:
    """The rows of one page; a page that has gone since gives none."""
    raw = from_folder(path)(page.cursor)
    if raw is None:
        return
    read = feed_page(raw)
    posts = [json.dumps(p, ensure_ascii=False) for p in read["posts"]]
    numbers = [pa.array([page.number] * len(posts), pa.int32()), pa.array(range(len(posts)), pa.int32())]
    yield pa.RecordBatch.from_arrays([*numbers, pa.array(posts, pa.string()), pa.array([read["cursor"]] * len(posts), pa.string())], ["page", "pos", "post", "cursor"])


def feed(spark: SparkSession, path: str, cursor: str = "start", most: int = 50) -> DataFrame:
    """page, pos, post, cursor as the source gives them, from ``<cursor>.json`` files in any store that Spark reads.

    Pages are parsed by executors, and their order from ``cursor`` is found by ``chains.places``, so nothing of a page comes to the driver.
    A page that has no posts or isn't there ends the feed, as does one that has been before; pages that nothing leads to are left out. An empty folder gives no rows.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("name"), columns.feed_pages("value").alias("page"))
    files = files.where("name <> ''").select(F.url_decode("name").alias("name"), "page.posts", "page.cursor", "page.done").where("size(posts) > 0")
    links = files.select(F.col("name").alias("node"), F.when(~F.col("done") & (F.col("cursor") != ""), F.col("cursor")).alias("then"))
    order = chains.places(links, spark.createDataFrame([(0, cursor)], "chain int, node string"), most=most)
    found = files.join(order.select(F.col("node").alias("name"), F.col("place").cast("int").alias("number")), "name")
    return found.select(F.col("number").alias("page"), F.posexplode("posts").alias("pos", "post"), "cursor")


class PagedFeed(DataSource):
    """Register with ``spark.dataSource.register(PagedFeed)``. Options: path, cursor, maxPages, maxPagesPerTrigger, progress."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        chain = Chain(self.options)
        return [Page(n, chain.order[n]) for n in range(chain.follow(int(self.options.get("maxPages", 50))))]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        yield from page_batches(self.options["path"], partition)


class _Stream(DataSourceStreamReader):
    """The offset is the number of pages that have been read, and the cursor of the next one; a batch has a partition a page.

    A batch has ``maxPagesPerTrigger`` pages. Spark doesn't tell a reader how far its query has come, so the reader notes that in the file that
    the option ``progress`` names, and a query that starts again from its checkpoint is bounded from there. Without
    that file the first batch after a start has all pages that are there, each in a partition of its own, and later ones are bounded.
    """

    def __init__(self, options: dict):
        self.options, self.chain, self.progress = options, Chain(options), options.get("progress")
        self.most, self.at = int(options.get("maxPagesPerTrigger", 1)), None

    def _offset(self, pages: int) -> dict:
        return {"page": pages, "cursor": (self.chain.order[pages] if pages < len(self.chain.order) else self.chain.ahead) or ""}

    def _noted(self) -> int | None:
        """Pages that the query has read for certain, and one batch more, which it may have read as well; none if it is new."""
        if self.progress is None:
            return None
        try:
            with open(self.progress, encoding="utf-8") as f:
                was = json.load(f)
            return was["page"] + was["most"]
        except FileNotFoundError:
            return self.most

    def initialOffset(self) -> dict:
        return self._offset(0)

    def latestOffset(self) -> dict:
        self.at = self.chain.follow(self._noted() if self.at is None else self.at + self.most)
        return self._offset(self.at)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.chain.follow(end["page"])
        self.at = max(self.at or 0, end["page"])
        return [Page(n, self.chain.order[n]) for n in range(start["page"], end["page"])]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        yield from page_batches(self.options["path"], partition)

    def commit(self, end: dict) -> None:
        if self.progress is not None:
            with open(f"{self.progress}.new", "w", encoding="utf-8") as f:
                json.dump({"page": end["page"], "most": self.most}, f)
            os.replace(f"{self.progress}.new", self.progress)
