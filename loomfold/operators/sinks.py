"""Files of a run: one per item, combined ones, archives and the manifest, written once the run is over."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..content import columns, html
from ..functions import text
from ..functions.urls import safe_path
from . import export, longfiles
from .shared import kept

#: Files that are written at the same time.
IN_FLIGHT = 8


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder as Spark names it, and the folder's path in it."""
    at = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(at.replace("s3a://", "s3://", 1))


def write_file(store: fs.FileSystem, root: str, name: str, content: bytes) -> int:
    """Writes a file under a safe form of its name, whole or not at all; its size."""
    path = f"{root}/{safe_path(name)}"
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.part"
    with store.open_output_stream(part, compression=None) as out:
        out.write(content)
    store.move(part, path)
    return len(content)


def write_files(files: DataFrame, folder: str, in_flight: int = IN_FLIGHT) -> DataFrame:
    """name, n_bytes, error of files (name, content as text or bytes) when the result is computed: each is written to ``folder``.

    A file that can't be written has an error in place of a size, and the others go on. A task that runs
    again writes the same files again. A null name becomes the default one, null content an empty file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out.append((name, write_file(store, root, name, content.encode() if isinstance(content, str) else content or b""), None))
                except (OSError, pa.ArrowException) as e:
                    out.append((name, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate([pa.string(), pa.int64(), pa.string()])], ["name", "n_bytes", "error"])

    return files.select("name", "content").repartition(in_flight).mapInArrow(run, "name string, n_bytes bigint, error string")


def write_details(details: DataFrame, folder: str, key: str, raw: str = "raw") -> DataFrame:
    """name, n_bytes, error of the raw details that are kept to look into, a file ``debug/detail-<id>.json`` each; ids and details that are null are left out."""
    there = details.where(F.col(key).isNotNull() & F.col(raw).isNotNull())
    return write_files(there.select(F.concat(F.lit("debug/detail-"), F.col(key).cast("string"), F.lit(".json")).alias("name"), F.col(raw).alias("content")), folder)


def write_combined(rows: DataFrame, folder: str, fmt: str, options: export.Options, name: str = "name", order: str = "pos") -> DataFrame:
    """Writes the items of each file ``name`` (wire rows with ``document`` and, for CSV, ``body_markdown``), in order, as one file of any length; name, n_items, n_bytes, error of each.

    The bytes are those that ``export.combined_files`` gives a run in one part: Markdown and text between rules, pages under one style sheet, JSON in an array, CSV below one header.
    """
    rule, head, foot = "\n\n---\n\n", None, "\n"
    rows = export.csv_lines(rows, options) if fmt == "csv" else rows
    if fmt == "md":
        content = text.trimmed(columns.markdown_of("document"))
    elif fmt == "txt":
        content = text.markdown_to_plain(columns.markdown_of("document"))
    elif fmt == "csv":
        content, rule, head = F.col("csv_line"), "\n", lambda n: F.lit(export.csv_header(options) + "\n")
    elif fmt == "html":
        content, rule, foot = columns.html_card_of("document"), html.CARD_RULE, html.around_cards("")[1]
        before, _, behind = html.around_cards("\0")[0].partition("\0")
        head = lambda n: F.concat(F.lit(before), n.cast("string"), F.lit(behind))
    else:
        content, rule, head, foot = F.concat(F.lit("  "), F.replace(columns.pretty_json_of("document"), F.lit("\n"), F.lit("\n  "))), ",\n", lambda n: F.lit("[\n"), "\n]"
    return longfiles.write_long(rows.select(F.col(name).alias("name"), F.col(order).alias("at"), content.alias("content")), folder, "name", "at", "content", rule, foot, head)


def write_run(rows: DataFrame, folder: str, fmt: str, output: str, order: str, at: datetime, options: export.Options, zip_items: bool = False, failures: list[dict] | None = None, status: str = "done") -> DataFrame:
    """Writes what a run of any length leaves and returns a row (name, n_bytes, error) for each file, kept.

    ``rows`` are the run's wire rows with ``document`` and ``body_markdown``, which ``order`` tells apart. ``output`` is ``files``, ``combined`` or ``both``: files per item, as they are or in one archive that isn't
    written when it is empty; one combined file; and the manifest in any case, for cancelled runs as well. Nothing of the items comes to the driver but their number.
    """
    output, zip_items = export.effective_output(fmt, output, zip_items, options.download_images)
    day = f"{at:%Y-%m-%d}"
    names = export.post_processed(rows, options)
    written: list[DataFrame] = []
    if output != "combined":
        items = export.item_files(names, fmt)
        if not zip_items:
            written.append(kept(write_files(items, folder)))
        else:
            entries = items.select(F.lit(export.archive_name(day)).alias("archive"), F.col(order).alias("at"), "name", "content")
            written.append(longfiles.write_zip(entries, folder, at, "archive", "at", "name", "content"))
    if output != "files":
        written.append(write_combined(rows.withColumn("_file", F.lit(export.combined_name(fmt, day))), folder, fmt, options, "_file", order))
    # The manifest is one object: what the driver knows, and then a line for each item.
    known = {"generator": "loomfold", "exportedAt": f"{at:%Y-%m-%dT%H:%M:%S.000Z}", "status": status, "completed": rows.count(), "failures": failures or []}
    opening = json.dumps(known, ensure_ascii=False, indent=2).removesuffix("\n}") + ',\n  "items": ['
    lines = names.select(F.lit("data.json").alias("name"), F.col(order).alias("at"), F.to_json(F.struct("tweet_id", F.col("source_url").alias("url"), "filename"), {"ignoreNullFields": "false"}).alias("content"))
    if known["completed"]:
        written.append(longfiles.write_long(lines, folder, "name", "at", "content", ",\n    ", "\n  ]\n}", lambda n: F.lit(opening + "\n    ")))
    else:
        store, root = store_of(folder)
        size = write_file(store, root, "data.json", (opening + "]\n}").encode())
        written.append(rows.sparkSession.createDataFrame([("data.json", size, None)], "name string, n_bytes bigint, error string"))
    every = [w.select("name", "n_bytes", "error") for w in written]
    return functools.reduce(DataFrame.unionByName, every)
