"""One file of any length from the rows of many tasks: each row's place in bytes comes of running sums, and tasks write side by side.

Rows are measured, summed up in order range by range, and written where they belong; nothing gathers a file. In a folder of the machine or one that is
mounted everywhere, tasks write at their offsets into one file that gets its name when it is whole. A store that only takes whole
streams gets each file from one task, which passes its rows through in order. A task that runs again writes the same bytes to the same places.
"""

from __future__ import annotations

import os
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import safe_path
from . import sinks
from .shared import gone, kept, running

#: Files that a task has open at the same time.
OPEN_FILES = 16
#: Fixed values of the archive format: Unix, version 2.0 and 4.5 (long offsets), names in UTF-8, a private file.
UNIX, PLAIN, LONG, UTF8_NAMES, PRIVATE = 3, 20, 45, 0x800, 0o600 << 16


def _assemble(chunks: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """name, n_items, n_bytes, error of ``files`` (name, n_items, size) once ``chunks`` (name, offset, bytes) are written; kept."""
    store, root = sinks.store_of(folder)
    mark = f".{uuid.uuid4().hex}.part"
    at_offsets = isinstance(store, fs.LocalFileSystem)

    def place(name: str) -> str:
        return f"{root}/{safe_path(name)}"

    def scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, int] = {}
        try:
            for batch in batches:
                names, sizes = [], []
                for name, offset, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if name not in opened:
                        if len(opened) >= OPEN_FILES:
                            os.close(opened.pop(next(iter(opened))))
                        os.makedirs(os.path.dirname(place(name)), exist_ok=True)
                        opened[name] = os.open(place(name) + mark, os.O_WRONLY | os.O_CREAT, 0o644)
                    done, view = 0, memoryview(data)
                    while done < len(view):
                        done += os.pwrite(opened[name], view[done:], offset + done)
                    names.append(name)
                    sizes.append(len(data))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "n"])
        finally:
            for fd in opened.values():
                os.close(fd)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = sinks.store_of(folder)
        now, out = None, None
        for batch in batches:
            sizes = []
            for name, _, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != now:
                    if out is not None:
                        out.close()
                    store.create_dir(place(name).rpartition("/")[0], recursive=True)
                    now, out = name, store.open_output_stream(place(name) + mark, compression=None)
                out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "n"])
        if out is not None:
            out.close()

    rows = chunks.select("name", F.col("offset").cast("bigint"), "bytes")
    if at_offsets:
        written = rows.repartitionByRange("name", "offset").sortWithinPartitions("name", "offset").mapInArrow(scattered, "name string, n bigint")
    else:
        written = rows.repartition("name").sortWithinPartitions("name", "offset").mapInArrow(streamed, "name string, n bigint")
    sums = kept(written.groupBy("name").agg(F.sum("n").alias("n_bytes")))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = sinks.store_of(folder)
        for batch in batches:
            errors = []
            for name, size, n in zip(*(batch.column(c).to_pylist() for c in ("name", "size", "n_bytes")), strict=True):
                if size == n and store.get_file_info(place(name) + mark).type == fs.FileType.File:
                    store.move(place(name) + mark, place(name))
                there = store.get_file_info(place(name))
                errors.append(None if there.type == fs.FileType.File and there.size == size else f"{n} of {size} bytes")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("name", "n_items", "n_bytes")), pa.array(errors, pa.string())], ["name", "n_items", "n_bytes", "error"])

    done = kept(files.join(sums, "name").mapInArrow(named, "name string, n_items bigint, n_bytes bigint, error string"))
    gone(sums)
    return done


def write_long(pieces: DataFrame, folder: str, name: str = "name", order: str = "pos", content: str = "content", separator: str = "", foot: str = "", head: Callable[[Column], Column] | None = None) -> DataFrame:
    """Writes the rows of each file ``name``, in order, as one file; name, n_items, n_bytes, error of each.

    Between two rows stands ``separator``, behind the last ``foot``, and before the first what ``head`` makes of the number of rows. ``order`` tells the
    rows of a file apart. Null content is empty; no rows give no file. A file has as many rows and bytes as there are.
    """
    parts = [F.col(f"`{c}`") for c in (name, order, content)]
    held = kept(pieces.select(parts[0].alias("name"), parts[1].alias("at"), F.coalesce(parts[2].cast("binary"), F.lit(b"")).alias("body")))
    gap = len(separator.encode())
    sizes = held.select("name", "at", (F.octet_length("body") + F.lit(gap)).cast("bigint").alias("step"))
    opening = head(F.col("n_items")) if head else F.lit("")
    files = sizes.groupBy("name").agg(F.count("*").alias("n_items"), F.sum("step").alias("steps")).withColumn("head", opening.cast("binary"))
    files = kept(files.withColumn("size", F.octet_length("head") + F.col("steps") - gap + len(foot.encode())))
    placed = running(sizes, ["name"], ["at"], "step", "upto")
    starts = placed.select("name", "at", (F.col("upto") - F.col("step")).alias("start")).join(files.select("name", F.octet_length("head").alias("ahead")), "name")
    mark = F.lit(separator.encode())
    body = held.join(starts, ["name", "at"]).select("name", F.when(F.col("start") == 0, F.col("ahead")).otherwise(F.col("ahead") + F.col("start") - gap).alias("offset"), F.when(F.col("start") == 0, F.col("body")).otherwise(F.concat(mark, "body")).alias("bytes"))
    ends = files.select("name", F.lit(0).cast("bigint").alias("offset"), F.col("head").alias("bytes")).unionByName(files.select("name", (F.col("size") - len(foot.encode())).alias("offset"), F.lit(foot.encode()).alias("bytes")))
    done = _assemble(body.unionByName(ends), files.select("name", "n_items", "size"), folder)
    for table in (held, placed, files):
        gone(table)
    return done


def _stamp(at: datetime) -> tuple[int, int]:
    """Time and date of an entry: in two seconds from midnight, in days of months of years from 1980."""
    return at.hour << 11 | at.minute << 5 | at.second // 2, (at.year - 1980) << 9 | at.month << 5 | at.day


def _flags(name: bytes) -> int:
    """A name beyond ASCII is marked as UTF-8."""
    return 0 if name.isascii() else UTF8_NAMES


def local_header(name: bytes, crc: int, size: int, at: datetime) -> bytes:
    return struct.pack("<4s5H3I2H", b"PK\3\4", PLAIN, _flags(name), zipfile.ZIP_STORED, *_stamp(at), crc, size, size, len(name), 0) + name


def directory_entry(name: bytes, crc: int, size: int, offset: int, at: datetime, limit: int) -> bytes:
    """An entry of the directory at an archive's end; an offset beyond the limit goes into an extra field of 64 bits."""
    far = offset > limit
    extra = struct.pack("<2HQ", 1, 8, offset) if far else b""
    version = LONG if far else PLAIN
    fields = (version, UNIX, version, _flags(name), zipfile.ZIP_STORED, *_stamp(at), crc, size, size, len(name), len(extra), 0, 0, 0, PRIVATE, 0xFFFFFFFF if far else offset)
    return struct.pack("<4s2B5H3I5H2I", b"PK\1\2", *fields) + name + extra


def archive_end(entries: int, directory: int, offset: int, limit: int) -> bytes:
    """The end of an archive; one with many entries or far offsets has the long form before it."""
    long = b""
    if entries > zipfile.ZIP_FILECOUNT_LIMIT or directory > limit or offset > limit:
        long = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, LONG, LONG, 0, 0, entries, entries, directory, offset) + struct.pack("<4sIQI", b"PK\6\7", 0, offset + directory, 1)
    count = min(entries, 0xFFFF)
    return long + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, count, count, min(directory, 0xFFFFFFFF), min(offset, 0xFFFFFFFF), 0)


def write_zip(entries: DataFrame, folder: str, at: datetime, archive: str = "archive", order: str = "pos", name: str = "name", content: str = "content", limit: int = zipfile.ZIP64_LIMIT) -> DataFrame:
    """Writes the entries of each ``archive``, in order, as one uncompressed zip; name, n_items, n_bytes, error of each.

    Entries are headed and checked by the tasks that write them; the directory is written the same way, behind them, with 64-bit
    offsets where they are beyond ``limit``. The bytes are those of an archive written entry by entry. Null content is empty; no entries give no archive.
    """
    parts = [F.col(f"`{c}`") for c in (archive, order, name, content)]
    body = F.coalesce(parts[3].cast("binary"), F.lit(b""))
    held = kept(entries.select(parts[0].alias("name"), parts[1].alias("at"), parts[2].alias("entry"), body.alias("body"), F.crc32(body).alias("crc"), F.octet_length(body).cast("bigint").alias("size")))
    long = F.octet_length("entry").cast("bigint")
    narrow = held.select("name", "at", "entry", "crc", "size", (30 + long + F.col("size")).alias("step"))
    placed = running(narrow, ["name"], ["at"], "step", "upto")
    listed = placed.withColumn("offset", F.col("upto") - F.col("step")).withColumn("line", 46 + long + F.when(F.col("offset") > limit, 12).otherwise(0))
    lines = running(listed.drop("step", "upto"), ["name"], ["at"], "line", "upto")
    files = kept(placed.groupBy("name").agg(F.count("*").alias("n_items"), F.sum("step").alias("data")).join(lines.groupBy("name").agg(F.sum("line").alias("directory")), "name"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, offset, entry, crc, size, data = (c.to_pylist() for c in batch.columns)
            made = [local_header(e.encode(), c, s, at) + d for e, c, s, d in zip(entry, crc, size, data, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(made, pa.binary())], ["name", "offset", "bytes"])

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, place, entry, crc, size, offset = (c.to_pylist() for c in batch.columns)
            made = [directory_entry(e.encode(), c, s, o, at, limit) for e, c, s, o in zip(entry, crc, size, offset, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(place, pa.int64()), pa.array(made, pa.binary())], ["name", "offset", "bytes"])

    def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, n, data, directory = (c.to_pylist() for c in batch.columns)
            made = [archive_end(*x, limit) for x in zip(n, directory, data, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array([a + b for a, b in zip(data, directory, strict=True)], pa.int64()), pa.array(made, pa.binary())], ["name", "offset", "bytes"])

    kind = "name string, offset bigint, bytes binary"
    members = held.join(listed.select("name", "at", "offset"), ["name", "at"]).select("name", "offset", "entry", "crc", "size", "body").mapInArrow(headed, kind)
    index = lines.join(files.select("name", "data"), "name").select("name", (F.col("data") + F.col("upto") - F.col("line")).alias("place"), "entry", "crc", "size", "offset").mapInArrow(listing, kind)
    last = kept(files.select("name", "n_items", "data", "directory").mapInArrow(ending, kind))
    sizes = files.join(last.select("name", (F.col("offset") + F.octet_length("bytes")).alias("size")), "name").select("name", "n_items", "size")
    done = _assemble(members.unionByName(index).unionByName(last), sizes, folder)
    for table in (held, placed, lines, files, last):
        gone(table)
    return done
