"""WARC archives: a writer, a normaliser for monolithic gzip streams, and a reader by offset index.

The writer packs a whole archive into one gzip stream. The normaliser inflates such a stream once,
rewrites every record as a gzip member of its own, and gives a sidecar index of the members. Archives
are ``.warc.gz`` files in the shared folder that any WARC tool reads; the index is a table beside
them, a row a record, and a reader takes single members from a file by it, without the rest.

Files are written in pieces and get their name when they are whole. A name has the number of the
attempt that wrote it and only a task that ends well hands its names on, so a lost executor's archives
are written again and what it left is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, lean, pinned, released, shared_dir

#: Bytes of records that an archive holds before the next is begun, and of members that a reader takes at once.
ARCHIVE_BYTES, READ_BYTES = 128 << 20, 4 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES, INDEX = "archive string, n_bytes bigint", "archive string, record string, kind string, offset bigint, length bigint"
#: Tasks over which archives are dealt at most.
MOST_TASKS = 20_000
_RECORD_ID = re.compile(r"<urn:page:([^:]*):[^:]*(?::revisit)?>")


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder as Spark names it, and the folder's path in it."""
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: str, digest: str, kind: str = "response") -> str:
    """A name of the record: of the page and what it holds, so pages that share an id and not the content differ."""
    return f"<urn:page:{quote(page, safe='')}:{digest}{':revisit' if kind == 'revisit' else ''}>"


def record(kind: str, page: str, url: str | None, digest: str, payload: bytes, size: int, refers_to: str | None) -> bytes:
    """The bytes of a record: an HTTP response; a revisit has only that response's head, which says the size of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{quote(page, safe='')}"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, digest, kind)}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to or '', digest)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:]) if k}


def records_in(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, bytes of the whole record) from a stream of uncompressed bytes, read once; one record is held at a time."""
    held, headers, searched, need = bytearray(), {}, 0, 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                end = held.find(b"\r\n\r\n", searched)
                if end < 0:
                    searched = max(0, len(held) - 3)
                    break
                headers = headers_of(bytes(held[:end]))
                need = end + 4 + int(headers["content-length"]) + 4
            if len(held) < need:
                break
            yield headers, bytes(held[:need])
            del held[:need]
            searched = need = 0
    if held:
        raise ValueError("the archive ends inside a record")


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content of one or more gzip members that come in pieces."""
    engine = None
    for piece in pieces:
        while piece:
            engine = engine or zlib.decompressobj(31)
            yield engine.decompress(piece, 1 << 20)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, 1 << 20)
            piece = engine.unused_data
            if engine.eof:
                engine = None
    if engine is not None:
        raise ValueError("the gzip stream is cut short")


def members(pieces: Iterator[bytes], level: int = 6) -> Iterator[tuple[dict, bytes]]:
    """(index entry, gzip member) of each record of an archive: record, kind, offset, length."""
    at = 0
    for headers, whole in records_in(inflated(pieces)):
        member = gzip.compress(whole, level, mtime=0)
        yield {"record": headers["warc-record-id"], "kind": headers["warc-type"], "offset": at, "length": len(member)}, member
        at += len(member)


def normalise(body: bytes, level: int = 6) -> tuple[bytes, list[dict]]:
    """``members`` of an archive that is in memory: the new archive, and its index."""
    made = list(members(iter([body]), level))
    return b"".join(member for _, member in made), [entry for entry, _ in made]


class _File:
    """A file that gets its name when it is closed."""

    def __init__(self, folder: str, name: str):
        self.store, at = file_system(folder)
        self.store.create_dir(at, recursive=True)
        self.path, self.size = f"{at}/{name}", 0
        self.out = self.store.open_output_stream(f"{at}/.{name}.part", compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        folder, _, name = self.path.rpartition("/")
        self.store.move(f"{folder}/.{name}.part", self.path)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Writes rows (page, url, sha1, payload, size, kind, refers_to) as monolithic archives in ``folder``; archive (its name), n_bytes of each when the result is computed.

    A null payload counts as empty, a null url is written as the page's name, and a null page as ``None``. Rows alike in page and
    payload give records of one name. Without rows there is no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, n, file, size = TaskContext.get(), 0, None, 0

        def closed() -> pa.RecordBatch:
            file.write(engine.flush())
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([file.path.rpartition("/")[2]]), pa.array([file.size], pa.int64())], ["archive", "n_bytes"])

        for batch in batches:
            for row in batch.to_pylist():
                if file is None:
                    file, size, engine = _File(folder, f"part-{context.partitionId():06d}-{context.taskAttemptId():08d}-{n:06d}.warc.gz"), 0, zlib.compressobj(level, zlib.DEFLATED, 31)
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                whole = record(row["kind"], str(row["page"]), row["url"], digest, row["payload"] or b"", row["size"], None if row["refers_to"] is None else str(row["refers_to"]))
                file.write(engine.compress(whole))
                size += len(whole)
                if size >= archive_bytes:
                    yield closed()
                    n, file = n + 1, None
        if file is not None:
            yield closed()

    return records.mapInArrow(lean(run), ARCHIVES)


def normalise_archives(archives: DataFrame, folder: str, to: str, level: int = 6) -> DataFrame:
    """Rewrites each of archives (archive, ...) in ``folder`` with a member per record in ``to``; the index, a row a record, when the result is computed.

    Archives are inflated as they are read, one record being held at a time. An archive that is cut short raises an error; an empty
    one gives no row. Null names are left out, and an archive that is named twice is rewritten twice and read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        store, at = file_system(folder)
        for batch in batches:
            for k, name in enumerate(batch.column(0).to_pylist()):
                new = f"{name.removesuffix('.warc.gz')}-{attempt:08d}-{k}.warc.gz"
                file, held = _File(to, new), []
                with store.open_input_stream(f"{at}/{name}", compression=None) as read:
                    for entry, member in members(iter(lambda read=read: read.read(1 << 18), b""), level):
                        file.write(member)
                        held.append({"archive": new} | entry)
                        if len(held) == 2000:
                            yield pa.RecordBatch.from_pylist(held, INDEX_SCHEMA)
                            held = []
                file.close()
                if held:
                    yield pa.RecordBatch.from_pylist(held, INDEX_SCHEMA)

    return archives.select("archive").where("archive IS NOT NULL").mapInArrow(lean(run), INDEX)


INDEX_SCHEMA = pa.schema([("archive", pa.string()), ("record", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def members_at(store: fs.FileSystem, folder: str, entries: list[dict]) -> Iterator[bytes]:
    """The content of members by their index entries; those that follow each other in a file are read at once, up to ``READ_BYTES``."""
    at, name, file = 0, None, None
    while at < len(entries):
        first, end = entries[at], at + 1
        while end < len(entries) and entries[end]["archive"] == first["archive"] and entries[end]["offset"] == entries[end - 1]["offset"] + entries[end - 1]["length"] and entries[end]["offset"] + entries[end]["length"] - first["offset"] <= READ_BYTES:
            end += 1
        if first["archive"] != name:
            if file is not None:
                file.close()
            name = first["archive"]
            file = store.open_input_file(f"{folder}/{name}")
        held = file.read_at(entries[end - 1]["offset"] + entries[end - 1]["length"] - first["offset"], first["offset"])
        for e in entries[at:end]:
            yield gzip.decompress(held[e["offset"] - first["offset"] : e["offset"] - first["offset"] + e["length"]])
        at = end
    if file is not None:
        file.close()


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """A row per row of index, each read from its own member of an archive in ``folder``: record, kind, payload, size, digest, refers_to, url.

    ``index`` may be filtered or repeated; only the members that it names are read. ``record`` and ``refers_to`` are ids of pages as
    text. The digest of a response is computed from what was read and has to be the one that the record says.
    """
    names = ["record", "kind", "url", "payload", "size", "digest", "refers_to"]
    schema = "record string, kind string, url string, payload binary, size bigint, digest string, refers_to string"
    kinds = [pa.string()] * 3 + [pa.binary(), pa.int64(), pa.string(), pa.string()]

    def parsed(whole: bytes) -> tuple:
        head, _, rest = whole.partition(b"\r\n\r\n")
        headers = headers_of(head)
        http, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
        said, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers_of(http)["content-length"])
        full = headers["warc-type"] == "response"
        if full and (base32_sha1(payload) != said or len(payload) != size):
            raise ValueError(f"{headers['warc-record-id']}: the payload isn't the one that was written")
        page = lambda x: unquote(_RECORD_ID.fullmatch(x)[1])
        refers = headers.get("warc-refers-to")
        return page(headers["warc-record-id"]), headers["warc-type"], headers["warc-target-uri"], payload if full else None, size, said, page(refers) if refers else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = file_system(folder)
        for batch in batches:
            out, held = [], 0
            for whole in members_at(store, at, batch.to_pylist()):
                out.append(parsed(whole))
                held += len(whole)
                if held >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return index.select("archive", "offset", "length").mapInArrow(lean(run), schema)


def archive_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, broadcast_groups: int = 500_000) -> DataFrame:
    """What ``write_archives`` takes, a row per row of pages.

    Of payloads that are equal and have at least ``least_bytes`` bytes, that of the largest id is a
    response and the others revisit it; smaller ones are all responses. Null html counts as empty; a
    null id is the smallest, and rows that repeat the largest id are all responses. Only groups of
    two or more take part in the join: as a broadcast up to ``broadcast_groups`` of them, else
    shuffled by digest, where Spark can split a hot one.
    """
    payload = F.coalesce(pages[html_col], F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].alias("page"), pages[url_col].cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"))
    groups = pinned(rows.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.max("page").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = rows.join(bounded(groups, broadcast_groups), ["sha1", "size"], "left")
    revisits = F.col("keeper").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper"))
    return joined.select("page", "url", "sha1", F.when(~revisits, F.col("payload")).alias("payload"), "size", F.when(revisits, "revisit").otherwise("response").alias("kind"), F.when(revisits, F.col("keeper")).alias("refers_to"))


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, keep_monolithic: bool = False) -> DataFrame:
    """Writes pages as monolithic archives, normalises them, and returns ``read_archives`` of the result.

    All is in the shared folder, under a name of this call: ``normalised`` (archives), ``index`` (a table), and ``monolithic``, which is
    deleted when the normalised ones are whole unless ``keep_monolithic``.
    """
    spark = pages.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written = pinned(write_archives(archive_records(pages, id_col, url_col, html_col, least_bytes), f"{at}/monolithic", archive_bytes))
    # An archive a task, so that each is normalised by itself.
    each = written.repartition(max(1, min(written.count(), MOST_TASKS)))
    normalise_archives(each, f"{at}/monolithic", f"{at}/normalised").write.parquet(f"{at}/index")
    released(written)
    if not keep_monolithic:
        store, path = file_system(f"{at}/monolithic")
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)
    return read_archives(spark.read.schema(INDEX).parquet(f"{at}/index"), f"{at}/normalised")
