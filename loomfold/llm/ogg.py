"""Ogg media columns: payloads as 8-bit PCM in two multiplexed logical streams, and a reader for any Ogg bytes.

The reader verifies page checksums, puts packets together from lacing values, separates logical
streams by serial number, and takes timestamps from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, lean, texts_of

#: Fixed values of the container: page flags, and the header of a PCM stream (8-bit unsigned, one channel).
CONTINUED, FIRST, LAST = 1, 2, 4
PCM_MAGIC, RATE, FRAME = b"PCM     ", 8000, 192
PACKET = 20 * FRAME
SERIALS = (0x11, 0x22)

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_NO_GRANULE = (1 << 64) - 1


def page_checksum(page: bytes) -> int:
    """The CRC of a page whose checksum field is zero: polynomial 0x04c11db7, unreflected, from 0.

    zlib has the same polynomial reflected, so bits are reversed on the way in and out.
    """
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(n: int) -> bytes:
    """Lacing values of a packet of n bytes."""
    return b"\xff" * (n // 255) + bytes([n % 255])


class Stream:
    """Writes the pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0

    def page(self, packets: list[bytes], granule: int, flags: int = 0) -> Iterator[bytes]:
        """The packets on as few pages as hold them; a packet that crosses pages is continued."""
        laces, body = b"".join(lacing(len(p)) for p in packets), b"".join(packets)
        at = 0
        for i in range(0, len(laces), 255):
            part = laces[i : i + 255]
            ends = any(x < 255 for x in part)
            last = i + 255 >= len(laces)
            kind = (CONTINUED if i and laces[i - 1] == 255 else 0) | (flags & FIRST if not i else 0) | (flags & LAST if last else 0)
            head = struct.pack("<4sBBQIIIB", b"OggS", 0, kind, (granule if last else _NO_GRANULE if not ends else granule), self.serial, self.sequence, 0, len(part)) + part
            page = head + body[at : at + sum(part)]
            at += sum(part)
            self.sequence += 1
            yield page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def pcm_header() -> bytes:
    """Version 0.0, unsigned 8-bit format, sample rate, 8 significant bits, one channel."""
    return PCM_MAGIC + struct.pack(">HHIIBBHI", 0, 0, 1, RATE, 8, 1, 0, 0)


def mux(payload: bytes) -> bytes:
    """An Ogg file of payload as samples, dealt in packets to two streams in turn.

    A packet's granule position is the number of samples of the whole payload up to its end.
    """
    streams = [Stream(s) for s in SERIALS]
    out = [p for s in streams for p in s.page([pcm_header()], 0, FIRST)]
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    end = 0
    for k, packet in enumerate(packets):
        end += len(packet)
        out += streams[k % 2].page([packet], end, LAST if k >= len(packets) - 2 else 0)
    if len(packets) < 2:
        out += streams[1].page([b""], 0, LAST)
    return b"".join(out)


class DamagedOgg(ValueError):
    """The bytes are no whole Ogg pages, or a checksum, sequence or continuation is wrong."""


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, list[int], bytes]]:
    """(flags, granule, serial, sequence, lacing values, body) of each page, checked."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"OggS\0" or len(data) < at + 27:
            raise DamagedOgg(f"no page at {at}")
        flags, granule, serial, sequence, crc, n = struct.unpack_from("<BQIIIB", data, at + 5)
        laces = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(laces)
        if len(laces) < n or end > len(data):
            raise DamagedOgg(f"the page at {at} is cut short")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise DamagedOgg(f"the checksum of the page at {at} is wrong")
        yield flags, granule, serial, sequence, list(laces), data[at + 27 + n : end]
        at = end


def packets(data: bytes) -> Iterator[tuple[int, int | None, bytes]]:
    """(serial, granule, packet) of each packet of each logical stream, in the order in which they end.

    A page's granule position belongs to the last packet that ends on it; others have none.
    """
    open_: dict[int, bytearray] = {}
    expected: dict[int, int] = {}
    for flags, granule, serial, sequence, laces, body in pages(data):
        if bool(flags & FIRST) == (serial in expected) or sequence != expected.get(serial, sequence):
            raise DamagedOgg(f"stream {serial} has page {sequence} out of turn")
        expected[serial] = sequence + 1
        held = open_.pop(serial, None)
        if bool(flags & CONTINUED) != (held is not None):
            raise DamagedOgg(f"stream {serial}, page {sequence}: a packet is broken off")
        held, at = held or bytearray(), 0
        last = max((i for i, x in enumerate(laces) if x < 255), default=-1)
        unfinished = False
        for i, x in enumerate(laces):
            held += body[at : at + x]
            at += x
            unfinished = x == 255
            if not unfinished:
                yield serial, (granule if i == last and granule != _NO_GRANULE else None), bytes(held)
                held = bytearray()
        if unfinished:
            open_[serial] = held
    if open_:
        raise DamagedOgg("a packet has no end")


def demux(data: bytes) -> tuple[bytes, dict]:
    """The payload of ``mux`` and what the container says: streams, packets, pages' seconds.

    Packets of all PCM streams are put in the order of their granule positions.
    """
    rates: dict[int, int] = {}
    timed = []
    for serial, granule, packet in packets(data):
        if serial not in rates:
            if packet[:8] != PCM_MAGIC:
                raise DamagedOgg(f"stream {serial} isn't PCM")
            rates[serial] = struct.unpack_from(">I", packet, 16)[0]
        elif packet:
            timed.append((granule, packet))
    timed.sort(key=lambda x: x[0])
    payload = b"".join(p for _, p in timed)
    rate = next(iter(rates.values()), RATE)
    if timed and timed[-1][0] != len(payload):
        raise DamagedOgg("granule positions and samples disagree")
    return payload, {"streams": len(rates), "packets": len(timed), "rate": rate, "microseconds": 1_000_000 * len(payload) // rate, "starts": [(g - len(p)) * 1_000_000 // rate for g, p in timed]}


def padded(text: bytes) -> bytes:
    """text and spaces up to a positive multiple of the frame."""
    return text + b" " * (-len(text) % FRAME or (0 if text else FRAME))


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, media (an Ogg file of the padded text).

    Null text counts as empty; an empty text is one frame of spaces. Equal texts give equal media.
    """
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], [id_col, "n_bytes", "media"])

    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, n_bytes bigint, media binary")


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``with_media``'s result, with digests of the payload read back, the stored form's size and digest, and a feature string.

    ``feature`` holds streams, packets, duration and start of the last packet in microseconds, and mean and peak of the samples.
    Null media gives null columns; damaged media fails the job, since storage has lost data then.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    rows = media.select(media[id_col].alias("id"), media["n_bytes"].alias("n_bytes"), media["media"].alias("media"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stored in batch.column(2).to_pylist():
                if stored is None:
                    out.append((None,) * 6)
                    continue
                payload, said = demux(stored)
                samples = np.frombuffer(payload, np.uint8)
                feature = f"streams={said['streams']};packets={said['packets']};duration_us={said['microseconds']};last_start_us={said['starts'][-1] if said['starts'] else 0};mean={int(samples.sum()) / max(1, len(samples)):.4f};peak={int(samples.max(initial=0))}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [id_col, "n_bytes", *names])

    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
