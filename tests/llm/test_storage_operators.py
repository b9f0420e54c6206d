"""WARC, Ogg and sharding: exact round trips and brute force."""

import base64
import collections
import gzip
import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfold.llm import ogg, sharding, warc

PAGES = "page_id long, url string, html string"


def expected_records(pages, least=0):
    keeper = {}
    for i, _, h in pages:
        b = (h or "").encode()
        keeper[b] = max((x for x in (i, keeper.get(b)) if x is not None), default=None)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        revisit = len(b) >= least and keeper[b] is not None and i != keeper[b]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", keeper[b] if revisit else None))
    return sorted(out, key=repr)


def some_pages(n=300):
    r = random.Random(7)
    bodies = [None, "", "é" * 10, "\r\n\r\n", "WARC/1.1\r\n\r\nfake", "x" * 100_000, *(f"<p>{r.random()}</p>\r\n\r\n" * r.randrange(1, 200) for _ in range(120))]
    return [(i, r.choice([f"http://e.com/{i}", None, "http://e.com/a b\r\nX: y", "é"]), r.choice(bodies)) for i in range(n)]


@pytest.mark.parametrize(("least", "archive_bytes"), [(0, 1 << 24), (0, 5000), (40, 200_000)])
def test_warc_round_trip(spark, least, archive_bytes):
    pages = some_pages()
    out = warc.archive_and_read(spark.createDataFrame(pages, PAGES).repartition(3), least_bytes=least, archive_bytes=archive_bytes)
    rows = out.collect()
    got = [(int(x.record), x.size, x.digest, x.kind, None if x.refers_to is None else int(x.refers_to)) for x in rows]
    assert sorted(got, key=repr) == expected_records(pages, least)
    texts = {i: (h or "").encode() for i, _, h in pages}
    assert all(bytes(x.payload) == texts[int(x.record)] for x in rows if x.kind == "response")


def test_warc_edge_cases(spark):
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0
    rows = warc.archive_and_read(spark.createDataFrame([(None, None, "a"), (None, None, "b"), (4, "u", "a"), (4, "u", "a"), (9, "u", None)], PAGES).withColumn("size", F.lit("clash"))).collect()
    assert sorted((x.record, x.kind, x.refers_to) for x in rows) == [("4", "response", None), ("4", "response", None), ("9", "response", None), ("None", "response", None), ("None", "revisit", "4")]


def test_warc_members_are_read_by_seeking(spark, tmp_path):
    """Files that gzip reads as a whole, an index table beside them, and single records taken by offset with no Spark at all."""
    pages = [*some_pages(80), (7, "u", "same id"), (77, "http://x/:y", "colon:id")]
    records = warc.archive_records(spark.createDataFrame(pages, PAGES).repartition(3))
    written = warc.write_archives(records, f"{tmp_path}/mono", 30_000).collect()
    assert len(written) > 3 and {w.archive: w.n_bytes for w in written} == {p.name: p.stat().st_size for p in (tmp_path / "mono").iterdir()}
    warc.normalise_archives(spark.createDataFrame(written), f"{tmp_path}/mono", f"{tmp_path}/new").write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    rows = index.collect()
    assert len(rows) == len(pages)
    whole = sorted(b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "mono").iterdir()))
    assert sorted(b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "new").iterdir())) == whole
    for e in rows[::7]:
        with open(tmp_path / "new" / e.archive, "rb") as f:
            f.seek(e.offset)
            head, _, rest = gzip.decompress(f.read(e.length)).partition(b"\r\n\r\n")
        headers = warc.headers_of(head)
        assert headers["warc-record-id"] == e.record and headers["warc-type"] == e.kind
        http, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and (e.kind == "response" or not payload)
    # A filtered index reads those records only, and ids tell records apart unless page and payload agree.
    one = warc.read_archives(index.where("record LIKE '<urn:page:7:%'"), f"{tmp_path}/new").collect()
    assert {x.record for x in one} == {"7"} and len(one) == 2
    assert len({e.record for e in rows}) == len(rows)


def test_warc_ids_of_any_text(spark):
    ids = ["a:b", "c d>", "é/ü", "%41", "<urn:page:x>"]
    pages = spark.createDataFrame([(i, None, h) for i in ids for h in ("same", f"own {i}")], "page_id string, url string, html string")
    rows = warc.archive_and_read(pages, keep_monolithic=True).collect()
    assert {x.record for x in rows} == set(ids) and {x.refers_to for x in rows if x.kind == "revisit"} == {max(ids)}


def test_warc_large_records_come_in_small_pieces():
    """A record in thousands of pieces is put together in linear time, whatever the pieces."""
    payload = random.Random(1).randbytes(40_000_000)
    body = warc.record("response", "1", None, "D", payload, len(payload), None) * 2
    out = list(warc.records_in(body[i : i + 4096] for i in range(0, len(body), 4096)))
    assert [w for _, w in out] == [body[: len(body) // 2]] * 2
    tiny = warc.record("response", "1", None, "D", b"\r\n\r\nx", 5, None)
    assert [w for _, w in warc.records_in(tiny[i : i + 1] for i in range(len(tiny)))] == [tiny]


def test_normalise_takes_one_stream_or_many_members():
    records = [warc.record("response", str(i), f"http://e/{i}", "D", (b"x" * i + b"\r\n\r\n") * 3, 3 * (i + 4), None) for i in range(50)]
    for body in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records[:20])) + gzip.compress(b"".join(records[20:]))):
        made, index = warc.normalise(body)
        assert [gzip.decompress(made[e["offset"] : e["offset"] + e["length"]]) for e in index] == records
        assert gzip.decompress(made) == b"".join(records)
    with pytest.raises(ValueError, match="cut short|inside"):
        warc.normalise(gzip.compress(b"".join(records))[:-20])
    with pytest.raises(ValueError, match="inside"):
        warc.normalise(gzip.compress(b"".join(records)[:-3]))
    assert warc.normalise(gzip.compress(b"")) == (b"", [])


def slow_checksum(data):
    """The page checksum bit by bit, from its definition."""
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_page_checksum(data):
    assert ogg.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 3839, 3840, 3841, 7680, 66_000, 400_000])
def test_ogg_round_trip(n):
    text = bytes(random.Random(n).randrange(256) for _ in range(min(n, 5000))) * (n // 5000 + 1)
    text = text[:n]
    payload = ogg.padded(text)
    assert payload.startswith(text)
    assert len(payload) % 192 == 0 < len(payload)
    back, said = ogg.demux(ogg.mux(payload))
    assert back == payload
    assert said["streams"] == 2
    assert said["microseconds"] == len(payload) * 125
    assert said["starts"] == [i * 125 for i in range(0, len(payload), ogg.PACKET)]


def test_ogg_packets_over_pages_and_shared_pages():
    big, small = bytes(range(256)) * 600, [b"a" * n for n in (0, 1, 254, 255, 256, 510)]
    one, two = ogg.Stream(1), ogg.Stream(2)
    data = b"".join([*one.page([b"head"], 0, ogg.FIRST), *two.page([b"h2"], 0, ogg.FIRST), *one.page([big], 100), *two.page(small, 7), *one.page([b""], 200, ogg.LAST)])
    found = list(ogg.packets(data))
    assert [p for s, _, p in found if s == 1] == [b"head", big, b""]
    assert [p for s, _, p in found if s == 2] == [b"h2", *small]
    assert [g for s, g, _ in found if s == 1] == [0, 100, 200]
    assert [g for s, g, _ in found if s == 2] == [0, None, None, None, None, None, 7]


def test_ogg_damage_is_found():
    data = ogg.mux(ogg.padded(b"some text " * 2000))
    for at in (3, 30, len(data) // 2, len(data) - 1):
        with pytest.raises(ogg.DamagedOgg):
            ogg.demux(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ogg.DamagedOgg):
        ogg.demux(data[:-5])
    pages = data.split(b"OggS")[1:]
    with pytest.raises(ogg.DamagedOgg):
        ogg.demux(b"".join(b"OggS" + p for n, p in enumerate(pages) if n != 3))
    assert struct.unpack_from("<I", data, 22)[0] == slow_checksum(data[:22] + b"\0\0\0\0" + data[26 : data.index(b"OggS", 4)])


def test_ogg_columns(spark):
    docs = spark.createDataFrame([(1, "text é"), (2, None), (None, ""), (3, "long " * 40_000), (4, "text é")], "doc_id long, text string").withColumn("media", F.lit("clash"))
    rows = ogg.media_features(ogg.with_media(docs)).collect()
    texts = {1: "text é", 2: "", None: "", 3: "long " * 40_000, 4: "text é"}
    for x in rows:
        b = texts[x.doc_id].encode()
        p = b + b" " * (192 - len(b) % 192 if len(b) % 192 or not b else 0)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    by = {x.doc_id: x for x in rows}
    assert by[1][1:] == by[4][1:]
    assert by[2][1:] == by[None][1:]
    assert ogg.media_features(ogg.with_media(docs.limit(0))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 7, 40, 41, 100, 997, 5000])
def test_feistel_is_a_permutation(n):
    f = sharding.Feistel(n, seed=n)
    assert sorted(f.at(i) for i in range(n)) == list(range(n))
    assert f.a * f.b >= n


def test_feistel_of_many_rows_is_in_range():
    f = sharding.Feistel(10**11, seed=1)
    assert len({f.at(i * 999_983) for i in range(2000)}) == 2000
    assert all(0 <= f.at(10**11 - 1 - i) < 10**11 for i in range(100))


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_brute_force(spark, shards):
    r = random.Random(9)
    docs = [(i * 3, r.choice([None, "", "é" * r.randrange(50), "text"])) for i in r.sample(range(2000), 700)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sharding.shard(frame, shards).collect()
    f = sharding.Feistel(len(docs))
    for n, (i, t) in enumerate(sorted(docs, key=lambda d: d[0])):
        p, b = f.at(n), (t or "").encode()
        docs[n] = (i, len(b) + 16, zlib.crc32(b), p % shards, p // shards)
    assert sorted((x.doc_id, x.size, x.text_crc32, x.shard, x.slot) for x in rows) == docs
    again = sharding.shard(frame.repartition(5, "text"), shards).collect()
    assert sorted((x.doc_id, x.shard, x.slot) for x in rows) == sorted((x.doc_id, x.shard, x.slot) for x in again)


def test_shards_edge_cases(spark):
    schema = "doc_id long, text string"
    assert sharding.shard(spark.createDataFrame([], schema), 40).count() == 0
    rows = sharding.shard(spark.createDataFrame([(None, "a"), (5, None), *[(5, "b")] * 30, (None, None)], schema).withColumn("shard", F.lit("clash")), 4).collect()
    counts = collections.Counter(x.shard for x in rows)
    assert sorted(counts.values()) == [8, 8, 8, 9]
    for s in counts:
        assert sorted(x.slot for x in rows if x.shard == s) == list(range(counts[s]))


def test_sharding_stays_in_the_jvm(spark):
    plan = sharding.shard(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 4)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
