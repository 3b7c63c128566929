"""WARC chunk tables and MPEG audio streams: round trips and damage."""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from flowmill.llm import mpeg_audio as A
from flowmill.llm import queries
from flowmill.llm import warc_chunks as W

from .fixtures import awkward, awkward_rows, empty

PAGES = "page_id long, url string, html string"


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip_in_small_chunks(spark):
    rows = [(5, "http://a", "é" * 1000), (3, "http://b\r\nx", "é" * 1000), (9, None, None), (4, "u", ""), (7, "u", "abc"), (None, "n", "abc"), (8, "v", "abc"), (7, "u", "abc")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as digest", "1 as record_no", "true as last")
    chunks = W.write_records(pages, chunk=64)
    assert chunks.agg(F.max(F.length("data"))).first()[0] < 700
    got = W.read_records(chunks).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = sorted(((p, len((h or "").encode()), sha1(h), "response" if p is None or p == first[h or ""] else "revisit", None if p is None or p == first[h or ""] else first[h or ""]) for p, _, h in rows), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want
    stored = chunks.where("chunk_no > 0 and not last").groupBy("record_no").agg(F.sum(F.length("data")).alias("n")).agg(F.sum("n")).first()[0]
    assert stored == 2000 + 3 * 3  # one copy of each payload; rows of page 7 and without an id are responses
    assert W.read_records(W.write_records(spark.createDataFrame([], PAGES))).count() == 0


def warc(data: bytes) -> list[tuple[dict, bytes]]:
    """An independent reader: records of concatenated WARC bytes as (fields, block)."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        n = int(fields["Content-Length"])
        assert version == "WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        data = rest[n + 4 :]
    return out


def test_warc_blocks_are_records(spark):
    chunks = W.write_records(spark.createDataFrame([(1, "http://a/", "x" * 10)], PAGES), chunk=4).orderBy("chunk_no").collect()
    assert [r["last"] for r in chunks] == [False, False, False, False, True]
    assert [r["crc"] for r in chunks[1:4]] == [zlib.crc32(b"x" * n) for n in (4, 8, 10)]
    ((fields, block),) = warc(b"".join(bytes(r["data"]) for r in chunks))
    assert fields["WARC-Type"] == "response" and block.endswith(b"\r\n\r\nxxxxxxxxxx")


def test_archive_bytes_are_valid_warc(spark):
    rows = [(5, "http://a", "é" * 300), (3, "http://b", "é" * 300), (9, None, None), (7, "u", "abc\r\n\r\nWARC/1.1"), (None, "n", "abc"), (None, "n", "abc"), (7, "u", "abc\r\n\r\nWARC/1.1")]
    chunks = W.write_records(spark.createDataFrame(rows, PAGES), chunk=50).orderBy("record_no", "chunk_no").collect()
    records = warc(b"".join(bytes(r["data"]) for r in chunks))
    assert len(records) == len(rows) and len({f["WARC-Record-ID"] for f, _ in records}) == len(rows)
    assert all({"WARC-Type", "WARC-Date", "WARC-Record-ID", "WARC-Payload-Digest"} <= f.keys() for f, _ in records)
    for fields, block in records:
        payload = block.partition(b"\r\n\r\n")[2]
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            assert payload == b"" and (fields["Page-ID"], fields["Refers-To-Page"]) == ("5", "3")


def test_warc_damage_is_noticed(spark):
    chunks = W.write_records(spark.createDataFrame([(1, "u", "abcdefgh"), (2, "u", "12345678")], PAGES), chunk=4)
    bad = chunks.withColumn("data", F.when((F.col("chunk_no") == 2) & (F.col("data") == F.lit(b"efgh")), F.lit(b"efgX")).otherwise(F.col("data")))
    assert {r.page_id: r.intact for r in W.read_records(bad).collect()} == {1: False, 2: True}


def payload(text):
    raw = (text or "").encode()
    return raw + bytes(64 - len(raw) if len(raw) < 64 else -len(raw) % 64)


def test_media_columns_match_brute_force(spark):
    rows = A.probe(A.store(awkward(spark))).collect()
    texts = {r[0]: r[1] for r in awkward_rows() if r[0] is not None}
    assert len(rows) == 13
    for r in rows:
        if r.doc_id is None:
            continue
        p, raw = payload(texts[r.doc_id]), (texts[r.doc_id] or "").encode()
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.duration_s == len(r.seek_offsets) * 1152 / 48000
    by = {r.doc_id: r for r in rows}
    assert by[0].media_sha256 == by[1].media_sha256 and by[6].feature == by[7].feature
    assert A.probe(A.store(empty(spark))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 64, 384, 896, 897, 10_000, 100_000])
def test_streams_hold_every_byte(n):
    data = bytes((i * 7 + 255 * (i % 5 == 0)) & 0xFF for i in range(n))
    p = data + bytes(64 - n if n < 64 else -n % 64)
    media = A.encode(p, n)
    s = A.decode(media)
    assert bytes(s.payload) == p and s.bad_crc == 0 and s.skipped == 0 and int(s.tags["payload_bytes"]) == n
    assert s.table[0] == len(s.offsets) and s.table[1] == s.offsets[-1] - s.offsets[0] + A.parse_header(media[s.offsets[-1] : s.offsets[-1] + 4]).size + 192
    assert all(media[o] == 0xFF for o in s.offsets) and len(s.table[2]) == 100


def test_reader_resynchronises_and_checks():
    p = bytes(range(256)) * 28
    media = bytearray(A.encode(p, len(p)))
    offsets = A.decode(bytes(media)).offsets
    lost = bytes(media[: offsets[2]] + b"\xff\xfbjunk" * 3 + media[offsets[2] :])
    s = A.decode(lost)
    assert s.skipped == 18 and bytes(s.payload) == p and s.offsets[2] == offsets[2] + 18
    media[offsets[1] + 10] ^= 1  # inside the side information
    assert A.decode(bytes(media)).bad_crc == 1
    media[offsets[3]] = 0  # a header is gone: its frame is skipped, the rest follows
    s = A.decode(bytes(media))
    assert len(s.offsets) == len(offsets) - 1 and s.skipped == 960
    assert A.decode(b"").samples == 0 and A.decode(b"no audio at all").skipped == 15


def test_header_table_knows_other_layers():
    layer1 = A.parse_header(bytes([0xFF, 0xFF, 0x14, 0x00]))  # MPEG-1 Layer I, 32 kbit/s, 48 kHz
    assert (layer1.layer, layer1.samples, layer1.size) == (1, 384, 32)
    mpeg2 = A.parse_header(bytes([0xFF, 0xF3, 0x84, 0xC0]))  # MPEG-2 Layer III, 64 kbit/s, 24 kHz
    assert (mpeg2.samples, mpeg2.size, mpeg2.side_info) == (576, 192, 9)
    assert A.parse_header(b"\xff\xfb\xf0\x00") is None and A.parse_header(b"\xff\xe8\x90\x00") is None
    assert A.crc16(b"") == 0xFFFF and struct.unpack(">H", A._frame_head(320)[4:6])[0] == A.crc16(A._frame_head(320)[2:4] + bytes(17))


def test_registered_media_queries(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op5_mpeg_audio(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(len(r.seek_offsets) == round(r.duration_s * 48000 / 1152) and r.seek_offsets == sorted(r.seek_offsets) for r in rows)
    assert all(r.payload_sha256 == hashlib.sha256(payload(docs[r.doc_id])).hexdigest() for r in rows)
