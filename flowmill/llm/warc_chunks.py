"""Operator 4: WARC records as a chunked table.

A record is a run of rows (record_no, chunk_no, data, crc, sha1, last): chunk 0 is the WARC header block
with the HTTP header, the payload follows in chunks of at most CHUNK bytes, each with the running
CRC-32 of the payload up to its end; the payload's last chunk also carries the running SHA-1, and a
last row holds the two line ends that close a record. The concatenated data of a record, and of
records one after another, are WARC 1.1 bytes. A page's html comes as one cell of its table; from
there writer and reader hold one chunk at a time, never a second copy of a record.

Record ids are unique: they hold the page's id and the record's number; the fields Page-ID and
Refers-To-Page carry page ids alone. Pages have no time of capture, so WARC-Date is a parameter.
Of records with equal payloads of at least `min_revisit` bytes that with the smallest page_id is the
response and the others are revisit records, which keep the HTTP header but not the payload.
Defined results: a null html is an empty payload; rows with a null page_id can't be referred to and
are responses; repeated rows of the smallest page_id are all responses; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side

CHUNK = 1 << 20
MIN_REVISIT = 0
SCHEMA = "record_no long, chunk_no int, data binary, crc long, sha1 binary, last boolean"
_NAMES = ["record_no", "chunk_no", "data", "crc", "sha1", "last"]
_READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of chunk data that go into one Arrow batch.
_BATCH_BYTES = 8 << 20


DATE = "1970-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def _header(number: int, page_id, url: str, digest: str, n_bytes: int, first, date: str) -> bytes:
    """The WARC header block and the HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{number}>", f"WARC-Date: {date}"]
    lines += ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    lines += [f"Page-ID: {page_id}"] if page_id is not None else []
    lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To-Date: {date}", f"Refers-To-Page: {first}"] if first is not None else []
    lines.append(f"Content-Length: {len(http) + (n_bytes if first is None else 0)}")
    return "\r\n".join(lines).encode() + _END + http


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int, date: str) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)

    for b in batches:
        number, page, url, payload, digest, first = (b.column(k) for k in range(6))
        for k in range(b.num_rows):
            body = memoryview(payload[k].as_buffer())
            n = len(body)
            sha_hex = digest[k].as_py()
            head = _header(number[k].as_py(), page[k].as_py(), url[k].as_py(), base64.b32encode(bytes.fromhex(sha_hex)).decode(), n, first[k].as_py(), date)
            stored = n if first[k].as_py() is None else 0
            crc, sha = 0, hashlib.sha1()
            rows.append((number[k].as_py(), 0, head, 0, None if stored else sha.digest(), False))
            c = 0
            for c, at in enumerate(range(0, stored, chunk), 1):
                piece = body[at : at + chunk]
                crc = zlib.crc32(piece, crc)
                sha.update(piece)
                end = at + chunk >= stored
                rows.append((number[k].as_py(), c, bytes(piece), crc, sha.digest() if end else None, False))
                held += len(piece)
                if held >= _BATCH_BYTES:
                    yield out()
                    rows, held = [], 0
            rows.append((number[k].as_py(), c + 1, _END, crc, None, True))
            held += len(head)
    if rows:
        yield out()


def _field(block: bytes, name: bytes) -> str | None:
    at = block.find(b"\r\n" + name + b": ")
    return None if at < 0 else block[at + len(name) + 4 : block.index(b"\r\n", at + 2)].decode()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in (record_no, chunk_no) order to one row a record; a record may span batches."""
    state = None
    for b in batches:
        out = []
        for no, c, data, crc, sha1, last in zip(*(b.column(k) for k in range(6)), strict=True):
            body = memoryview(data.as_buffer())
            if c.as_py() == 0:
                block, _, http = bytes(body).partition(_END)
                state = {"no": no.as_py(), "block": b"\r\n" + block + b"\r\n", "http": b"\r\n" + http, "head": len(http), "n": 0, "next": 1, "crc": 0, "sha": hashlib.sha1(), "told": sha1.as_py(), "ok": True}
                continue
            if not last.as_py():
                state["sha"].update(body)
                state["crc"] = zlib.crc32(body, state["crc"])
                state["n"] += len(body)
                state["told"] = sha1.as_py()
            state["ok"] &= state["no"] == no.as_py() and state["next"] == c.as_py() and state["crc"] == crc.as_py()
            state["next"] += 1
            if last.as_py():
                block, sha = state["block"], state["sha"].digest()
                kind, page, refers = _field(block, b"WARC-Type"), _field(block, b"Page-ID"), _field(block, b"Refers-To-Page")
                told = _field(block, b"WARC-Payload-Digest").removeprefix("sha1:")
                full = int(_field(state["http"], b"Content-Length"))
                ok = state["ok"] and sha == state["told"] and bytes(body) == _END and int(_field(block, b"Content-Length")) == state["head"] + state["n"]
                if kind == "response":
                    told_ok, digest, size = told == base64.b32encode(sha).decode() and full == state["n"], base64.b32encode(sha).decode(), state["n"]
                else:
                    told_ok, digest, size = True, told, full
                out.append((int(page) if page else None, _field(block, b"WARC-Target-URI"), size, digest, kind, int(refers) if refers else None, ok and told_ok))
        if out:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])


def write_records(pages: DataFrame, chunk: int = CHUNK, min_revisit: int = MIN_REVISIT, date: str = DATE) -> DataFrame:
    """The chunk table of pages (page_id, url, html), written to the shared folder."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url" if "url" in pages.columns else F.lit(None).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # copies meet by digest and length, without their payloads
    known = rows.select("digest", F.octet_length("payload").alias("n_bytes"), "page_id").where(F.col("n_bytes") >= min_revisit)
    first = known.groupBy("digest", "n_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    rows = rows.join(small_side(materialize(first, "payload-copies")), "digest", "left")
    refers = F.when(F.col("page_id") != F.col("first_id"), F.col("first_id"))
    rows = rows.select(F.monotonically_increasing_id().alias("record_no"), "page_id", "url", "payload", "digest", refers.alias("refers_to"))
    return materialize(rows.mapInArrow(lambda it: _chunks(it, chunk, date), SCHEMA), "warc-chunks")


def read_records(chunks: DataFrame) -> DataFrame:
    """One row a record, read from the chunk table: chunks stream through in order."""
    ordered = chunks.repartition("record_no").sortWithinPartitions("record_no", "chunk_no")
    return ordered.mapInArrow(_read, _READ_SCHEMA)
