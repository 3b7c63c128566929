"""Operator 5: MPEG audio columns.

A payload of bytes is stored losslessly in an MPEG-1 Layer III stream (48 kHz, mono): after an
ID3v2 tag and a frame with the variable-bitrate table come frames whose side information is empty
(they decode to silence) and whose ancillary area carries as many whole 64-byte units as it has room
for, so the last frames have lower bitrates. Every frame has its CRC-16; an ID3v1 tag ends the stream.

The reader follows MPEG-1, -2 and -2.5 streams of all three layers with stated bitrates (no free
format): it parses ID3 tags and a Xing or Info table (no VBRI), follows frame headers, resynchronises
where one is damaged (a candidate counts if another header, or the end, follows its frame), verifies
the checksums of Layer III frames (those of Layers I and II cover other bits and are passed over) and
yields the exact duration, frame by frame at each one's sample rate, and the byte offset of every frame.

Defined results: null and empty texts are one unit of zeros; equal texts have equal media; a stream
without a frame has duration 0; extra columns and repeated rows change nothing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv
from .common import materialize

UNIT = 64
# Fixed values of the MPEG audio standard: kbit/s by (version 1 or 2, layer), Hz by version.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_CRC_POLY = 0x8005


@dataclass(frozen=True)
class Header:
    version: int  # the two bits: 3 is MPEG-1, 2 MPEG-2, 0 MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    sample_rate: int
    mono: bool
    size: int
    samples: int

    @property
    def kind(self) -> tuple:
        """What frames of one stream have in common."""
        return self.version, self.layer, self.protected, self.sample_rate, self.mono

    @property
    def side_info(self) -> int:
        """Bytes of Layer III side information."""
        return 0 if self.layer != 3 else (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(4096)
def parse_header(word: bytes) -> Header | None:
    """The frame header in four bytes; None if it isn't one (free format isn't supported)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate, hz = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    kbps, hertz, pad = BITRATES[1 if version == 3 else 2, layer][rate], SAMPLE_RATES[version][hz], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    return Header(version, layer, not word[1] & 1, kbps, hertz, word[3] >> 6 == 3, size, samples)


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1 ^ _CRC_POLY if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(4096)
def crc16(protected: bytes) -> int:
    """The frame checksum over the last two header bytes and the side information."""
    c = 0xFFFF
    for b in protected:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


def _frame_head(kbps: int, protected: bool = True) -> bytes:
    """Header, checksum and empty side information of a 48 kHz mono Layer III frame."""
    head = bytes([0xFF, 0xFA | (not protected), BITRATES[1, 3].index(kbps) << 4 | 1 << 2, 0xC0])
    return head + (struct.pack(">H", crc16(head[2:] + bytes(17))) if protected else b"") + bytes(17)


def capacity(h: Header) -> int:
    """Payload bytes that the layout above puts into a frame."""
    return (h.size - 4 - 2 * h.protected - h.side_info) // UNIT * UNIT


#: (capacity, frame head, frame size), largest first; of equal capacities the smallest frame.
_KINDS = sorted({capacity(h): (capacity(h), head, h.size) for k in reversed(BITRATES[1, 3][1:]) for head in [_frame_head(k)] for h in [parse_header(head[:4])]}.values(), reverse=True)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The stream that stores a payload, a positive multiple of UNIT; n_bytes of it are content."""
    frames, at = [], 0
    while at < len(payload):
        room, head, size = next(k for k in _KINDS if k[0] <= len(payload) - at)
        frames.append(head + payload[at : at + room] + bytes(size - len(head) - room))
        at += room
    ends = np.cumsum([len(f) for f in frames])
    table_head = _frame_head(64, protected=False)
    table_size = parse_header(table_head[:4]).size
    total = int(ends[-1]) + table_size
    begins = np.concatenate([[0], ends[:-1]]) + table_size
    toc = bytes(int(x) for x in np.minimum(255, 256 * begins[np.arange(100) * len(frames) // 100] // total))
    table = table_head + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    text = b"\0payload_bytes\0" + str(n_bytes).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    return b"".join([b"ID3\x03\x00\x00", _synchsafe(len(tag)), tag, table, bytes(table_size - len(table)), *frames, b"TAG" + bytes(124) + b"\xff"])


@dataclass
class Stream:
    """What a stream holds."""

    tags: dict[str, str] = field(default_factory=dict)
    table: tuple[int, int, bytes] | None = None  # frames, bytes, seek points
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    sample_rate: int = 0
    seconds: Fraction = Fraction(0)
    bad_crc: int = 0
    skipped: int = 0
    payload: bytearray = field(default_factory=bytearray)
    frame_kinds: dict[int, int] = field(default_factory=dict)


def _id3v2(buf: memoryview, out: Stream) -> int:
    """Parse a leading ID3v2 tag; its length."""
    if bytes(buf[:3]) != b"ID3" or len(buf) < 10:
        return 0
    size = buf[6] << 21 | buf[7] << 14 | buf[8] << 7 | buf[9]
    at, end = 10, min(len(buf), 10 + size)
    while at + 10 <= end and buf[at]:
        name = bytes(buf[at : at + 4]).decode("latin-1")
        n = struct.unpack(">I", buf[at + 4 : at + 8])[0] if buf[3] < 4 else buf[at + 4] << 21 | buf[at + 5] << 14 | buf[at + 6] << 7 | buf[at + 7]
        text = bytes(buf[at + 11 : min(end, at + 10 + n)]).decode("latin-1")
        if name == "TXXX" and "\0" in text:
            name, _, text = text.partition("\0")
        out.tags[name] = text.strip("\0")
        at += 10 + n
    return end


def decode(data: bytes) -> Stream:
    """Parse a whole stream."""
    buf, out = memoryview(data), Stream()
    at, end = _id3v2(buf, out), len(buf)
    if end - at >= 128 and bytes(buf[end - 128 : end - 125]) == b"TAG":
        out.tags["id3v1_genre"] = str(buf[end - 1])
        end -= 128
    first, like, at_rate = True, None, {}
    while at + 4 <= end:
        h = parse_header(bytes(buf[at : at + 4]))
        # right after a frame a header of its kind is believed; else another one, or the end, must follow
        if h is None or at + h.size > end or h.kind != like and at + h.size + 4 <= end and parse_header(bytes(buf[at + h.size : at + h.size + 4])) is None:
            like = None
            nxt = data.find(b"\xff", at + 1, end)  # not in sync here: on to the next candidate
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        body = at + 4 + 2 * h.protected
        side = bytes(buf[body : body + h.side_info])
        mark = body + h.side_info
        if first and bytes(buf[mark : mark + 4]) in (b"Xing", b"Info"):
            flags = struct.unpack(">I", buf[mark + 4 : mark + 8])[0]
            fields, p = [0, 0], mark + 8
            for bit in (0, 1):
                if flags >> bit & 1:
                    fields[bit], p = struct.unpack(">I", buf[p : p + 4])[0], p + 4
            out.table = (fields[0], fields[1], bytes(buf[p : p + 100]) if flags & 4 else b"")
        else:
            if h.protected and h.layer == 3 and crc16(bytes(buf[at + 2 : at + 4]) + side) != buf[at + 4] << 8 | buf[at + 5]:
                out.bad_crc += 1
            out.offsets.append(at)
            out.samples += h.samples
            out.sample_rate = h.sample_rate
            at_rate[h.sample_rate] = at_rate.get(h.sample_rate, 0) + h.samples
            out.frame_kinds[h.kbps] = out.frame_kinds.get(h.kbps, 0) + 1
            out.payload += buf[mark : mark + capacity(h)]
        first, like = False, h.kind
        at += h.size
    out.skipped += max(0, end - at)
    out.seconds = sum((Fraction(n, hz) for hz, n in at_rate.items()), Fraction(0))
    return out


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, off in tv.byte_slices(tv.text_array(b, "text")):
            raw, media = data.tobytes(), []
            for k in range(j - i):
                n = int(off[k + 1] - off[k])
                media.append(encode(raw[off[k] : off[k + 1]] + bytes(UNIT - n if n < UNIT else -n % UNIT), n))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(media, pa.binary())], ["doc_id", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the texts' streams, written to the shared folder and read again."""
    return materialize(docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, media binary"), "media")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part, out = b.slice(at, 256), []
            for value in part.column(1):
                media = value.as_py() or b""
                s = decode(media)
                payload = bytes(s.payload)
                offsets = np.array(s.offsets, np.int64)
                kinds = ",".join(f"{k}:{n}" for k, n in sorted(s.frame_kinds.items()))
                seek_ok = s.table is not None and s.table[0] == len(s.offsets)
                feature = f"frames={len(s.offsets)};kbps={kinds};samples={s.samples};hz={s.sample_rate};bad_crc={s.bad_crc};skipped={s.skipped};table={int(seek_ok)};seek={zlib.crc32(offsets.tobytes()):08x}"
                out.append((int(s.tags.get("payload_bytes", 0) or 0), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), float(s.seconds), s.offsets, feature))
            kinds_ = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "duration_s", "seek_offsets", "feature"])


def probe(media: DataFrame) -> DataFrame:
    """One row a stream (doc_id, media): sizes, digests, exact duration, frame seek offsets, feature."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, duration_s double, seek_offsets array<long>, feature string"
    return media.select("doc_id", "media").mapInArrow(_probe, schema)
