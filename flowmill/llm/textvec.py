"""Vectorised tokenisation of Arrow text columns: numpy over the raw UTF-8 bytes, no Python strings.

All hashes are 64-bit. A word's hash is a polynomial over per-byte random values, finalised by an
avalanche mix; at n distinct words the chance of any collision is about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the numpy scratch memory (a longer single text goes alone).
SLICE_BYTES = 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_WRAP = {"over": "ignore"}


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche mix of uint64 values."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(**_WRAP):
        x ^= x >> np.uint64(32)
        x *= _BASE
        x ^= x >> np.uint64(29)
        x *= _GOLDEN
        x ^= x >> np.uint64(32)
    return x


def scatter(x: np.ndarray) -> np.ndarray:
    """A cheaper mix for values that already depend on all their input in the high bits."""
    with np.errstate(**_WRAP):
        x = x ^ (x >> np.uint64(32))
        x *= _GOLDEN
        x ^= x >> np.uint64(29)
        return x


def salt(n: int) -> np.uint64:
    """The n-th of a fixed sequence of odd multipliers."""
    return mix(np.array([n + 1], np.uint64) * _GOLDEN)[0] | np.uint64(1)


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BASE_INV)):
            t = np.full(max(n, SLICE_BYTES + 1), b, np.uint64)
            t[0] = 1
            _powers[k] = np.cumprod(t, dtype=np.uint64)
    return _powers[0], _powers[1]


def byte_class(keep) -> np.ndarray:
    """256 booleans: keep(code) for ASCII codes, True for every byte of a longer UTF-8 sequence."""
    return np.array([keep(c) if c < 128 else True for c in range(256)])


#: Letters, digits and everything beyond ASCII: words without their punctuation.
ALNUM = byte_class(lambda c: chr(c).isalnum())
#: Everything but the space and the control characters 9 to 13.
NON_SPACE = byte_class(lambda c: not (c == 0x20 or 9 <= c <= 13))
#: Lower-cases A to Z only.
ASCII_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def as_text(col: pa.Array) -> pa.Array:
    """A string column with 64-bit offsets, nulls as empty texts."""
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return pc.fill_null(col, "")


def text_array(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named text column, nulls as empty texts."""
    return as_text(batch.column(batch.schema.get_field_index(name)))


def byte_slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most `limit` bytes, or one row."""
    n = len(arr)
    if not n:
        return
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes in `table`, never across rows."""
    return runs(table[data], off)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of True, never across rows."""
    data = inside
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, ~inside[:-1]
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, ~inside[1:]
    edge = off[1:-1]
    first[edge[edge < len(data)]] = True
    last[edge[edge > 0] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    pw, inv = _power_tables(len(data) + 1)
    with np.errstate(**_WRAP):
        pre = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * pw[: len(data)], out=pre[1:])
        return mix((pre[ends] - pre[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k items in a row and their rows; a row with fewer items has one shingle of them all."""
    if not len(h):
        return h, row
    with np.errstate(**_WRAP):
        n = len(h)
        out = np.zeros(n, np.uint64)
        whole = np.ones(n, bool)
        for j in range(k):
            same = np.zeros(n, bool)
            same[: n - j] = row[j:] == row[: n - j] if j else True
            part = np.zeros(n, np.uint64)
            part[: n - j] = h[j:] * salt(j)
            out += np.where(same, part, np.uint64(0))
            whole &= same
        begins = np.ones(n, bool)
        begins[1:] = row[1:] != row[:-1]
    keep = whole | begins
    return mix(out[keep]), row[keep]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (numpy's own takes a hash table, many times slower than this sort)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def unique_counts(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs ordered by row, and how often each occurs. At most 2**20 rows."""
    if not len(h):
        return h, row, np.zeros(0, np.int64)
    order = np.argsort(row.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long."""
    return x.view(np.int64)


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of consecutive runs of values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))
