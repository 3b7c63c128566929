"""Operator 1: fuzzy line deduplication.

Lines (split at line feeds) are normalised (lower case, runs of anything but letters and digits
become one space); their shingles are five characters in a row, so that one changed character leaves
lines of 49 characters and more alike. One-permutation MinHash signatures with rotation densification
are banded (14 bands of 6 registers: 0.986 recall at similarity 0.8 in theory, 0.976 measured on edited
lines of 50 to 70 characters with a similarity of 0.8 to 0.9), bucket members are compared with pivots
and verified by exact Jaccard (components.py), and distributed union-find leaves one line of each
component: the first by (doc_id, line number).

A line is known by a 64-bit hash of its normal form; equal forms are one node. Defined results: a
line without letter or digit is kept and has no class; a shorter line than a shingle is one
shingle; null and empty texts have one empty line; rows with a null doc_id come last in the order;
of repeated rows, and of rows without doc_id, one line of a class is kept like of any others, in an
order of rows that is fixed within a run; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import columns_of, fresh, materialize, small_side
from .components import bucket_rows, link_buckets
from .near_dedup import band_keys

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 6
REGISTERS = BANDS * ROWS
_SLICE = 1 << 18
#: Members of a hot bucket that a block of the exact comparison holds.
BLOCK = 1024
#: Bytes of line pairs that are verified at once.
_PAIR_BYTES = 1 << 21
#: Line keys up to which they are broadcast to find their texts (a long each); beyond it the texts shuffle.
PAIR_KEYS = 1_000_000
#: Distinct keys that a task remembers.
_SEEN = 1 << 20
_EMPTY = np.uint32(0xFFFFFFFF)
#: A random value for each character of the basic plane; others add their plane's.
_CHAR = tv.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(7))


def line_table(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: row and number of each line, then the normalised bytes and line offsets,
    and whether the line has any."""
    n = len(off) - 1
    feeds = np.flatnonzero(data == 10)
    rows = np.concatenate([np.arange(n), np.searchsorted(off, feeds, "right") - 1])
    begins = np.concatenate([off[:-1], feeds + 1])
    order = np.lexsort((begins, rows))
    rows, begins = rows[order], begins[order]
    number = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    bounds = np.append(begins, len(data))
    inside = tv.ALNUM[data]
    s, e, line = tv.runs(inside, bounds)
    n_words = np.bincount(line, minlength=len(rows))
    sizes = np.bincount(line, weights=e - s, minlength=len(rows)).astype(np.int64) + np.maximum(n_words - 1, 0)
    between = np.zeros(len(data), bool)
    between[e[np.flatnonzero(line[1:] == line[:-1])] if len(line) else []] = True  # one separator after each word but a line's last
    flat = np.where(between, np.uint8(32), data)[inside | between]
    return rows, number, flat, np.concatenate([[0], np.cumsum(sizes)]), n_words > 0


def char_shingles(flat: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k characters in a row of each line, and their lines."""
    if len(flat) and flat.max() >= 128:
        cp = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])[at]
        value = _CHAR[cp & 0xFFFF]
        if len(cp) and cp.max() >> 16:
            value = value + (cp >> 16).astype(np.uint64) * tv.salt(400)
    else:
        value = _CHAR[flat]
    n = len(value)
    pw, inv = tv._power_tables(n + 1)
    lens = np.diff(at)
    line = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    # whole shingles everywhere but at the last k - 1 characters of a line; a short line's first character stands for it
    keep = np.ones(n, bool)
    tail = at[1:, None] - np.arange(1, k)[None, :]
    keep[tail[tail >= at[:-1, None]]] = False
    keep[at[:-1][lens > 0]] = True
    with np.errstate(over="ignore"):
        pre = np.zeros(n + k, np.uint64)
        np.cumsum(value * pw[:n], out=pre[1 : n + 1])
        pre[n + 1 :] = pre[n]
        h = (pre[k:] - pre[:n]) * inv[:n]
        short = np.flatnonzero((lens > 0) & (lens < k))
        h[at[:-1][short]] = (pre[at[1:][short]] - pre[at[:-1][short]]) * inv[at[:-1][short]]
    return tv.scatter(h[keep]), line[keep]


def signatures(h: np.ndarray, line: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """One-permutation MinHash; an empty register takes the next full one's value plus its distance."""
    sig = np.full(n * m, _EMPTY, np.uint32)
    register = ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, line * m + register, h.astype(np.uint32))  # the low half; a value like _EMPTY's is no loss
    sig = sig.reshape(n, m)
    twice = np.concatenate([sig, sig], 1)
    where = np.where(twice == _EMPTY, 4 * m, np.arange(2 * m))
    nxt = np.minimum.accumulate(where[:, ::-1], 1)[:, ::-1][:, :m]
    gap = nxt - np.arange(m)
    with np.errstate(over="ignore"):
        return np.take_along_axis(twice, nxt % (2 * m), 1).astype(np.uint64) + gap.astype(np.uint64) * tv.salt(401)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, doc_id, line_no, key, norm): the last only where the task meets a key for the first time."""
    seen: set[int] = set()
    for b in batches:
        for i, j, data, off in tv.byte_slices(pc.utf8_lower(tv.text_array(b, "text")), _SLICE):
            rows, number, flat, at, full = line_table(data, off)
            key = np.zeros(len(rows), np.uint64)
            key[full] = tv.span_hashes(flat, at[:-1][full], at[1:][full])
            fresh = np.zeros(len(rows), bool)
            for k, x in enumerate(key.tolist()):
                if x not in seen and full[k]:
                    seen.add(x)
                    fresh[k] = True
            if len(seen) > _SEEN:
                seen.clear()  # a key may then come twice, which only costs rows
            norm = flat[np.repeat(fresh, np.diff(at))]
            begins = np.concatenate([[0], np.cumsum(np.where(fresh, np.diff(at), 0))])
            norms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(begins), pa.py_buffer(norm)])
            norms = pc.if_else(pa.array(fresh), norms, None).cast(pa.binary())
            uid, ids = (b.column(k).slice(i, j - i).take(pa.array(rows)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([uid, ids, pa.array(number, pa.int32()), pa.array(tv.signed(key), pa.int64(), mask=~full), norms], ["uid", "doc_id", "line_no", "key", "norm"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id, pivot) of the bands of lines (key, norm)."""
    for b in batches:
        keys = []
        for i, j, data, off in tv.byte_slices(b.column(1).cast(pa.large_binary()), _SLICE):
            h, line = char_shingles(data, off)
            keys.append(band_keys(signatures(h, line, j - i), BANDS, ROWS))
        if keys:
            yield bucket_rows(np.concatenate(keys).ravel(), np.repeat(b.column(0).to_numpy(), BANDS))


def _sets(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, None]]:
    """(first row, end row, distinct shingles, their number a row, no weights) of normal forms, slice by slice."""
    for i, j, data, off in tv.byte_slices(col.cast(pa.large_binary())):
        h, line, _ = tv.unique_counts(*char_shingles(data, off))
        yield i, j, h, np.bincount(line, minlength=j - i), None


def _pair_sets(col: pa.Array) -> np.ndarray:
    """Distinct (row, shingle) keys of normal forms, sorted: 20 bits of row, 44 of the shingle's hash."""
    out = [np.zeros(0, np.uint64)]
    for i, _, data, off in tv.byte_slices(col.cast(pa.large_binary())):
        h, line = char_shingles(data, off)
        out.append(tv.distinct((line.astype(np.uint64) + np.uint64(i)) << np.uint64(44) | h >> np.uint64(20)))
    return np.concatenate(out)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, norm_a, norm_b) whose exact Jaccard similarity reaches the threshold."""
    for b in batches:
        size = np.cumsum(pc.add(pc.binary_length(b.column(2)), pc.binary_length(b.column(3))).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _PAIR_BYTES, "right")))
            part, at = b.slice(at, end - at), end
            x, y = _pair_sets(part.column(2)), _pair_sets(part.column(3))
            both = np.sort(np.concatenate([x, y]), kind="stable")
            rows = lambda k: np.bincount((k >> np.uint64(44)).astype(np.int64), minlength=part.num_rows)  # noqa: B023, E731
            common = rows(both[1:][both[1:] == both[:-1]])
            ok = pa.array(common >= THRESHOLD * (rows(x) + rows(y) - common))
            yield pa.RecordBatch.from_arrays([part.column(k).filter(ok) for k in (0, 1)], ["a", "b"])


def _classes(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, line_no, class_doc_id, class_line_no, keep) of every line of rows (uid, doc_id, text)."""
    found = materialize(docs.mapInArrow(_lines, "uid long, doc_id long, line_no int, key long, norm binary"), "lines")
    forms = found.where("norm is not null").select("key", "norm")

    def texts(ids: DataFrame) -> DataFrame:
        own = forms.join(small_side(ids.withColumnRenamed("id", "key"), PAIR_KEYS), "key", "left_semi")
        return own.dropDuplicates(["key"]).select(F.col("key").alias("id"), F.col("norm").alias("text"))

    comps = link_buckets(forms.mapInArrow(_buckets, "bucket long, id long, pivot long"), _verify, texts, _sets, THRESHOLD, block=BLOCK)
    worded = found.where("key is not null").select("uid", "doc_id", "line_no", "key")
    lines = worded.join(small_side(comps), F.col("key") == F.col("id"), "left").select("uid", "doc_id", "line_no", F.coalesce("component", "key").alias("node"))
    lines = materialize(lines, "line-nodes")
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("d"), F.col("line_no").alias("l"), F.col("uid").alias("u"))
    firsts = lines.groupBy("node").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts.select("node", F.col("f.d").alias("_d"), F.col("f.l").alias("_l"), F.col("f.u").alias("_u")), "line-classes")
    out = lines.join(small_side(firsts), "node", "left")
    own = lambda group, row: F.when(F.col("_u").isNotNull(), F.col(group)).otherwise(F.col(row))
    keep = F.col("_u").isNull() | ((F.col("uid") == F.col("_u")) & (F.col("line_no") == F.col("_l")))
    out = out.select("uid", "doc_id", "line_no", own("_d", "doc_id").alias("class_doc_id"), own("_l", "line_no").alias("class_line_no"), keep.alias("keep"))
    blank = found.where("key is null").select("uid", "doc_id", "line_no", F.lit(None).cast("long").alias("class_doc_id"), F.lit(None).cast("int").alias("class_line_no"), F.lit(True).alias("keep"))
    return out.unionByName(blank)


def line_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, class_doc_id, class_line_no, keep) of every line; the class is its first line."""
    return _classes(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")).drop("uid")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the removed lines taken out of their texts (all columns kept); of repeated rows each
    has its own decisions, so the rows are numbered and written first."""
    uid, gone = fresh(docs, "_uid", "_gone")
    numbered = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    lost = _classes(numbered.select(F.col(uid).alias("uid"), "doc_id", "text")).where("not keep")
    per_row = materialize(lost.groupBy(F.col("uid").alias(uid)).agg(F.collect_set("line_no").alias(gone)), "removed-lines")
    joined = numbered.join(small_side(per_row), uid, "left")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    rest = F.filter(lines, lambda s: ~F.array_contains(gone, s["i"]))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(rest, lambda s: s["x"]), "\n"))
    return joined.withColumn("text", text).select(*columns_of(docs))
