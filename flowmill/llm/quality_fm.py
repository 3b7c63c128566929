"""Operator 2: quality classifier, a factorisation machine.

Inputs of a score: hashed words of the whole text, structure statistics and the metadata column
n_chars. Never labels, lang, source or doc_id. The pairwise term uses the identity
sum_{i<j} <v_i,v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2], so a document
costs time linear in its distinct words.

Fitting uses at most MAX_TRAIN_ROWS labelled rows (those whose doc_id hashes below a threshold), the
documented bound; scoring covers every row. Defined results: a null or empty text is scored from
its (empty) statistics; with no usable labels every score is 0.5; rows with a null doc_id are
scored and count as not held out; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import materialize

#: Bound of the labelled sample that the model is fitted on.
MAX_TRAIN_ROWS = 20_000
WORD_BITS = 16
FACTORS = 8
EPOCHS = 8
BATCH = 256
BINS = 16

_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_BLANK = ~tv.NON_SPACE
_SYMBOL = np.array([c < 128 and not (chr(c).isalnum() or c in b" \t\n\r.,;:'\"()-?") for c in range(256)])
_N_STATS = 11


@dataclass(frozen=True)
class Machine:
    """Weights of a factorisation machine over WORD_BITS hashed words and the statistics' bins."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray


def _ratio_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    r = part / np.maximum(whole, 1)
    return np.minimum(BINS - 1, (np.sqrt(np.clip(r, 0, 1)) * BINS).astype(np.int64))


def _log_bin(n: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, np.log2(np.maximum(n, 0) + 1.0).astype(np.int64))


def features(data: np.ndarray, off: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and row starts for the texts in one slice of bytes."""
    n = len(off) - 1
    size = np.diff(off)

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off])

    s, e, row = tv.words(data, off, tv.NON_SPACE)
    h = tv.span_hashes(tv.ASCII_LOWER[data], s, e)
    n_words = np.bincount(row, minlength=n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    uh, urow, tf = tv.unique_counts(h, row)
    distinct = np.bincount(urow, minlength=n)
    letters = per_row(_LETTER[data])
    stats = [
        _ratio_bin(per_row(_UPPER[data]), letters),
        _ratio_bin(letters, size),
        _ratio_bin(per_row(_DIGIT[data]), size),
        _ratio_bin(per_row(_SYMBOL[data]), size),
        _ratio_bin(per_row(_BLANK[data]), size),
        _ratio_bin(per_row(data == 10), n_words),
        _ratio_bin(distinct, n_words),
        _ratio_bin(np.bincount(row, weights=same, minlength=n), n_words),
        np.minimum(BINS - 1, (np.bincount(row, weights=e - s, minlength=n) / np.maximum(n_words, 1)).astype(np.int64)),
        _log_bin(n_words),
        np.where(np.isnan(n_chars), 0, _log_bin(np.nan_to_num(n_chars))),
    ]
    value = np.log1p(tf)
    norm = np.sqrt(np.bincount(urow, weights=value * value, minlength=n))
    words_at = (uh >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    rows = np.concatenate([urow, np.repeat(np.arange(n), _N_STATS)])
    index = np.concatenate([words_at, ((1 << WORD_BITS) + np.arange(_N_STATS) * BINS + np.stack(stats, 1)).ravel()])
    x = np.concatenate([value / np.maximum(norm, 1e-9)[urow], np.ones(n * _N_STATS)]).astype(np.float32)
    order = np.argsort(rows, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return index[order].astype(np.int32), x[order], starts


def raw_scores(m: Machine, index: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The machine's log-odds; every row has at least its statistics' features."""
    at = starts[:-1]
    vx = m.factors[index] * x[:, None]
    sums = np.add.reduceat(vx, at)
    squares = np.add.reduceat(vx * vx, at).sum(1)
    return m.bias + np.add.reduceat(m.linear[index] * x, at) + 0.5 * ((sums * sums).sum(1) - squares)


def fit(index: np.ndarray, x: np.ndarray, starts: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss over mini-batches of the bounded sample."""
    dim = (1 << WORD_BITS) + _N_STATS * BINS
    rng = np.random.default_rng(seed)
    bias, w = 0.0, np.zeros(dim, np.float32)
    v = rng.normal(0, 0.02, (dim, FACTORS)).astype(np.float32)
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Machine(float(np.log(rate / (1 - rate))), w, np.zeros_like(v))
    gw, gv, gb = np.full(dim, 1e-4, np.float32), np.full((dim, FACTORS), 1e-4, np.float32), 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            take = np.sort(order[k : k + BATCH])
            lens = starts[take + 1] - starts[take]
            at = np.concatenate([[0], np.cumsum(lens)])
            pick = np.repeat(starts[take] - at[:-1], lens) + np.arange(at[-1])
            i, xi = index[pick], x[pick]
            vi = v[i]
            vx = vi * xi[:, None]
            sums = np.add.reduceat(vx, at[:-1])
            z = bias + np.add.reduceat(w[i] * xi, at[:-1]) + 0.5 * ((sums * sums).sum(1) - np.add.reduceat(vx * vx, at[:-1]).sum(1))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) / len(take)
            g = np.repeat(err, lens).astype(np.float32) * xi
            own, where = np.unique(i, return_inverse=True)
            dw = np.bincount(where, g, len(own)) + 1e-6 * w[own]
            dv = np.stack([np.bincount(where, g * (np.repeat(sums[:, f], lens) - vx[:, f]), len(own)) for f in range(FACTORS)], 1) + 1e-6 * v[own]
            db = float(err.sum())
            gw[own] += dw * dw
            gv[own] += dv * dv
            gb += db * db
            w[own] -= 0.1 * dw / np.sqrt(gw[own])
            v[own] -= 0.02 * dv / np.sqrt(gv[own])
            bias -= 0.1 * db / gb**0.5
    return Machine(bias, w, v)


def _n_chars(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("n_chars")).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        chars = _n_chars(b)
        for i, j, data, off in tv.byte_slices(tv.text_array(b, "text")):
            index, x, starts = features(data, off, chars[i:j])
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("y")).slice(i, j - i), tv.list_column(index, np.diff(starts), pa.int32()), tv.list_column(x, np.diff(starts), pa.float32())],
                ["y", "i", "x"],
            )


def _with_n_chars(docs: DataFrame, *names: str) -> DataFrame:
    chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select(*names, chars.cast("double").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, held_out, max_rows: int = MAX_TRAIN_ROWS) -> Machine:
    """Fit on at most max_rows rows of labels whose doc_id isn't held out (held_out: doc_id -> Column)."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    usable = materialize(usable, "usable-labels")
    share = max_rows / max(1, usable.count())
    if share < 1:  # a little under the bound; the limit only guards it
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(0.97 * share * (1 << 30)))
    sample = usable.limit(max_rows)
    rows = _with_n_chars(docs.join(F.broadcast(sample), "doc_id"), "y", "text").mapInArrow(_feature_rows, "y double, i array<int>, x array<float>")
    got = rows.toArrow().combine_chunks()
    if not got.num_rows:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0))
    lists = [got.column(k).combine_chunks() for k in ("i", "x")]
    starts = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))])
    return fit(lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), starts, got.column("y").to_numpy())


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score, predicted) of every row: one narrow pass, the model in a broadcast of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*shared.value)
        for b in batches:
            chars = _n_chars(b)
            for i, j, data, off in tv.byte_slices(tv.text_array(b, "text")):
                z = raw_scores(m, *features(data, off, chars[i:j]))
                p = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return _with_n_chars(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents that the machine accepts (score >= 0.5), with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors))

    @F.arrow_udf("boolean")
    def accepted(text: pa.Array, n_chars: pa.Array) -> pa.Array:
        m, out = Machine(*shared.value), np.zeros(len(text), bool)
        chars = n_chars.to_numpy(zero_copy_only=False).astype(np.float64)
        for i, j, data, off in tv.byte_slices(tv.as_text(text)):
            out[i:j] = raw_scores(m, *features(data, off, chars[i:j])) >= 0
        return pa.array(out)

    chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.where(accepted(F.col("text"), chars.cast("double")))
