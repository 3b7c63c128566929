"""Operator 3: language identification, multinomial naive Bayes over hashed character n-grams.

Counts of every training row are summed per partition in numpy and then by Spark; the
log-probability matrix (languages x 2**BITS) is broadcast. A batch of documents is one sparse matrix
of (document, n-gram) cells, multiplied with it language by language. Defined results: `und` with
score 0 where the text is null or has no letter (Unicode category L), or where nothing could be
learned; rows with a null doc_id are predicted and aren't held out; ties go to the first language in
code-point order; extra columns are ignored. The driver holds a row of 2**BITS counts a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

BITS = 14
ORDERS = (1, 2, 3)
ALPHA = 0.1
_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])
#: The number of n-grams that would reach into another row.
_NONE = 1 << BITS
#: Every ASCII character but the letters counts as a space.
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def _letters(cp: np.ndarray) -> np.ndarray:
    out = _LETTER[np.minimum(cp, 0xFFFF)]
    for i in np.flatnonzero(cp > 0xFFFF):
        out[i] = chr(cp[i]).isalpha()
    return out


def ngram_slices(arr: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Of rows with a letter: their numbers, where each begins (then the end), and for each order the
    hashed n-gram at every character, _NONE where it would reach beyond its row."""
    for i, j, data, off in tv.byte_slices(pc.utf8_lower(arr)):
        cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
        seen = np.concatenate([[0], np.cumsum(_letters(cp))])
        ok = seen[at[1:]] > seen[at[:-1]]
        if not ok.any():
            continue
        cp = cp[np.repeat(ok, np.diff(at))]
        begins = np.concatenate([[0], np.cumsum(np.diff(at)[ok])])
        cp = np.where(cp < 128, _ASCII[np.minimum(cp, 127)], cp).astype(np.uint64)
        grams = []
        with np.errstate(over="ignore"):
            for n in ORDERS:
                g = np.full(max(0, len(cp) - n + 1), n, np.uint64)
                for k in range(n):
                    g += cp[k : k + len(g)] * tv.salt(10 * n + k)
                out = np.full(len(cp), _NONE, np.int32)
                out[: len(g)] = tv.mix(g) >> np.uint64(64 - BITS)
                for k in range(1, n):
                    out[np.maximum(begins[1:] - k, begins[:-1])] = _NONE
                grams.append(out)
        yield i + np.flatnonzero(ok), begins, grams


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: (lang, n-gram number, occurrences), and documents under number -1."""
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        langs = np.array(b.column(b.schema.get_field_index("lang")).to_pylist(), object)
        for rows, begins, grams in ngram_slices(tv.text_array(b, "text")):
            names, code = np.unique(langs[rows].astype(str), return_inverse=True)
            where = np.repeat(code * (_NONE + 1), np.diff(begins))
            n = sum(np.bincount(where + g, minlength=len(names) * (_NONE + 1)) for g in grams).reshape(len(names), _NONE + 1)
            n[:, _NONE] = np.bincount(code, minlength=len(names))  # documents
            for name, own in zip(names.tolist(), n, strict=True):
                counts[name] = counts.get(name, 0) + own
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == _NONE, -1, at), pa.int32()), pa.array(c[at], pa.int64())], ["lang", "gram", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log priors and the log-probability matrix, from every row of docs with a lang."""
    counted = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(_count, "lang string, gram int, n long")
    got = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # at most languages x (2**BITS + 1) rows
    langs = sorted(got["lang"].unique())
    if not langs:
        return [], np.zeros(0), np.zeros((0, 1 << BITS), np.float32)
    code = got["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy()
    gram, n = got["gram"].to_numpy(), got["n"].to_numpy()
    matrix = np.full((len(langs), 1 << BITS), ALPHA)
    matrix[code[gram >= 0], gram[gram >= 0]] += n[gram >= 0]
    prior = np.ones(len(langs))
    prior[code[gram < 0]] = n[gram < 0]
    return langs, np.log(prior / prior.sum()), np.log(matrix / matrix.sum(1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score): one narrow pass with the broadcast matrix."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, matrix = shared.value
        padded = np.concatenate([matrix, np.zeros((len(langs), 1), matrix.dtype)], 1)  # _NONE adds nothing
        names = np.array(["und", *langs], object)
        for b in batches:
            lang, score = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for rows, begins, grams in ngram_slices(tv.text_array(b, "text")) if langs else ():
                logit = np.stack([prior[k] + sum(np.add.reduceat(padded[k][g], begins[:-1], dtype=np.float64) for g in grams) for k in range(len(langs))], 1)
                best = logit.argmax(1)
                lang[rows] = best + 1
                score[rows] = 1 / np.exp(logit - logit.max(1, keepdims=True)).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[lang], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
