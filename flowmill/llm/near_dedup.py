"""Operator 7: near-duplicate documents by ProbMinHash over weighted word shingles.

Shingles: five words in a row (lower case, letters and digits); their weights grow with the
logarithm of how often the document repeats them. Every shingle is a Poisson process of arrivals with
its weight as rate; an arrival falls into a random register and the earliest arrival of each
register is kept. A shingle stops as soon as its next arrival is later than every register's. Two
documents agree in a register with the probability Jaccard similarity of their weighted shingles.
Registers are banded; the members of a band's bucket are compared with its pivots (components.py)
and a pair is linked if its exact probability Jaccard, or the plain Jaccard of its shingle sets, is
at least THRESHOLD.

Defined results: equal texts are one class before anything else; a text with fewer than five words
has one shingle of them all; texts without a word, and null texts, are alone in their class unless
(not null, not empty) equal; rows with a null doc_id have a null class and link nothing; repeated rows
share one class; rows with one doc_id and different texts have the classes of their texts; extra
columns are ignored. A class is named by its smallest doc_id. A text is known by 64 bits of its md5:
at n distinct ones the chance of any collision is about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import columns_of, fresh, materialize, small_side
from .components import bucket_rows, link_buckets

SHINGLE = 5
THRESHOLD = 0.8
#: 24 bands of 6 registers find a pair of similarity 0.8 with probability 0.9993.
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS


def weighted_shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, text number and weight, in text order."""
    s, e, row = tv.words(data, off, tv.ALNUM)
    h, r, n = tv.unique_counts(*tv.shingles(tv.span_hashes(data, s, e), row, SHINGLE))
    return h, r, 1.0 + np.log(n)


def prob_minhash(h: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures (n_rows x m) of texts given as weighted elements; element arrivals stop early."""
    earliest = np.full(n_rows * m, np.inf)
    winner = np.zeros(n_rows * m, np.uint64)
    t = np.zeros(len(h))
    live = np.arange(len(h))
    step = 0
    while len(live):
        # few live elements: draw several arrivals of each at once; the surplus can't win a register
        burst = int(np.clip(8192 // len(live), 1, 64))
        with np.errstate(over="ignore"):
            draw = tv.mix(h[live, None] + np.arange(step + 1, step + burst + 1, dtype=np.uint64)[None, :] * tv.salt(90))
            u = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            register = ((tv.mix(draw + tv.salt(91)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        when = t[live, None] + np.cumsum(-np.log(u), 1) / weight[live, None]
        at = (row[live, None] * m + register).ravel()
        flat, who = when.ravel(), np.repeat(h[live], burst)
        better = flat < earliest[at]
        at, flat, who = at[better], flat[better], who[better]
        late_first = np.argsort(-flat, kind="stable")
        earliest[at[late_first]] = flat[late_first]  # of several, the last written: the earliest
        winner[at[late_first]] = who[late_first]
        t[live] = when[:, -1]
        latest = earliest.reshape(n_rows, m).max(1)
        live = live[t[live] < latest[row[live]]]
        step += burst
    return winner.reshape(n_rows, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket for each band of each signature. A band's registers lie far apart: registers
    that a sparse signature filled from one neighbour don't make up a band."""
    out = np.zeros((len(sig), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            out += sig[:, k * bands : (k + 1) * bands] * tv.salt(200 + k)
        return tv.mix(out + np.arange(1, bands + 1, dtype=np.uint64) * tv.salt(300))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, off in tv.byte_slices(pc.utf8_lower(tv.text_array(b, "text"))):
            h, row, w = weighted_shingles(data, off)
            has = np.bincount(row, minlength=j - i) > 0
            keys = band_keys(prob_minhash(h, row, w, j - i))[has]
            lens = np.where(has, BANDS, 0)
            part = b.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), tv.list_column(tv.signed(keys.ravel()), lens, pa.int64())], ["doc_id", "node", "bands"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id, pivot) of rows (node, bands)."""
    for b in batches:
        bands = b.column(1)
        yield bucket_rows(bands.flatten().to_numpy().view(np.uint64), np.repeat(b.column(0).to_numpy(), bands.value_lengths().to_numpy()))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the exact probability Jaccard and the plain Jaccard of two weighted sets (distinct hashes, weights)."""
    common, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    union = len(a[0]) + len(b[0]) - len(common)
    va, vb = a[1][ia], b[1][ib]
    # sum over d' of max(v_d'/v_d, w_d'/w_d) splits at the ratio v/w of d
    ratio = va / vb
    order = np.argsort(ratio)
    va, vb, ratio = va[order], vb[order], ratio[order]
    from_a = np.append(np.cumsum(va[::-1])[::-1], 0.0)
    from_b = np.concatenate([[0.0], np.cumsum(vb)])
    k = np.searchsorted(ratio, ratio, "left")
    rest_a, rest_b = a[1].sum() - va.sum(), b[1].sum() - vb.sum()
    prob = (1.0 / ((from_a[k] + rest_a) / va + (from_b[k] + rest_b) / vb)).sum()
    return max(float(prob), len(common) / union)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sets(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for i, j, data, off in tv.byte_slices(pc.utf8_lower(col)):
            h, row, w = weighted_shingles(data, off)
            cut = np.searchsorted(row, np.arange(j - i + 1))
            out += [(h[cut[k] : cut[k + 1]], w[cut[k] : cut[k + 1]]) for k in range(j - i)]
        return out

    for b in batches:
        for at in range(0, b.num_rows, 128):
            part = b.slice(at, 128)
            ta, tb = sets(tv.text_array(part, "text_a")), sets(tv.text_array(part, "text_b"))
            ok = np.array([similarity(x, y) >= THRESHOLD for x, y in zip(ta, tb, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(ok)) for k in (0, 1)], ["a", "b"])


def _sets(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingles, their number a row, weights) of whole texts, slice by slice."""
    for i, j, data, off in tv.byte_slices(pc.utf8_lower(tv.as_text(col))):
        h, row, w = weighted_shingles(data, off)
        yield i, j, h, np.bincount(row, minlength=j - i), w


def _nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, component) of every row. node names the text, null for null and empty ones, which
    never meet another in a bucket; component names the texts linked to it (null without doc_id)."""
    named = docs.select("doc_id", node_of(F.col("text")).alias("node"), "text")
    found = materialize(named.mapInArrow(_bands, "doc_id long, node long, bands array<long>"), "signatures")
    # one row a text; all bands of a text are equal
    reps = found.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("bands").alias("bands"))
    members = reps.where(F.size("bands") > 0).select("node", "bands").mapInArrow(_buckets, "bucket long, id long, pivot long")

    def texts(ids: DataFrame) -> DataFrame:
        whole = docs.select(node_of(F.col("text")).alias("id"), "text")
        return whole.join(small_side(ids), "id", "left_semi").dropDuplicates(["id"])

    comps = link_buckets(members, _verify, texts, _sets, THRESHOLD, similarity)
    out = found.select("doc_id", "node").join(small_side(comps.withColumnRenamed("id", "node")), "node", "left")
    return out.select("doc_id", "node", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component"))


def node_of(text: Column) -> Column:
    """64 bits of a text's md5 as a long; null for null and empty texts."""
    return F.when(text != "", F.expr("cast(conv(left(md5(text), 15), 16, 10) as long)"))


def _winners(rows: DataFrame) -> DataFrame:
    """(component, class_id, first_node): the smallest doc_id of each component with several rows, and the smallest text of that id."""
    least = rows.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("w"), F.count("*").alias("n"))
    return least.where("n > 1").select("component", F.col("w.doc_id").alias("class_id"), F.col("w.node").alias("first_node"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row."""
    rows = materialize(_nodes(docs), "text-classes")
    named = rows.join(small_side(materialize(_winners(rows), "class-names")), "component", "left")
    return named.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class (that with the smallest doc_id, of its texts that with the smallest
    fingerprint), with all its columns. Rows with a null doc_id stay; so do null and empty texts, of
    which one row a doc_id stays."""
    rows = materialize(_nodes(docs), "text-classes")
    named = rows.where("doc_id is not null").join(small_side(materialize(_winners(rows), "class-names")), "component", "left")
    first = F.coalesce((F.col("doc_id") == F.col("class_id")) & (F.col("node") == F.col("first_node")), F.lit(True))
    doc, node, stays, n = fresh(docs, "_doc", "_node", "_stays", "_n")
    known = named.withColumn(stays, first).groupBy(F.col("doc_id").alias(doc), F.col("node").alias(node)).agg(F.min(stays).alias(stays), F.count("*").alias(n))
    odd = small_side(materialize(known.where(~F.col(stays) | (F.col(n) > 1)).withColumn(node, F.coalesce(node, F.lit(-1))), "removed"))
    own = F.coalesce(node_of(F.col("text")), F.lit(-1))
    joined = docs.join(odd, (docs["doc_id"] == odd[doc]) & (own == odd[node]), "left")
    single = joined.where(F.col(stays).isNull()).select(*columns_of(docs))
    repeated = joined.where(F.col(stays)).dropDuplicates([doc, node]).select(*columns_of(docs))
    return single.unionByName(repeated)
