"""Operator 13: how far the sources of a language differ in their words.

Each (lang, source) and each lang is a column of counts over the lang's kept terms, those in at least
30 of its documents. A count c has the share p = 1 + floor(10^9 (c + 5) / (N + 5 V)), N the column's
sum and V the number of terms. Two columns differ by the sum of |p - q| over all kept terms.

Terms are ordered by their count in the lang, so that terms with equal counts, above all the zeros
and ones of rare terms, lie side by side, and cut into blocks of `BLOCK_TERMS`. In each block a column
is stored as runs of equal counts; two columns are compared by the union of their run starts, and each
stretch between two starts adds |p - q| times its length. Blocks are added up by Spark.

What meets in one task: a block's runs of two tiles of at most about `TILE` sources. Words are counted
in the tasks that read them; no lang, source or term is gathered, and a hot one sends a row a task.

Defined results: a null text, lang or source is ''; texts without terms and groups without kept terms
have columns of zeros, so that they still have pairs (0 if the lang has no kept term); equal texts
count as often as they occur; ids aren't read, extra columns neither; an empty table gives no rows.
Counts and sums are exact to 2^63, shares by whole numbers of any size.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side

MIN_DOCS = 30
TOP_TERMS = 50
UNIT, PRIOR = 1_000_000_000, 5
BLOCK_TERMS = 2048
#: Sources of a tile, about.
TILE = 64
#: Distinct terms that a task holds before it hands its counts on.
HELD_TERMS = 300_000
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20

#: Letters of ASCII in lower case, bytes from 128 as they are, all others a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: bytes):
    """Lists of the text's terms; a very long text gives several."""
    text = text.translate(_WORD_BYTES)
    at = 0
    while len(text) - at > PIECE:
        cut = text.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield text[at:cut].split()
        at = cut
    yield (text[at:] if at else text).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; each group also has a row of term null."""
    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out():
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(terms) + 1)), pa.array([source] * (len(terms) + 1)), pa.array([None, *terms], pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(d.__getitem__, terms)], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )

        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                seen = set()
                for words in _words(text):
                    n.update(words)
                    seen.update(words)
                d.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from out()
                held = {}
        yield from out()

    counted = own.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_cells(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, total, first): the counts of kept terms, with the lang's count; `first`
    marks one row a term."""
    w = Window.partitionBy("lang", "term")  # a row a source
    cells = counts.where("term is not null").withColumns({"total": F.sum("n").over(w), "_docs": F.sum("docs").over(w)})
    first = F.col("source") == F.min("source").over(w)
    return cells.withColumn("first", first).where(F.col("_docs") >= min_docs).drop("docs", "_docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count, exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide(n + F.lit(PRIOR)) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + F.lit(PRIOR) * terms))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """share() of an array."""
    if len(counts) and int(counts.max()) + PRIOR >= (1 << 63) // UNIT:
        return np.array([1 + UNIT * (int(c) + PRIOR) // (total + PRIOR * terms) for c in counts], np.int64)
    return 1 + UNIT * (counts + PRIOR) // (total + PRIOR * terms)


def run_columns(cells: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, block, size, source, starts, counts): the runs of each source in each block of its lang's
    vocabulary; run i holds counts[i] from starts[i] on. Sources without a term of the block have no row."""
    order = [F.col("lang"), F.col("total").desc(), F.col("term")]
    ranged = cells.select("lang", "total", "term", "source", "n").repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches):
        block, size, last, columns = 0, 0, None, {}

        def out():
            rows = []
            for source, (at, n) in columns.items():
                dense = np.zeros(size, np.int64)
                dense[at] = n
                starts = np.flatnonzero(np.diff(dense, prepend=-1))  # counts are never -1, so 0 is a start
                rows.append((last[0], f"{TaskContext.get().partitionId()}-{block}", size, source, starts.astype(np.int32), dense[starts]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        types, names = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())], ["lang", "block", "size", "source", "starts", "counts"]
        for b in batches:
            for lang, term, source, n in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if last != (lang, term):
                    if last and (last[0] != lang or size == block_terms):
                        yield out()
                        block, size, columns = block + 1, 0, {}
                    last, size = (lang, term), size + 1
                at, counts = columns.setdefault(source, ([], []))
                at.append(size - 1)
                counts.append(n)
        if last:
            yield out()

    return ranged.mapInArrow(encode, "lang string, block string, size int, source string, starts array<int>, counts array<long>")


def _compared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Sum of |p - q| of each two columns of the block's two tiles."""
    a, b = key[2], key[3]
    cols = []
    for source, tile, size, starts, counts, total, terms in zip(*(pdf[c] for c in ("source", "tile", "size", "starts", "counts", "total", "terms")), strict=True):
        none = starts is None or len(starts) == 0
        starts = np.zeros(1, np.int64) if none else np.asarray(starts, np.int64)
        counts = np.zeros(1, np.int64) if none else np.asarray(counts, np.int64)
        cols.append((source, tile, size, starts, shares(counts, int(total), int(terms))))
    cols.sort(key=lambda c: c[0])
    left, right, value = [], [], []
    for i, (s, ts, size, s_at, p) in enumerate(cols):
        for t, tt, _, t_at, q in cols[i + 1 :]:
            if {ts, tt} != {a, b}:
                continue  # both of one tile of two: met where that tile meets itself
            at = np.union1d(s_at, t_at)
            apart = np.abs(p[np.searchsorted(s_at, at, "right") - 1] - q[np.searchsorted(t_at, at, "right") - 1])
            left.append(s), right.append(t), value.append(int((apart * np.diff(at, append=size)).sum()))
    names = [np.array(c, object) for c in ([key[0]] * len(left), left, right)]
    return pd.DataFrame(dict(zip("lang a b".split(), names, strict=True)) | {"value": np.array(value, np.int64)})


def groups_of(counts: DataFrame, cells: DataFrame, tile: int = TILE) -> DataFrame:
    """(lang, source, total, terms, lang_total, tile, tiles): a row a group, without terms too."""
    every = counts.where("term is null").select("lang", "source")
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = cells.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms")).join(every.groupBy("lang").agg(F.count("*").alias("_s")), "lang", "right")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    g = every.join(own, ["lang", "source"], "left").join(of_lang, "lang").select("lang", "source", zero("total"), zero("terms"), zero("lang_total"), F.ceil(F.col("_s") / tile).cast("int").alias("tiles"))
    return g.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))


def pair_sums(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of each two sources a < b of a lang with kept terms."""
    blocks = columns.select("lang", "block", "size").distinct()
    full = blocks.join(small_side(groups), "lang").join(columns.drop("size"), ["lang", "block", "source"], "left")
    met = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(F.least("tile", u).alias("t"), F.greatest("tile", u).alias("u")))
    full = full.select("*", F.explode(met).alias("_m")).select("lang", "block", "_m.t", "_m.u", "source", "tile", "size", "starts", "counts", "total", "terms")
    sums = full.groupBy("lang", "block", "t", "u").applyInPandas(_compared, "lang string, a string, b string, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources by distance (part `pair`), and the `top`
    terms that a source has more often than its lang (part `term`)."""
    counts = materialize(term_counts(docs), "term-counts")
    cells = materialize(kept_cells(counts, min_docs), "kept-cells")
    groups = materialize(groups_of(counts, cells), "term-groups")
    columns = materialize(run_columns(cells), "run-columns")

    sums = pair_sums(columns, groups)
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("_d"), "value").select("lang", "_d.*", "value")
    bare = groups.where("terms = 0").select("lang", "source")
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.unionByName(none).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(by))

    g = groups.select("lang", "source", F.col("total").alias("_n"), F.col("lang_total").alias("_q"), F.col("terms").alias("_v"))
    above = cells.where("n > 0").join(small_side(g), ["lang", "source"])
    above = above.select("lang", "source", F.col("term").alias("item"), (share(F.col("n"), F.col("_n"), F.col("_v")) - share(F.col("total"), F.col("_q"), F.col("_v"))).cast("long").alias("value"))
    terms = above.where("value > 0").withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
