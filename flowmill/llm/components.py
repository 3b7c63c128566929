"""Linking items that share hash buckets, and distributed union-find.

Members of a bucket first meet a pivot: within the task that made them, and the tasks' pivots one
another after a shuffle. So a hot bucket costs rows in proportion to its members and sends one row a
task to its own. Pairs are verified once, however many buckets they share. Where a bucket still holds
several components, its members are cut into blocks of bounded size, and each two blocks meet in a
task that compares their members exactly and hands on a spanning forest of the links: no pairs are
emitted, and no link between items that share a bucket is lost. A bucket of n members, of which the
pivots linked only a part, costs n * n / block rows of text: proof that no two of them are alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import discard, materialize, small_side

#: Members of a bucket that a block holds on average.
BLOCK = 256
#: Distinct elements that one matrix product covers.
_COLUMNS = 8192


def _grow(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v)."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    large = both.join(least, both["u"] == least["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    small = large.join(low, large["u"] == low["k"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("k", "m")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b), as a written table; component is its smallest id.
    Alternating large and small stars halve the paths; each step is written, so a lost executor costs one step."""
    old, new = [], []
    stars = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", old)
    state = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state, stars = now, materialize(_grow(stars), "stars", new)
        discard(edges.sparkSession, old)
        old, new = new, old
    out = stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
    out = materialize(out, "components")
    discard(edges.sparkSession, old)
    return out


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of every set in a with every set in b (distinct integers); without
    b, of every two sets in a (the diagonal has no meaning then)."""
    ha, hb = np.concatenate(a), None if b is None else np.concatenate(b)
    if b is None:
        ordered = np.sort(ha)
        both = tv.distinct(ordered[1:][ordered[1:] == ordered[:-1]])
    else:
        both = np.intersect1d(tv.distinct(ha), tv.distinct(hb), assume_unique=True)
    out = np.zeros((len(a), len(a if b is None else b)), np.float32)
    if not len(both):
        return out

    def places(sets: list[np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        # elements of one set alone add nothing
        row, at = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.searchsorted(both, h)
        ok = both[np.minimum(at, len(both) - 1)] == h
        return row[ok], at[ok], len(sets)

    sides = [places(a, ha)] + ([] if b is None else [places(b, hb)])
    for lo in range(0, len(both), _COLUMNS):
        n = min(_COLUMNS, len(both) - lo)
        m = []
        for rows, cols, k in sides:
            here = (cols >= lo) & (cols < lo + n)
            x = np.zeros((k, n), np.float32)
            x[rows[here], cols[here] - lo] = 1
            m.append(x)
        out += m[0] @ m[-1].T
    return out


def _forest(ids: np.ndarray, comps: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Numbers of those links left[i]-right[i] (row numbers) that join components not yet joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        a, b = root(int(comps[x])), root(int(comps[y]))
        if a != b:
            parent[b] = a
            out.append(i)
    return out


def bucket_rows(bucket: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """(bucket, id, pivot) of memberships: of these rows, a bucket's pivot is the one that a hash of
    both chooses. Other members meet the bucket's further pivots through it, so that a task hands on
    one row a hot bucket."""
    pivot = ids.copy()
    order = np.argsort(bucket)
    same = bucket[order[1:]] == bucket[order[:-1]]
    if same.any():
        some = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        some = some[np.lexsort((tv.mix(bucket[some] ^ ids[some].view(np.uint64)), bucket[some]))]
        head = np.concatenate([[True], bucket[some[1:]] != bucket[some[:-1]]])
        pivot[some] = ids[some][head][np.cumsum(head) - 1]
    return pa.RecordBatch.from_arrays([pa.array(tv.signed(bucket)), pa.array(ids), pa.array(pivot)], ["bucket", "id", "pivot"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, id, pivot) in order of the bucket, to those of buckets with several members: the
    first pivot of a bucket becomes that of the others; rows that have a pivot pass."""
    last, head = None, 0
    for b in batches:
        bucket, ids, pivot = (b.column(k).to_numpy() for k in range(3))
        own = ids == pivot
        x, y = bucket[own], ids[own]
        out = [(bucket[~own], pivot[~own], ids[~own])]
        if len(x):
            new = np.concatenate([[x[0] != last], x[1:] != x[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(x)), -1))
            first = np.where(at >= 0, y[at], head)
            met = ~new & (y != first)
            out.append((x[met], first[met], y[met]))
            last, head = x[-1], first[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["bucket", "pivot", "id"])


def _block_links(batches: Iterator[pa.RecordBatch], sets, threshold: float, weighted) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, lo, hi, block, id, component, text) in order of (bucket, lo, hi, block), to links.
    weighted: similarity of two (items, weights), for pairs whose weights aren't all one; or None."""
    key, group = None, []

    def links(group: list[tuple]) -> tuple[list[int], list[int]]:
        at = np.flatnonzero(np.array([g[0] for g in group]) == key[1])
        bt = at if key[1] == key[2] else np.arange(len(at), len(group))
        ids, comps = np.array([g[1] for g in group]), np.array([g[2] for g in group])
        apart = comps[at][:, None] != comps[bt][None, :]
        if not apart.any():
            return [], []
        items, n = [g[3] for g in group], np.array([len(g[3]) for g in group], np.float32)
        common = overlaps(items) if key[1] == key[2] else overlaps(items[: len(at)], items[len(at) :])
        union = n[at][:, None] + n[bt][None, :] - common
        hit = apart & (common >= threshold * union) & (union > 0)
        if weighted is not None:
            uneven = np.array([bool(len(g[4]) and g[4].max() != 1.0) for g in group])
            for i, j in np.argwhere(apart & ~hit & (common > 0) & (uneven[at][:, None] | uneven[bt][None, :])):
                hit[i, j] = weighted((items[at[i]], group[at[i]][4]), (items[bt[j]], group[bt[j]][4])) >= threshold
        i, j = np.nonzero(hit)
        left, right = at[i], bt[j]
        keep = _forest(ids, comps, left, right)
        return ids[left[keep]].tolist(), ids[right[keep]].tolist()

    def out(pairs: tuple[list[int], list[int]]) -> pa.RecordBatch:
        lo, hi = np.minimum(*map(np.array, pairs)), np.maximum(*map(np.array, pairs))
        return pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["a", "b"])

    for batch in batches:
        for i, j, values, lens, weights in sets(batch.column(6)):
            part = batch.slice(i, j - i)
            keys = list(zip(*(part.column(k).to_pylist() for k in (0, 1, 2)), strict=True))
            block, ids, comps = (part.column(k).to_numpy() for k in (3, 4, 5))
            cut = np.concatenate([[0], np.cumsum(lens)])
            for r, k in enumerate(keys):
                if k != key:
                    if len(group) > 1 and (got := links(group))[0]:
                        yield out(got)
                    key, group = k, []
                s = slice(cut[r], cut[r + 1])
                group.append((block[r], ids[r], comps[r], values[s], weights[s] if weighted is not None else None))
    if len(group) > 1 and (got := links(group))[0]:
        yield out(got)


def link_buckets(members: DataFrame, verify, texts: Callable[[DataFrame], DataFrame], sets, threshold: float, weighted=None, block: int = BLOCK) -> DataFrame:
    """(id, component) of items with a link, among items that share a bucket.

    members: (bucket, id, pivot) as bucket_rows() gives them. verify: batches of (a, b, text_a, text_b)
    to those (a, b) that belong together. texts: of (id), returns (id, text). sets: a column of texts
    to (first row, end row, distinct items, their number a row, weights); weighted: see _block_links.
    """
    done: list[str] = []
    scratch = lambda df, name: materialize(df, name, done)
    # pivots go to their bucket; rows that have met one are spread. One sort key: a radix sort
    place = F.when(F.col("id") == F.col("pivot"), F.col("bucket")).otherwise(F.col("id"))
    met = members.repartition(place).sortWithinPartitions("bucket")
    live = scratch(met.mapInArrow(_meet, "bucket long, pivot long, id long"), "bucket-members")
    pairs = scratch(live.select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct(), "pairs")
    own = scratch(texts(scratch(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "pair-ids")), "pair-texts")
    a, b = (own.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    links = scratch(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long"), "links")
    comps = connected_components(links)
    # a bucket all of whose rows were linked is one component
    known = small_side(comps)
    tag = lambda df, col: df.join(known.select(F.col("id").alias(col), F.col("component").alias(f"{col}_of")), col, "left").withColumn(f"{col}_of", F.coalesce(f"{col}_of", col))
    bad = scratch(tag(tag(live, "id"), "pivot").where("id_of <> pivot_of").select("bucket").distinct(), "mixed-buckets")
    mixed = live.join(small_side(bad), "bucket", "left_semi")
    mixed = scratch(mixed.select("bucket", "id").union(mixed.select("bucket", "pivot")).distinct(), "mixed-members")
    sizes = mixed.groupBy("bucket").count().where("count > 2")  # two members have met
    sizes = scratch(sizes.select("bucket", F.ceil(F.col("count") / block).cast("int").alias("_blocks")), "block-numbers")
    if sizes.limit(1).count():
        open_ = tag(mixed.join(small_side(sizes), "bucket"), "id").withColumnRenamed("id_of", "component")
        open_ = open_.withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        open_ = open_.select("bucket", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"), "block", "id", "component")
        rows = open_.join(own, "id").select("bucket", "lo", "hi", "block", "id", "component", "text")
        # a fixed number: few bytes may be much work, so small partitions must not be merged
        parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(parts, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "block")
        more = rows.mapInArrow(lambda it: _block_links(it, sets, threshold, weighted), "a long, b long").distinct()
        comps = connected_components(links.union(scratch(more, "block-links")))
    discard(members.sparkSession, done)
    return comps
