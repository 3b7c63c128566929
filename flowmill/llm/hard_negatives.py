"""Operator 12: hard negatives by a multiway hyperplane tree (GNAT style), exact.

Vectors are whole numbers (each component times 256, rounded down), rows are scored by their inner
product with an anchor, and positives and negatives are the best rows of a window of scores.

The tree. Split points are drawn from a bounded sample (`SAMPLE` rows, by hash of the id): a node's
rows go to the nearest of up to `WAYS` split points. Every row of the table is sent down the tree, and
each node stores, for each split point i and each sibling's subtree j, the least and the largest
distance from i to a row of j, and for each leaf its rows' least and largest norms: all of bounded size
(`MAX_LEAVES`). Rows of a leaf are dealt to parts of about `PART_ROWS`, so that a leaf that holds a
third of all rows is many tasks.

A search. For rows of norm |x|, a window of scores is a ring of distances around the anchor:
d^2 = |q|^2 + |x|^2 - 2 score. A subtree whose stored range, seen from any split point of its node,
can't meet the ring is left out with all below it; the rest goes down to leaves, whose rows are all
compared exactly. The search for positives first visits the anchor's own leaf, whose fifth best score
of the label bounds the window; the search for negatives has its windows from the positives. Each task
hands on the best few of each window, and a window function over these merges the tasks.

Defined results: rows with a null id, label, vector or component, or a component that isn't finite,
take no part; short vectors are filled with zeros; of rows that repeat an id only one takes part, that
with the smallest label and vector; components of 2^17 or more in size are an error (times 256, scores
of 4,096 of them might not fit a long); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between LOW / 100 and HIGH / 100 of the positive's.
LOW, HIGH = 80, 100
#: Rows that the tree is fitted on, split points of a node, leaves at most.
SAMPLE, WAYS, MAX_LEAVES = 20_000, 16, 4096
#: Rows of a leaf that a task compares at once, and that a leaf aims at.
PART_ROWS, LEAF_ROWS = 4096, 2048
#: Distances are rounded; ranges are widened by this share of the largest norm, so that no row is lost.
SLACK = 1e-7
#: Queries that a task compares with a part of a leaf.
QUERY_ROWS = 65_536
#: Scores below any.
NEVER = -(1 << 62)


@dataclass
class Node:
    """A split: its points, where each leads (a node, or a leaf as -1 - leaf), and the distance ranges
    [i, j] from point i to the rows of subtree j."""

    points: np.ndarray
    to: list[int] = field(default_factory=list)
    near: np.ndarray | None = None
    far: np.ndarray | None = None


@dataclass
class Tree:
    nodes: list[Node]
    leaves: int
    #: Least and largest squared norm of a leaf's rows, and how many rows there are.
    small: np.ndarray | None = None
    large: np.ndarray | None = None
    rows: np.ndarray | None = None


def _apart(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of rows and points; squares of whole numbers are exact up to 2^53."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (x @ points.T), 0))


def fit(sample: np.ndarray, leaf_rows: int, ways: int = WAYS, max_leaves: int = MAX_LEAVES, seed: int = 42) -> Tree:
    """A tree over sampled rows; nodes are split breadth first while they hold more than leaf_rows of them."""
    rng, tree = np.random.default_rng(seed), Tree([], 1)
    waiting = [(np.arange(len(sample)), None)]  # rows, (node, way) that leads here
    while waiting:
        rows, way = waiting.pop(0)
        distinct = np.unique(sample[rows], axis=0) if len(rows) else sample[rows]
        if len(rows) <= leaf_rows or len(distinct) < 2 or tree.leaves + ways > max_leaves:
            continue
        # of three times as many random rows, greedily those far from one another; no more than leaves of the size aimed at
        split = max(2, min(ways, -(-len(rows) // leaf_rows)))
        tried = distinct[rng.permutation(len(distinct))[: 3 * split]]
        chosen = [0]
        far = _apart(tried, tried[:1])[:, 0]
        while len(chosen) < min(split, len(tried)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _apart(tried, tried[chosen[-1:]])[:, 0])
        node = Node(tried[chosen])
        own = len(tree.nodes)
        tree.nodes.append(node)
        if way is None:
            tree.leaves = 0
            first = None
        else:
            first = tree.nodes[way[0]].to[way[1]]
            tree.nodes[way[0]].to[way[1]] = own
        at = _apart(sample[rows], node.points).argmin(1)
        for i in range(len(chosen)):
            if i == 0 and first is not None:
                node.to.append(first)  # the leaf that was here becomes the first way's
            else:
                node.to.append(-1 - tree.leaves)
                tree.leaves += 1
            waiting.append((rows[at == i], (own, i)))
    return tree


def descend(tree: Tree, x: np.ndarray, seen=None) -> np.ndarray:
    """The leaf of each row; seen(node, way, distances of the rows that take it) is told of each step."""
    leaf = np.zeros(len(x), np.int64)
    waiting = [(0, np.arange(len(x)))] if tree.nodes else []
    while waiting:
        k, rows = waiting.pop()
        d = _apart(x[rows], tree.nodes[k].points)
        at = d.argmin(1)
        for i, to in enumerate(tree.nodes[k].to):
            own = at == i
            if own.any():
                if seen:
                    seen(k, i, d[own])
                if to < 0:
                    leaf[rows[own]] = -1 - to
                else:
                    waiting.append((to, rows[own]))
    return leaf


def survivors(tree: Tree, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The leaves that may hold a row whose score with q lies in one of the windows low[w]..high[w]."""
    out, qq = [], float(q @ q)
    if not tree.nodes:
        return np.zeros(min(1, int(tree.rows[0])), np.int64)
    # the ring of a window over all norms; leaves look at their own norms again
    least, most = tree.small[tree.rows > 0].min(initial=np.inf), tree.large[tree.rows > 0].max(initial=0)
    slack = SLACK * np.sqrt(max(qq, most))

    waiting = [0]
    while waiting:
        node = tree.nodes[waiting.pop()]
        to = np.array(node.to)
        d = _apart(q[None, :], node.points)[0][:, None]
        lowest = np.maximum(np.maximum(node.near - d, d - node.far), 0).max(0)  # of a row's distance to q, by all split points
        highest = (node.far + d).min(0)
        nl, nh = np.full(len(to), least), np.full(len(to), most)
        leaf = to < 0
        nl[leaf], nh[leaf] = tree.small[-1 - to[leaf]], tree.large[-1 - to[leaf]]
        full = np.isfinite(highest)  # ways with rows
        inner = np.sqrt(np.maximum(qq + nl[full] - 2 * high[:, None], 0))  # the ring of each window and way
        outer = qq + nh[full] - 2 * low[:, None]
        meets = (outer >= 0) & (lowest[full] - slack <= np.sqrt(np.maximum(outer, 0))) & (highest[full] + slack >= inner) & (low <= high)[:, None]
        for j in np.flatnonzero(full)[meets.any(0)]:
            out.append(-1 - to[j]) if to[j] < 0 else waiting.append(to[j])
    return np.array(out, np.int64)


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, v): rows that take part, one an id, as whole numbers."""
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * SCALE))
    big = F.exists("embedding", lambda x: F.abs(x.cast("double")) >= F.lit(float(1 << 17)))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    kept = rows.where("vec_id is not null and label is not null and embedding is not null").where(~odd)
    v = F.when(big, F.raise_error(F.lit("a component is too large for exact scores")).cast("array<bigint>")).otherwise(whole)
    one = kept.select("vec_id", F.struct(label.cast("long").alias("label"), v.cast("array<int>").alias("v")).alias("_r")).groupBy("vec_id").agg(F.min("_r").alias("_r"))
    return one.select("vec_id", "_r.*")


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where no sum can pass 2^53, in whole numbers else."""
    if not len(q) or not len(x) or np.sqrt((q * q).sum(1).max() * (x * x).sum(1).max()) < 2**52:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row above NEVER; of equal ones, the first columns."""
    n = scores.shape[1]
    if n > 4 * k:  # only those that reach the k-th best
        least = np.partition(scores, n - k, axis=1)[:, n - k, None]
        scores = np.where(scores >= least, scores, NEVER)
    row, column = np.nonzero(scores > NEVER)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k]


class Index:
    """The tree and its rows: a table (vec_id, label, v, leaf, part) in the shared folder."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, part_rows: int = PART_ROWS, seed: int = 42):
        spark = rows.sparkSession
        rows = materialize(rows, "vectors")
        n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
        n, dims = self.n, self.dims = int(n), int(dims or 0)
        drawn = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).select("v").collect()
        share = min(1.0, sample / max(1, n))
        self.tree = tree = fit(_matrix([r[0] for r in drawn], dims), max(8, int(leaf_rows * share)), seed=seed)

        def place(parts):
            for pdf in parts:
                leaf = descend(tree, _matrix(pdf["v"], dims))
                yield pdf.assign(leaf=leaf.astype(np.int32))

        placed = materialize(rows.mapInPandas(place, "vec_id long, label long, v array<int>, leaf int"), "vector-leaves")

        def ranges(parts):
            """A row a node, point and way: nearest and farthest; and a row a leaf: norms and rows."""
            near = [np.full((len(k.points),) * 2, np.inf) for k in tree.nodes]
            far = [np.full((len(k.points),) * 2, -np.inf) for k in tree.nodes]
            norms = np.array([[np.inf, -np.inf, 0.0]] * tree.leaves)

            def seen(k, way, d):
                near[k][:, way] = np.minimum(near[k][:, way], d.min(0))
                far[k][:, way] = np.maximum(far[k][:, way], d.max(0))

            for pdf in parts:
                x = _matrix(pdf["v"], dims)
                leaf, xx = descend(tree, x, seen), (x * x).sum(1)
                np.minimum.at(norms[:, 0], leaf, xx)
                np.maximum.at(norms[:, 1], leaf, xx)
                np.add.at(norms[:, 2], leaf, 1)
            rows = [(k, i, j, near[k][i, j], far[k][i, j], 0.0) for k in range(len(near)) for i, j in zip(*np.nonzero(np.isfinite(near[k])), strict=True)]
            rows += [(-1, i, 0, *norms[i]) for i in np.flatnonzero(norms[:, 2])]
            yield pd.DataFrame(rows, columns=["node", "i", "j", "lo", "hi", "n"])

        found = placed.select("v").mapInPandas(ranges, "node int, i int, j int, lo double, hi double, n double")
        found = found.groupBy("node", "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).toPandas()  # bounded by the tree
        for k in tree.nodes:
            k.near, k.far = np.full((len(k.points),) * 2, np.inf), np.full((len(k.points),) * 2, np.inf)
        tree.small, tree.large, tree.rows = np.full(tree.leaves, np.inf), np.zeros(tree.leaves), np.zeros(tree.leaves, np.int64)
        for node, i, j, lo, hi, rows_ in found.itertuples(index=False):
            if node < 0:
                tree.small[i], tree.large[i], tree.rows[i] = lo, hi, int(rows_)
            else:
                tree.nodes[node].near[i, j], tree.nodes[node].far[i, j] = lo, hi
        self.parts = np.maximum(1, -(-tree.rows // part_rows)).tolist()
        parts_of = F.array(*[F.lit(p) for p in self.parts]) if len(self.parts) <= 64 else None
        if parts_of is None:
            sizes = spark.createDataFrame(list(enumerate(self.parts)), "leaf int, parts int")
            placed = placed.join(F.broadcast(sizes), "leaf")  # a row a leaf: at most MAX_LEAVES
        else:
            placed = placed.withColumn("parts", parts_of[F.col("leaf")])
        self.rows = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")

    def search(self, queries: DataFrame, k: int, same: bool, own_leaf: bool = False) -> DataFrame:
        """(vec_id, window, row_id, score, compared): the best k rows of each window of scores.

        queries: (vec_id, label, v, low array<long>, high array<long>). same: rows of the query's label but
        the query itself, else rows of other labels. own_leaf: only the leaf where the query itself lies."""
        tree, dims, parts = self.tree, self.dims, self.parts
        asked = queries.select("vec_id", "label", "v", "low", "high")
        blocks = max(1, -(-asked.count() // QUERY_ROWS))

        def route(batches):
            for pdf in batches:
                q = _matrix(pdf["v"], dims)
                home = descend(tree, q) if own_leaf else None
                at, leaf, part = [], [], []
                for i in range(len(pdf)):
                    if len(at) > PART_ROWS:
                        yield pdf.iloc[at].assign(leaf=np.array(leaf, np.int32), part=np.array(part, np.int32))
                        at, leaf, part = [], [], []
                    low, high = np.asarray(pdf["low"].iloc[i], float), np.asarray(pdf["high"].iloc[i], float)
                    for j in home[i : i + 1] if own_leaf else survivors(tree, q[i], low, high):
                        at += [i] * parts[j]
                        leaf += [j] * parts[j]
                        part += range(parts[j])
                yield pdf.iloc[at].assign(leaf=np.array(leaf, np.int32), part=np.array(part, np.int32))

        def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            right = right.sort_values("vec_id")
            x, ids, labels = _matrix(right["v"], dims), right["vec_id"].to_numpy(np.int64), right["label"].to_numpy()
            out = [pd.DataFrame({"vec_id": ids[:0], "window": np.zeros(0, np.int32), "row_id": ids[:0], "score": ids[:0]})]
            for at in range(0, len(left), 1024):
                part = left.iloc[at : at + 1024]
                scores = _products(_matrix(part["v"], dims), x) if len(right) else np.zeros((len(part), 0), np.int64)
                alike = part["label"].to_numpy()[:, None] == labels[None, :]
                fits = alike & (part["vec_id"].to_numpy()[:, None] != ids[None, :]) if same else ~alike
                windows = [len(w) for w in part["low"]]
                for w in range(max(windows)):
                    asked = np.array([n > w for n in windows])
                    low, high = (np.array([b[w] for b in part[c][asked]], np.int64)[:, None] for c in ("low", "high"))
                    who, which = _best(np.where(fits[asked] & (scores[asked] >= low) & (scores[asked] <= high), scores[asked], NEVER), k)
                    out.append(pd.DataFrame({"vec_id": part["vec_id"].to_numpy()[asked][who], "window": np.full(len(who), w, np.int32), "row_id": ids[which], "score": scores[asked][who, which]}))
            return pd.concat(out)

        routed = asked.mapInPandas(route, "vec_id long, label long, v array<int>, low array<long>, high array<long>, leaf int, part int")
        # of the same type on both sides: a cogroup sends equal numbers of different types to different tasks
        routed = routed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        rows = self.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        own = ["leaf", "part", "block"]
        met = routed.groupBy(*own).cogroup(rows.groupBy(*own)).applyInPandas(compare, "vec_id long, window int, row_id long, score long")
        w = Window.partitionBy("vec_id", "window").orderBy(F.desc("score"), "row_id")
        return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def compared(self, queries: DataFrame) -> float:
        """The share of all (query, row) pairs that a search for these windows compares."""
        tree = self.tree

        def count(batches):
            for pdf in batches:
                q = _matrix(pdf["v"], self_dims)
                yield pd.DataFrame({"n": [int(tree.rows[survivors(tree, q[i], np.asarray(pdf["low"].iloc[i], float), np.asarray(pdf["high"].iloc[i], float))].sum()) for i in range(len(pdf))]})

        self_dims = self.dims
        n, met = queries.select("v", "low", "high").mapInPandas(count, "n long").agg(F.count("*"), F.sum("n")).first()
        return (met or 0) / max(1, n * self.n)


def mine(rows: DataFrame, anchors: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, **index) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor.

    rows: (vec_id, label, embedding). anchors: which rows are anchors. label: of the rows, before the search."""
    tree = Index(usable(rows, label), **index)
    own = tree.rows.where(anchors).select("vec_id", "label", "v")
    every = F.array(F.lit(NEVER)), F.array(F.lit(-NEVER))
    home = materialize(tree.search(own.withColumns({"low": every[0], "high": every[1]}), positives, same=True, own_leaf=True), "own-leaf")
    bound = home.where(F.col("rank") == positives).select("vec_id", F.array("score").alias("low"))
    bounded = own.join(small_side(bound), "vec_id", "left").select("vec_id", "label", "v", F.coalesce("low", every[0]).alias("low"), every[1].alias("high"))
    best = materialize(tree.search(bounded, positives, same=True), "positives")

    windows = best.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("rank", "row_id", "score"))).alias("_p"))  # at most `positives` entries
    ceil = lambda s: F.ceil(F.lit(low).cast("decimal(20,0)") * s / F.lit(100)).cast("long")
    floor = lambda s: F.floor(F.lit(high).cast("decimal(20,0)") * s / F.lit(100)).cast("long")
    asked = own.join(windows, "vec_id").withColumns({"low": F.transform("_p", lambda p: ceil(p["score"])), "high": F.transform("_p", lambda p: floor(p["score"]))})
    asked = materialize(asked, "windows")
    found = tree.search(asked, negatives, same=False)
    p = F.get("_p", F.col("window"))
    out = found.join(asked.select("vec_id", "_p"), "vec_id")
    return out.select(F.col("vec_id").alias("anchor_id"), p["row_id"].alias("positive_id"), "rank", F.col("row_id").alias("negative_id"), p["score"].alias("positive_score"), F.col("score").alias("negative_score"))
