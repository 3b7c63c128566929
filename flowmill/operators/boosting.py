"""Softmax boosting on binned features: second-order, level by level, by sums that Spark makes.

Rows are packed into blocks of a table (bins of one byte, class, weight, scores). A round fits one tree
a class to the gradients of the weighted log-loss. For each level every task adds up, for its blocks,
gradient, curvature and weight by class, node, feature and bin; the tasks' sums meet by class and parent
node. Only the lighter child of each split is counted, by its parent's share of the training weight; the
other is its parent's sums less these. The best split of a node is found where its sums are. The driver
gets one row a node; the table is rewritten with new scores once a round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import removed, written

#: Rows of a block, bins of a feature at most.
BLOCK_ROWS, BINS = 8192, 64


@dataclass
class Tree:
    """Nodes in the order of a full binary tree (children of i: 2i+1, 2i+2); feature -1 is a leaf.
    A row goes left if its bin is at most `cut`."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            f = self.feature[at]
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at


@dataclass
class Boosted:
    """edges [feature]: ascending upper bounds of all bins but the last; start: log shares of the classes;
    trees [round][class]; losses: mean weighted training log-loss before each round and after the last."""

    edges: list[np.ndarray]
    start: np.ndarray
    trees: list[list[Tree]]
    losses: list[float]
    depth: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), len(self.start)))
        for trees in self.trees[first:]:
            for k, t in enumerate(trees):
                out[:, k] += t.value[t.nodes(bins, self.depth)]
        return out


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(scores: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[row, class] first and second derivatives of the weighted log-loss."""
    p = softmax(scores)
    g, h = p.copy(), 2 * p * (1 - p)  # twice the diagonal bounds the whole matrix
    g[np.arange(len(p)), label] -= 1
    return g * weight[:, None], np.maximum(h, 1e-16) * weight[:, None]


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, penalty: float, least: float) -> tuple[float, int, int, float]:
    """(gain, feature, cut, share of weight that goes left) of one node's sums [feature, bin]; feature -1: no split gains."""
    total_g, total_h = g[0].sum(), h[0].sum()
    left_g, left_h, left_n = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1], n.cumsum(1)[:, :-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - total_g**2 / (total_h + penalty)
    all_n = n[0].sum()
    gain[(left_h < least) | (right_h < least) | (left_n <= 0) | (left_n >= all_n)] = -np.inf
    if not gain.size or gain.max() <= 1e-9:
        return 0.0, -1, 0, 0.0
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b), float(left_n[f, b] / all_n)


def bin_edges(rows: DataFrame, n: int, bins: int = BINS) -> list[np.ndarray]:
    """Distinct quantiles of each of n features, by Spark's sketch."""
    cuts = [k / bins for k in range(1, bins)]
    q = rows.agg(*[F.percentile_approx(F.col("x")[j], cuts, 10_000).alias(f"q{j}") for j in range(n)]).first()
    return [np.unique([v for v in (q[j] or []) if v is not None and v == v]) for j in range(n)]


def _packed(rows: DataFrame, model: Boosted) -> DataFrame:
    def pack(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[at : at + BLOCK_ROWS]
                bins = model.bins(np.stack(part["x"]).astype(float))
                scores = np.tile(model.start, (len(part), 1))
                yield pd.DataFrame({"bins": [bins.tobytes()], "label": [part["label"].to_numpy(np.int32).tobytes()], "weight": [part["weight"].to_numpy(float).tobytes()], "scores": [scores.tobytes()]})

    return rows.select("x", "label", "weight").mapInPandas(pack, BLOCKS)


BLOCKS = "bins binary, label binary, weight binary, scores binary"
SUMS = "class int, parent int, node int, sums binary"


def _unpacked(block, features: int, classes: int):
    label = np.frombuffer(block.label, np.int32)
    return np.frombuffer(block.bins, np.uint8).reshape(len(label), features), label, np.frombuffer(block.weight, float), np.frombuffer(block.scores, float).reshape(len(label), classes)


def _level(blocks: DataFrame, before: DataFrame | None, trees: list[Tree], counted: dict[int, set[int]], level: int, bins: int, features: int, classes: int, penalty: float, least: float) -> DataFrame:
    """(class, parent, node, sums, gain, feature, cut, left, g, h) of each node of this level."""
    shape = (3, features, bins)

    def add(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for block in pdf.itertuples():
                b, label, weight, scores = _unpacked(block, features, classes)
                g, h = gradients(scores, label, weight)
                for k, tree in enumerate(trees):
                    at = tree.nodes(b, level)
                    for node in counted[k]:
                        own = at == node
                        if not own.any():
                            continue
                        s = held.setdefault((k, node), np.zeros(shape))
                        cell = (b[own].astype(np.int64) + bins * np.arange(features)).ravel()
                        for i, v in enumerate((g[own, k], h[own, k], weight[own])):
                            s[i] += np.bincount(cell, np.repeat(v, features), features * bins).reshape(features, bins)
        yield pd.DataFrame([(k, (node - 1) // 2, node, s.tobytes()) for (k, node), s in held.items()], columns=["class", "parent", "node", "sums"])

    def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sums: dict[int, np.ndarray] = {}
        for node, s in zip(pdf["node"], pdf["sums"], strict=True):
            sums[node] = sums.get(node, 0) + np.frombuffer(s, float).reshape(shape)
        parent = sums.pop(key[1], None)  # rows of the level before
        if parent is not None and level:
            left = 2 * key[1] + 1
            own = next(iter(sums), None)
            if own is None:  # no row of the lighter child is left: all are the other's
                own = next(iter(counted[key[0]] & {left, left + 1}))
                sums[own] = np.zeros(shape)
            sums[2 * left + 1 - own] = parent - sums[own]
        rows = [(key[0], key[1], node, s.tobytes(), *best_split(*s, penalty, least), s[0, 0].sum(), s[1, 0].sum()) for node, s in sums.items()]
        return pd.DataFrame(rows, columns=["class", "parent", "node", "sums", "gain", "feature", "cut", "left", "g", "h"])

    met = blocks.mapInPandas(add, SUMS)
    if before is not None:  # the parents' sums, of those that were split
        met = met.unionByName(before.where("feature >= 0").select("class", F.col("node").alias("parent"), "node", "sums"))
    return met.groupBy("class", "parent").applyInPandas(split, f"{SUMS}, gain double, feature int, cut int, left double, g double, h double")


def _rescored(blocks: DataFrame, model: Boosted, features: int, classes: int) -> DataFrame:
    """The blocks with the last round's trees added to their scores."""

    def run(batches):
        for pdf in batches:
            out = []
            for block in pdf.itertuples():
                b, _, _, scores = _unpacked(block, features, classes)
                out.append((scores + model.margins(b, len(model.trees) - 1)).tobytes())
            yield pdf.assign(scores=out)

    return blocks.mapInPandas(run, BLOCKS)


def _loss(blocks: DataFrame, features: int, classes: int) -> float:
    def run(batches):
        for pdf in batches:
            for block in pdf.itertuples():
                _, label, weight, scores = _unpacked(block, features, classes)
                p = softmax(scores)[np.arange(len(label)), label]
                yield pd.DataFrame({"loss": [float(-(np.log(np.maximum(p, 1e-300)) * weight).sum())], "weight": [float(weight.sum())]})

    loss, weight = blocks.mapInPandas(run, "loss double, weight double").agg(F.sum("loss"), F.sum("weight")).first()
    return loss / weight


def fit(rows: DataFrame, classes: int, rounds: int = 100, depth: int = 4, rate: float = 0.1, penalty: float = 1.0, least: float = 1.0, bins: int = BINS) -> Boosted:
    """A boosted model of rows (x array<double>, label int from 0, weight double). Rows with a null in one
    of them, and rows of weight 0 or less, take no part; null or NaN components go to the last bin. An error
    without rows."""
    rows = rows.where("x is not null and label is not null and weight > 0")
    features = len(rows.select("x").first()[0])
    shares = {r["label"]: r["w"] for r in rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()}  # a row a class
    w = np.array([shares.get(k, 0.0) for k in range(classes)])
    model = Boosted(bin_edges(rows, features, bins), np.log(np.maximum(w / w.sum(), 1e-6)), [], [], depth)
    blocks = written(_packed(rows, model), "boost-0")
    size = 2 ** (depth + 1) - 1
    for r in range(rounds):
        model.losses.append(_loss(blocks, features, classes))
        trees = [Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in range(classes)]
        counted, before, used = {k: {0} for k in range(classes)}, None, []
        for level in range(depth + 1):
            after = written(_level(blocks, before, trees, counted, level, bins, features, classes, penalty, least), f"boost-{r}-{level}")
            used.append(after)
            counted = {k: set() for k in range(classes)}
            for n in after.drop("sums").collect():  # a row a node and class
                t = trees[n["class"]]
                t.value[n["node"]] = -rate * n["g"] / (n["h"] + penalty)
                if n["feature"] >= 0 and level < depth:
                    t.feature[n["node"]], t.cut[n["node"]] = n["feature"], n["cut"]
                    counted[n["class"]].add(2 * n["node"] + (1 if n["left"] <= 0.5 else 2))  # the lighter child
            before = after
            if not any(counted.values()):
                break
        model.trees.append(trees)
        rescored = written(_rescored(blocks, model, features, classes), f"boost-{r + 1}")
        removed(blocks, *used)
        blocks = rescored
    model.losses.append(_loss(blocks, features, classes))
    removed(blocks)
    return model


def predict(model: Boosted, rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, y_pred, probability array of rows (x array<double>); rows without x have nulls."""

    def run(batches):
        for pdf in batches:
            ok = pdf["x"].notna().to_numpy()
            p, y = [None] * len(pdf), [None] * len(pdf)
            if ok.any():
                found = softmax(model.start + model.margins(model.bins(np.stack(pdf["x"][ok]).astype(float))))
                for i, v in zip(np.flatnonzero(ok), found, strict=True):
                    p[i], y[i] = v, int(v.argmax())
            yield pdf[keep].assign(y_pred=pd.array(y, dtype="Int32"), probability=p)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*keep, "x").mapInPandas(run, f"{kinds}, y_pred int, probability array<double>")


def log_loss(scored: DataFrame) -> float:
    """Mean log-loss of scored rows with `label`."""
    p = F.greatest(F.get("probability", F.col("label").cast("int")), F.lit(1e-15))
    return scored.agg(F.avg(-F.log(p))).first()[0]
