"""Shapley attributions of fitted models: exact ones of forests, and a kernel regression for any model.

A forest's attributions are path-dependent: a feature that isn't known sends a row down both sides of
a split, in proportion to the training weight of each. Every leaf is a product over the features of
its path, which either hold for the row (1) or not (0), and hold for a share z of the rows that reach
the split otherwise; the sums over all subsets of those features by size are the coefficients of a
polynomial, extended by a factor a feature and divided by that factor again for the feature's own
part. So a leaf with d features takes d^2 steps, not 2^d.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import combinations
from math import comb, factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.captures import scratch_path, written

#: Numbers that a step over leaves and rows may hold at once.
CELLS = 1 << 21
#: Cells (features x classes numbers each) up to which their attributions are broadcast.
BROADCAST_CELLS = 50_000


@dataclass
class Paths:
    """Leaves of a tree with equally many features on their path: features, bounds and weight shares
    [leaf, feature], and the leaves' class shares."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def forest_nodes(model) -> DataFrame:
    """(tree, id, left, right, feature, threshold, stats): the nodes of a fitted forest, by its own writer."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = scratch_path(spark, f"forest-{uuid.uuid4().hex[:8]}")
    model.write().save(path)
    n = spark.read.parquet(f"{path}/data")
    split = F.col("nodeData.split")
    threshold = F.when(split["numCategories"] == -1, F.get(split["leftCategoriesOrThreshold"], F.lit(0)))
    return n.select(F.col("treeID").alias("tree"), "nodeData.id", F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"), split["featureIndex"].alias("feature"), threshold.alias("threshold"), F.col("nodeData.impurityStats").alias("stats"))


def forest_paths(nodes: pd.DataFrame) -> tuple[list[Paths], np.ndarray, int]:
    """Every tree's leaves grouped by the features of their paths, the mean prediction of a row of which
    nothing is known, and the number of trees. nodes: forest_nodes(), of a size that the model's settings bound."""
    groups: list[Paths] = []
    trees = nodes.groupby("tree")
    expected = 0.0
    for _, tree in trees:
        rows = {r.id: r for r in tree.itertuples()}
        weight = {i: float(np.sum(r.stats)) for i, r in rows.items()}
        found: dict[int, list] = {}
        waiting = [(0, {})]
        while waiting:
            i, path = waiting.pop()
            r = rows[i]
            if r.left < 0:
                value = np.asarray(r.stats, float) / max(weight[i], 1e-300)
                expected = expected + value * weight[i] / weight[0]
                found.setdefault(len(path), []).append((path, value))
                continue
            if r.threshold is None or np.isnan(r.threshold):
                raise ValueError("splits on categories have no threshold")
            low, high, share = path.get(r.feature, (-np.inf, np.inf, 1.0))
            for child, bounds in ((r.left, (low, min(high, r.threshold))), (r.right, (max(low, r.threshold), high))):
                waiting.append((child, path | {r.feature: (*bounds, share * weight[child] / max(weight[i], 1e-300))}))
        for d, leaves in found.items():
            if d:
                cell = np.array([[(f, *v) for f, v in path.items()] for path, _ in leaves])
                groups.append(Paths(cell[:, :, 0].astype(int), cell[:, :, 1], cell[:, :, 2], cell[:, :, 3], np.array([v for _, v in leaves])))
    return groups, np.asarray(expected) / len(trees), len(trees)


def path_weights(holds: np.ndarray, share: np.ndarray) -> np.ndarray:
    """[..., d]: for each feature of a path, (holds - share) times the mean over orders of the others'
    product, each being `holds` if it comes earlier and `share` if later. holds, share: [..., d]."""
    d = holds.shape[-1]
    c = np.zeros((*holds.shape[:-1], d + 1))
    c[..., 0] = 1
    for j in range(d):  # times (share + holds t)
        o, z = holds[..., j, None], share[..., j, None]
        c[..., 1 : j + 2] = c[..., 1 : j + 2] * z + c[..., : j + 1] * o
        c[..., 0] *= share[..., j]
    weight = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
    out = np.zeros_like(share)
    for j in range(d):
        o, z = holds[..., j], share[..., j]
        # where the feature holds, divide from the top (share <= 1), else by the share alone
        top, kept, alone = 0.0, 0.0, 0.0
        safe = np.where(z > 0, z, 1.0)
        for k in range(d - 1, -1, -1):
            top = c[..., k + 1] - z * top
            kept = kept + weight[k] * top
            alone = alone + weight[k] * c[..., k] / safe
        out[..., j] = np.where(o > 0, (1 - z) * kept, np.where(z > 0, -z * alone, 0.0))
    return out


def tree_values(groups: list[Paths], trees: int, x: np.ndarray, classes: int) -> np.ndarray:
    """[row, feature, class] attributions of the rows x."""
    phi = np.zeros((len(x), x.shape[1], classes))
    for g in groups:
        leaves, d = g.feature.shape
        step = max(1, CELLS // max(1, leaves * (d + 1)))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            seen = part[:, g.feature]
            holds = ((seen > g.low) & (seen <= g.high)).astype(float)
            w = path_weights(holds, np.broadcast_to(g.share, holds.shape))
            for f in np.unique(g.feature):
                at_leaf, at_feature = np.nonzero(g.feature == f)
                phi[at : at + step, f] += w[:, at_leaf, at_feature] @ g.value[at_leaf]
    return phi / trees


def thresholds(groups: list[Paths], n: int) -> list[np.ndarray]:
    """The bounds of each of n features in all trees, ascending: rows between the same bounds lie in the same leaves."""
    found: list[set] = [set() for _ in range(n)]
    for g in groups:
        for bounds in (g.low, g.high):
            for f, v in zip(g.feature.ravel().tolist(), bounds.ravel().tolist(), strict=True):
                found[f].add(v)
    return [np.array(sorted(v for v in f if np.isfinite(v))) for f in found]


def tree_attribution(model: PipelineModel, classes: list[str], df: DataFrame, features: list[str], row_id: str) -> DataFrame:
    """(row_id, class, expected, prediction, phi): a row each row and class; phi maps each feature to its
    attribution in the model's probability of the class. expected plus all of them is the prediction.

    model: a pipeline that ends in a random forest; attributions are of the features as the forest gets
    them, scaled. Rows between the same thresholds of the forest lie in the same leaves: they are one cell,
    which is explained once. Rows with gaps that the pipeline fills are explained as filled. The forest's paths go
    to every task: their size depends on the number and depth of its trees only."""
    ready = PipelineModel(model.stages[:-1]).transform(df.withColumns({f: F.col(f).cast("double") for f in features})) if len(model.stages) > 1 else df
    forest = model.stages[-1]
    groups, expected, trees = forest_paths(forest_nodes(forest).toPandas())
    scored = forest.transform(ready).select(F.col(row_id).alias("row_id"), vector_to_array("features").alias("x"), vector_to_array("probability").alias("p"))
    bounds = thresholds(groups, len(features))

    def place(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"])
                at = np.stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(bounds)], 1).astype(np.int32)
                yield pdf.assign(cell=[row.tobytes() for row in at])

    def explain(batches):
        for pdf in batches:
            if len(pdf):
                phi = tree_values(groups, trees, np.stack(pdf["x"]), len(classes))
                yield pd.DataFrame({"cell": pdf["cell"], "phi": [list(v.T) for v in phi]})

    kind = scored.schema["row_id"].dataType.simpleString()
    placed = written(scored.mapInPandas(place, f"row_id {kind}, x array<double>, p array<double>, cell binary"), "placed")
    cells = placed.groupBy("cell").agg(F.any_value("x").alias("x"))  # equal leaves, equal attributions: each cell is explained once
    spread = cells.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "cell")
    phi = written(spread.mapInPandas(explain, "cell binary, phi array<array<double>>"), "cell-phi")
    found = placed.select("row_id", "p", "cell").join(F.broadcast(phi) if phi.count() <= BROADCAST_CELLS else phi, "cell")
    by_class = F.transform(F.arrays_zip("p", "phi"), lambda c, i: F.struct(i.alias("i"), c["p"].alias("prediction"), c["phi"].alias("phi")))
    names, mean = F.array(*[F.lit(c) for c in classes]), F.array(*[F.lit(float(e)) for e in expected])
    out = found.select("row_id", F.explode(by_class).alias("c"))
    named = F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.col("c.phi"))
    return out.select("row_id", names[F.col("c.i")].alias("class"), mean[F.col("c.i")].alias("expected"), F.col("c.prediction").alias("prediction"), named.alias("phi"))


def coalitions(n: int, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Subsets of n features as rows of 0 and 1, and their weights: all of them if there are at most
    `samples`, else drawn by the Shapley kernel's weight of their sizes, each with its complement."""
    if n < 2:
        return np.zeros((0, n)), np.zeros(0)
    if 2**n - 2 <= samples:
        sets = [s for k in range(1, n) for s in combinations(range(n), k)]
        z = np.zeros((len(sets), n))
        for i, s in enumerate(sets):
            z[i, list(s)] = 1
        return z, np.array([(n - 1) / (comb(n, len(s)) * len(s) * (n - len(s))) for s in sets])
    rng = np.random.default_rng(seed)
    size = np.array([(n - 1) / (k * (n - k)) for k in range(1, n)])
    drawn: dict[tuple, int] = {}
    for _ in range(samples // 2):
        one = np.zeros(n, int)
        one[rng.permutation(n)[: rng.choice(np.arange(1, n), p=size / size.sum())]] = 1
        for s in (tuple(one), tuple(1 - one)):
            drawn[s] = drawn.get(s, 0) + 1
    return np.array(list(drawn), float), np.array(list(drawn.values()), float)


def solver(z: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """[feature - 1, subset]: the weighted least squares solution as a linear map of the subsets' values
    less the last feature's share, all features but the last, whose value the sum then gives."""
    free = z[:, :-1] - z[:, -1:]
    return np.linalg.pinv(free.T @ (free * weight[:, None])) @ (free * weight[:, None]).T


def kernel_attribution(model, rows: DataFrame, background: DataFrame, features: list[str], classes: list[str], samples: int = 100, seed: int = 42) -> DataFrame:
    """(row_id, class, feature, phi): Shapley values of the model's probabilities by kernel regression.

    rows, background: (row_id, x array<double>), both of stated bounded size (the work is rows x subsets
    x background rows, spread over tasks; a feature that isn't known comes from the background rows).
    model: anything that adds `probability` to rows with `features`. Spark means the subsets' values and
    sums them up under the regression's coefficients, which are the same for all rows. With at least
    2^n - 2 samples the values are exact. The attributions of a row and class add up to its probability
    less the background's mean."""
    spark, n = rows.sparkSession, len(features)
    z, weight = coalitions(n, samples, seed)
    solved = solver(z, weight) if n > 1 else np.zeros((0, 0))
    every = np.vstack([z, np.zeros(n), np.ones(n)])
    # coefficients of each subset's value in each feature's attribution: phi = solved (v - v0 - z_last (v1 - v0))
    c = np.zeros((n, len(every)))
    if n > 1:
        c[:-1, :-2] = solved
        c[:-1, -2] = -(solved @ (1 - z[:, -1]))
        c[:-1, -1] = -(solved @ z[:, -1])
    c[-1] = -c[:-1].sum(0)
    c[-1, -2] -= 1
    c[-1, -1] += 1
    subsets = spark.createDataFrame([(m.tolist(), k.tolist()) for m, k in zip(every, c.T, strict=True)], "mask array<double>, c array<double>")
    spread = rows.select("row_id", "x").repartition(spark.sparkContext.defaultParallelism * 2)
    mixed = spread.crossJoin(F.broadcast(subsets)).crossJoin(F.broadcast(background.select(F.col("x").alias("b"))))  # each of bounded size
    mixed = mixed.withColumn("features", array_to_vector(F.transform(F.arrays_zip("x", "b", "mask"), lambda e: F.when(e["mask"] > 0, e["x"]).otherwise(e["b"]))))
    p = model.transform(mixed).select("row_id", "c", vector_to_array("probability").alias("p"))
    means = p.groupBy("row_id", "c").agg(*[F.avg(F.col("p")[k]).alias(f"v{k}") for k in range(len(classes))])
    sums = means.groupBy("row_id").agg(*[F.sum(F.col("c")[i] * F.col(f"v{k}")).alias(f"s{i}_{k}") for i in range(n) for k in range(len(classes))])
    cells = F.array(*[F.struct(F.lit(name).alias("class"), F.lit(f).alias("feature"), F.col(f"s{i}_{k}").alias("phi")) for i, f in enumerate(features) for k, name in enumerate(classes)])
    return sums.select("row_id", F.explode(cells).alias("e")).select("row_id", "e.*")


def top_attributions(phi: DataFrame, k: int) -> DataFrame:
    """(class, feature, importance, rk) of (row_id, class, phi map): mean absolute attribution a class."""
    mean = phi.select("class", F.explode("phi").alias("feature", "value")).groupBy("class", "feature").agg(F.avg(F.abs("value")).alias("importance"))
    w = Window.partitionBy("class").orderBy(F.desc("importance"), "feature")  # one row a class and feature
    return mean.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
