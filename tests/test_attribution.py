"""Attributions against sums over all subsets."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowmill.operators import attribution as A

NAMES = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.integers(0, 6, 6)], float(rng.integers(1, 4))) for i in range(300)]
    label = lambda x: float((x[0] + x[1] * x[2] > 8) + (x[3] > x[4]))
    df = spark.createDataFrame([(i, x, label(x), w) for i, x, w in data], "row_id long, x array<double>, label double, weight double")
    return df.withColumn("features", array_to_vector("x")).cache()


def shapley(value, n):
    """[feature, class] of a set function."""
    out = np.zeros((n, len(value(()))))
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for k in range(n):
            for s in combinations(others, k):
                out[i] += factorial(k) * factorial(n - 1 - k) / factorial(n) * (value((*s, i)) - value(s))
    return out


def known(tree, x, subset, i=0):
    """A tree's prediction when only `subset` is known, node by node."""
    r = tree[i]
    if r.left < 0:
        return np.array(r.stats) / sum(r.stats)
    if r.feature in subset:
        return known(tree, x, subset, r.left if x[r.feature] <= r.threshold else r.right)
    return sum(known(tree, x, subset, c) * sum(tree[c].stats) for c in (r.left, r.right)) / sum(r.stats)


def test_forest_equals_all_subsets(rows):
    model = RandomForestClassifier(numTrees=5, maxDepth=6, seed=5, weightCol="weight").fit(rows)
    nodes = A.forest_nodes(model).toPandas()
    trees = [{r.id: r for r in t.itertuples()} for _, t in nodes.groupby("tree")]
    got = A.tree_attribution(PipelineModel([model]), ["a", "b", "c"], rows, NAMES, "row_id").collect()
    assert len(got) == 900
    cells = {(r["row_id"], r["class"]): r for r in got}
    for r in got:
        assert r["expected"] + sum(r["phi"].values()) == pytest.approx(r["prediction"], abs=1e-9)
    for row in rows.limit(12).collect():
        want = sum(shapley(lambda s, t=t, x=row["x"]: known(t, x, s), 6) for t in trees) / len(trees)
        for k, c in enumerate("abc"):
            assert [cells[row["row_id"], c]["phi"][f] for f in NAMES] == pytest.approx(want[:, k].tolist(), abs=1e-9)


def test_path_weights_of_deep_paths():
    rng = np.random.default_rng(4)
    holds, share = (rng.random((4, 5)) < 0.5).astype(float), rng.random((4, 5))
    got = A.path_weights(holds, share)
    for o, z, g in zip(holds, share, got, strict=True):
        want = shapley(lambda s, o=o, z=z: np.array([np.prod([o[j] if j in s else z[j] for j in range(5)])]), 5)
        assert g.tolist() == pytest.approx(want[:, 0].tolist())
    deep = A.path_weights(np.ones((1, 30)), np.full((1, 30), 0.01))  # twice as deep as the deepest forest
    assert deep.sum() == pytest.approx(1 - 0.01**30)


def test_kernel_equals_all_subsets(rows):
    model = LogisticRegression(maxIter=20).fit(rows)
    few, back = rows.limit(7).select("row_id", "x"), rows.where("row_id >= 280").select("row_id", "x")
    got = {(r["row_id"], r["class"], r["feature"]): r["phi"] for r in A.kernel_attribution(model, few, back, NAMES, ["a", "b", "c"]).collect()}
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    others = np.array([r["x"] for r in back.collect()])
    for row in few.collect():

        def value(s, x=np.array(row["x"])):
            mixed = others.copy()
            mixed[:, list(s)] = x[list(s)]
            m = mixed @ w.T + b
            e = np.exp(m - m.max(1, keepdims=True))
            return (e / e.sum(1, keepdims=True)).mean(0)

        want = shapley(value, 6)
        for k, c in enumerate("abc"):
            assert [got[row["row_id"], c, f] for f in NAMES] == pytest.approx(want[:, k].tolist(), abs=1e-9)


def test_sampled_coalitions_keep_the_sum(rows):
    z, w = A.coalitions(12, 100, 1)
    assert len(z) == len({tuple(r) for r in z}) and w.sum() == 100 and set(z.sum(1)) <= set(range(1, 12))
    model = LogisticRegression(maxIter=20).fit(rows)
    few, back = rows.limit(3).select("row_id", "x"), rows.limit(20).select("row_id", "x")
    phi = A.kernel_attribution(model, few, back, NAMES, ["a", "b", "c"], samples=40).groupBy("row_id", "class").agg(F.sum("phi").alias("s"))
    p = lambda df: df.withColumn("features", array_to_vector("x"))
    mean = np.mean([r[0].toArray() for r in model.transform(p(back)).select("probability").collect()], 0)
    own = {r["row_id"]: r["probability"].toArray() for r in model.transform(p(few)).collect()}
    for r in phi.collect():
        k = "abc".index(r["class"])
        assert r["s"] == pytest.approx(own[r["row_id"]][k] - mean[k], abs=1e-9)
