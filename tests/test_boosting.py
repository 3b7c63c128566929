"""Softmax boosting against brute force, and against one-vs-rest on held-out rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowmill.operators import boosting as B
from flowmill.operators import models as ML


def rows_of(spark, n, seed, noise=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    label = np.where(x[:, 0] * x[:, 1] > 0.2, 2, np.where(x[:, 2] + noise * rng.normal(size=n) > 0, 1, 0))
    return spark.createDataFrame([(i, [float(v) for v in r], int(k), 1.0) for i, (r, k) in enumerate(zip(x, label, strict=True))], "row_id long, x array<double>, label int, weight double")


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    s, label, w = rng.normal(size=(5, 3)), rng.integers(0, 3, 5), rng.random(5)
    loss = lambda s: -(np.log(B.softmax(s)[np.arange(5), label]) * w).sum()
    g, h = B.gradients(s, label, w)
    for i in range(5):
        for k in range(3):
            d = np.zeros_like(s)
            d[i, k] = 1e-6
            assert g[i, k] == pytest.approx((loss(s + d) - loss(s - d)) / 2e-6, abs=1e-6)
    assert (h > 0).all()


def grown(bins, g, h, w, node, depth, out):
    """A node's best split and value by trying each cut of each feature, row by row."""
    out[node] = (-1, 0, -0.5 * g.sum() / (h.sum() + 1.0))
    best = (1e-9, None)
    for f in range(bins.shape[1]):
        for c in range(7):
            left = bins[:, f] <= c
            if left.all() or not left.any() or h[left].sum() < 1 or h[~left].sum() < 1:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1.0)
            if gain > best[0] + 1e-9:
                best = (gain, (f, c))
    if best[1] is None or depth == 0:
        return
    f, c = best[1]
    out[node] = (f, c, out[node][2])
    left = bins[:, f] <= c
    for side, child in ((left, 2 * node + 1), (~left, 2 * node + 2)):
        grown(bins[side], g[side], h[side], w[side], child, depth - 1, out)


def test_a_round_equals_brute_force(spark):
    rows = rows_of(spark, 400, 2).withColumn("weight", 1 + F.col("row_id") % 3 / 2).repartition(5)
    model = B.fit(rows, 3, rounds=1, depth=3, rate=0.5, bins=8)
    data = rows.toPandas()
    bins = model.bins(np.stack(data["x"]))
    g, h = B.gradients(np.tile(model.start, (400, 1)), data["label"].to_numpy(), data["weight"].to_numpy())
    for k in range(3):
        want: dict = {}
        grown(bins.astype(int), g[:, k], h[:, k], data["weight"].to_numpy(), 0, 3, want)
        t = model.trees[0][k]
        for node, (f, c, v) in want.items():
            assert (t.feature[node], t.value[node]) == (f, pytest.approx(v))
            assert f < 0 or t.cut[node] == c


def test_loss_falls_and_beats_one_vs_rest(spark):
    train, test = rows_of(spark, 1500, 3), rows_of(spark, 500, 4)
    model = B.fit(train, 3, rounds=8, depth=3, rate=0.4)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:], strict=False))
    scored = B.predict(model, test, ["row_id", "label"])
    vectors = lambda df: df.withColumn("features", array_to_vector("x")).withColumn("label", F.col("label").cast("double"))
    other = ML.score(ML.fit("boosted_trees", vectors(train), 3, maxIter=8, maxDepth=3), vectors(test))
    assert B.log_loss(scored) < B.log_loss(other)
    assert scored.where("y_pred = label").count() > 400


def test_awkward_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 0, 1.0), (2, [1.0, float("nan")], 1, 1.0), (3, None, 0, 1.0), (4, [None, 1.0], 1, 1.0), (5, [0.0, 1.0], None, 1.0), (6, [9.0, 9.0], 1, 0.0)], "row_id long, x array<double>, label int, weight double")
    model = B.fit(rows, 3, rounds=1, depth=2, least=0.0)
    got = {r["row_id"]: r for r in B.predict(model, rows, ["row_id"]).collect()}
    assert got[3]["y_pred"] is None and got[3]["probability"] is None and got[4]["y_pred"] is not None and len(got) == 6
