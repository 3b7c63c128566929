"""The early-stopped network."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.operators import network as N


def rows_of(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    label = (x[:, 0] ** 2 + x[:, 1] ** 2 > 1.5).astype(int) + (x[:, 2] > 1.2)
    return spark.createDataFrame([(i, [float(v) for v in r], int(k), 1.0) for i, (r, k) in enumerate(zip(x, label, strict=True))], "row_id long, x array<double>, label int, weight double")


def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(1)
    sizes = [3, 5, 4, 3]
    x, label, w = rng.normal(size=(7, 3)), rng.integers(0, 3, 7), rng.random(7)
    v = N.flat(N.initial(sizes, 2))
    _, g = N.gradient(N.shaped(v, sizes), x, label, w)
    for i in range(len(v)):
        d = np.zeros_like(v)
        d[i] = 1e-6
        up, down = (N.gradient(N.shaped(v + s * d, sizes), x, label, w)[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_learns_and_stops_early(spark):
    train, test = rows_of(spark, 1200, 3), rows_of(spark, 400, 4)
    model = N.fit(train, 3, hidden=(24, 12), rate=0.01, epochs=200, patience=8, tasks=3)
    assert len(model.losses) < 200 and model.losses[-1] < 0.6 * model.losses[0]
    assert max(model.accuracies) - max(model.accuracies[:-8]) <= 1e-4
    scored = N.predict(model, test, ["row_id", "label"])
    assert scored.where("y_pred = label").count() > 340


def test_weights_count_in_the_loss(spark):
    rows = rows_of(spark, 400, 5)
    fit = lambda df: N.fit(df, 3, hidden=(8,), rate=0.01, epochs=12, tasks=2)
    plain, heavy = fit(rows), fit(rows.withColumn("weight", F.when(F.col("label") == 2, 20.0).otherwise(1.0)))
    share = lambda m: N.predict(m, rows.where("label = 2"), ["row_id"]).where("y_pred = 2").count()
    assert share(heavy) > share(plain)


def test_odd_rows(spark):
    odd = spark.createDataFrame([(9001, None, 1, 1.0), (9002, [1.0, None, 1.0], 1, 1.0), (9003, [float("nan")] * 3, 0, 1.0), (9004, [1.0] * 3, None, 1.0)], "row_id long, x array<double>, label int, weight double")
    model = N.fit(rows_of(spark, 60, 6).unionByName(odd), 3, hidden=(4,), epochs=2, tasks=2)
    got = {r["row_id"]: r["y_pred"] for r in N.predict(model, odd, ["row_id"]).collect()}
    assert got[9001] is None and got[9002] is None and got[9003] is None and got[9004] is not None
