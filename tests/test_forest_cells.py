"""Forests over cells against forests over rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.operators import forest_cells as C
from flowmill.operators import models as ML


def table(spark, copies):
    rows = spark.range(400 * copies).withColumn("i", F.col("id") % 400)
    rows = rows.selectExpr("id as row_id", "double(i % 20) as a", "double(int(i / 20) % 10) as b", "double(i % 3) as c")
    return rows.withColumn("y", F.expr("cast(a > 9 as int) + cast(b > 6 as int)"))


def test_cells_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "FEW_ROWS", 100)
    found = {k: C.cells(ML.assemble(table(spark, k), ["a", "b", "c"], "y")) for k in (5, 20)}
    sizes = {k: (c.count(), c.agg(F.sum("n")).first()[0]) for k, c in found.items()}
    assert sizes[5][0] == sizes[20][0] <= 400 and sizes[5][1] == 2000 and sizes[20][1] == 8000
    monkeypatch.setattr(C, "SHARED", 100)
    assert C.cells(ML.assemble(table(spark, 5), ["a", "b", "c"], "y")) is None


def test_importance_is_that_of_the_rows(spark, monkeypatch):
    train = ML.assemble(table(spark, 5), ["a", "b", "c"], "y")
    plain = {r["feature"]: r["importance"] for r in ML.forest_importance(train, ["a", "b", "c"], 3).collect()}
    monkeypatch.setattr(C, "FEW_ROWS", 100)
    packed = {r["feature"]: r["importance"] for r in ML.forest_importance(train, ["a", "b", "c"], 3).collect()}
    assert sum(packed.values()) == pytest.approx(1)
    for f, v in plain.items():
        assert packed[f] == pytest.approx(v, abs=0.08)


def test_draws_follow_the_counts(spark):
    found = spark.createDataFrame([(float(i), 0.0, 1.0, 50) for i in range(40)], "b0 double, label double, weight double, n long")
    d = np.array([r["draws"] for r in C.with_draws(found, 100).orderBy("features").collect()])
    again = np.array([r["draws"] for r in C.with_draws(found.repartition(7), 100).orderBy("features").collect()])
    assert (d == again).all() and d.mean() == pytest.approx(50, abs=1) and d.var() == pytest.approx(50, abs=6)


def test_bins_hold_equal_weights():
    assert C.bin_cuts([(1.0, 5.0), (2.0, 1.0)]) == [2.0] and C.bin_cuts([(1.0, 5.0)]) == []
    assert C.bin_cuts([(float(v), 1.0) for v in range(64)]) == [float(v) for v in range(2, 64, 2)]
