"""Search under a budget, and resampling inside the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowmill.operators import imbalance as I
from flowmill.operators import models as ML
from flowmill.operators import tuning as T


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 3))
    data = [(i, [float(v) for v in r], float(int(r[0] > 0) + int(r[1] > 0.8)), i % 3 if i % 11 else None) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "row_id long, x array<double>, label double, fold int").withColumn("features", array_to_vector("x")).withColumn("weight", F.lit(1.0)).cache()


GRID = [{"C": c, "tol": 1e-3} for c in (1e-4, 1.0, 100.0)]


def test_same_winner_as_the_serial_search(rows):
    objective = T.macro_f1([0, 1, 2])
    serial = []
    for p in GRID:
        serial.append(np.mean([objective(ML.score(ML.fit("logistic_regression", rows.where(f"coalesce(fold <> {k}, true)"), 3, **p), rows.where(f"fold = {k}"))) for k in range(3)]))
    for parallel in (1, 3):
        table, best = T.tune("logistic_regression", rows, 3, 3, 3, objective, parallel=parallel, params=GRID)
        assert best == GRID[int(np.argmax(serial))]
        for r in table.collect():
            assert r["status"] == "dropped" or r["score_mean"] == pytest.approx(serial[r["candidate"]])


def test_failing_candidates_fall_back_to_defaults(rows):
    table, best = T.tune("logistic_regression", rows, 3, 2, 2, T.macro_f1([0, 1, 2]), params=[{"tol": "x"}, {"maxIter": -1}])
    assert best == {} and {r["status"] for r in table.collect()} == {"failed"}


def test_budget_ends_the_search(rows):
    table, best = T.tune("random_forest", rows, 3, 3, 6, T.macro_f1([0, 1, 2]), budget=0.5, parallel=2)
    assert "late" in {r["status"] for r in table.collect()} and (best == {} or best in T.candidates("random_forest", 6))


def test_f_beta(spark):
    scored = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "label int, y_pred int")
    assert T.f_beta(1, 2.0)(scored) == pytest.approx(5 * (2 / 3) * (2 / 3) / (4 * 2 / 3 + 2 / 3))
    assert T.f_beta(7)(scored) == 0.0


def test_state_drops_only_what_cannot_win():
    s = T.Search(2, 2)
    s.scores[0] = [0.9, 0.9]
    s.scores[1] = [0.7, None]
    assert not s.can_win(1) and s.best() == 0
    s.scores[1] = [0.8, None]
    assert s.can_win(1)


@pytest.mark.parametrize("strategy", ["smote", "borderline_smote", "smote_enn"])
def test_target_class_is_raised(rows, strategy):
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    want = -(-max(n.values()) * 8 // 10)
    grown = I.resample(rows.select("row_id", "x", "label"), "label", 2.0, 0.8, strategy).cache()
    own = grown.where("label = 2").count()
    assert grown.count() == grown.select("row_id").distinct().count()
    if strategy == "smote_enn":
        assert n[2.0] <= own <= want and grown.where("row_id >= 0").count() < 240
    else:
        assert own == want and grown.where("row_id >= 0").count() == 240
    made = np.array([r["x"] for r in grown.where("row_id < 0").collect()])
    old = np.array([r["x"] for r in rows.where("label = 2").collect()])
    assert (made >= old.min(0) - 1e-9).all() and (made <= old.max(0) + 1e-9).all()


def test_pipeline_resamples_training_rows_only(rows):
    df = rows.select("row_id", F.col("label").cast("string").alias("y"), *[F.col("x")[i].alias(f"a{i}") for i in range(3)])
    model, classes = ML.fit_pipeline("logistic_regression", df, ["a0", "a1", "a2"], "y", "row_id", imbalance="smote", target="2.0", ratio=0.9)
    plain, _ = ML.fit_pipeline("logistic_regression", df, ["a0", "a1", "a2"], "y", "row_id", imbalance="none")
    hits = lambda m: ML.predict(m, classes, df.where("y = '2.0'"), ["a0", "a1", "a2"], ["row_id"]).where("y_pred = '2.0'").count()
    assert hits(model) >= hits(plain) and ML.predict(model, classes, df, ["a0", "a1", "a2"], ["row_id"]).count() == 240
