"""Stored sizes and measured speed of models, caches' pointers, gaps."""

from __future__ import annotations

import os

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from flowmill.operators import clean as C
from flowmill.operators import metrics as M
from flowmill.operators import models as ML
from flowmill.operators import ranking as R
from flowmill.plans import q_models, registry
from flowmill.sources import bundles, caches


def test_artifact_sizes(spark, tmp_path):
    for name, sizes in {"a": {"x/y/part-0": 10, "meta": 5}, "b c": {"part-0": 7}}.items():
        for file, n in sizes.items():
            (tmp_path / name / file).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name / file).write_bytes(b"1" * n)
    assert {tuple(r) for r in bundles.artifact_sizes(spark, str(tmp_path)).collect()} == {("a", 2, 15), ("b c", 1, 7)}


def test_model_footprint(spark, sf_dir):
    rows = {r["model"]: r for r in registry.QUERIES["model_footprint"](spark, sf_dir).collect()}
    assert set(rows) == {"logistic_regression", "random_forest"}
    # no floor for f1_macro: the table's labels don't depend on its vectors
    assert all(r["rows_per_s"] > 0 and r["p95_ms"] >= r["p50_ms"] and 0 <= r["f1_macro"] <= 1 for r in rows.values())
    assert rows["random_forest"]["size_bytes"] > rows["logistic_regression"]["size_bytes"] > 1000


@pytest.mark.parametrize("name", ["logistic_regression", "random_forest"])
def test_stored_models_score_as_those_in_memory(spark, sf_dir, tmp_path, name):
    train, test = q_models._ready(spark, sf_dir)
    model = ML.fit(name, train, 10)
    model.write().save(f"{tmp_path}/{name}")
    kept = lambda m: {r["row_id"]: (r["y_pred"], r["probability"]) for r in ML.score(m, test).collect()}
    assert kept(PipelineModel.load(f"{tmp_path}/{name}")) == kept(model)
    times = ML.scoring_durations(model, test, 2)
    assert len(times) == 2 and all(ms > 0 and n == test.count() for ms, n in times)


def test_spreads(spark):
    cm = M.confusion_matrix(spark.createDataFrame([(m, y, (y + m * (k == 0)) % 2) for m in (0, 1) for k in range(4) for y in (0, 1)], "model int, y_true int, y_pred int"), [0, 1])
    times = spark.createDataFrame([(0, 2.0, 100.0, 50), (1, 8.0, 25.0, 200)], "model int, p95_ms double, rows_per_s double, size_bytes long")
    got = R.consequences(M.extended_metrics(cm, 0, 0), M.marginals(cm), times, 0).first()
    assert (got["latency_spread"], got["throughput_spread"], got["size_spread"], got["safest"]) == (4.0, 4.0, 4.0, 0)
    assert "size_spread" not in R.consequences(M.extended_metrics(cm, 0, 0), M.marginals(cm), times.drop("size_bytes"), 0).columns


def test_no_model_is_an_error(spark):
    with pytest.raises(ValueError, match="no model"):
        R.require_models(spark.createDataFrame([], "model int, f1_macro double"))


def test_pointers_of_a_cache_name_the_newest_version(spark, tmp_path):
    inputs, path = str(tmp_path / "in"), str(tmp_path / "cache")
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(inputs)
        df, built = caches.load_or_build(spark, path, inputs, lambda x: x)
        assert built and df.count() == 10 * (k + 1)
        df, built = caches.load_or_build(spark, path, inputs, lambda x: x)
        assert not built and df.count() == 10 * (k + 1)
    assert len([f for f in os.listdir(f"{path}/current") if f.endswith(".json")]) == 3
    with pytest.raises(ValueError, match="30 rows, expected 7"):
        caches.load_or_build(spark, path, inputs, lambda x: x, n_rows=7)
    assert caches.load_or_build(spark, path, inputs, lambda x: x)[0].count() == 30


def test_gaps_are_named(spark):
    df = spark.createDataFrame([("a", 1.0, 1), (None, float("nan"), 2), ("c", float("inf"), 3)], "label string, f double, n int")
    assert C.require_no_gaps(df.where("n = 1"), ["label", "f", "n"]).count() == 1
    with pytest.raises(ValueError, match="'label': 1, 'f': 2"):
        C.require_no_gaps(df, ["label", "f", "n"])
    assert C.require_no_gaps(df.where(F.lit(False)), ["f"]).count() == 0
