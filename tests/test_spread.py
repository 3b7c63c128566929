"""Tables that models read again and again: written once, spread over tasks, explained once a cell."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from flowmill.operators import attribution as A
from flowmill.operators import models as ML
from flowmill.plans import q_models as Q
from flowmill.sources import scratch


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_rows_are_spread_and_ranked_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(scratch, "FIT_ROWS", 50)
    train, test = Q._ready(spark, sf_dir)
    assert train.rdd.getNumPartitions() == min(2 * spark.sparkContext.defaultParallelism, 1 + (train.count() + test.count()) // 50)
    assert "Window" not in _plan(train.select("features")) and train.count() + test.count() == Q.vectors(spark, sf_dir).count()


def test_flow_sides_are_made_once(spark, sf_dir):
    assert "Window" not in _plan(Q._flow_sides(spark, sf_dir))


def test_search_reads_a_written_table(spark, sf_dir, monkeypatch):
    names = []
    monkeypatch.setattr(ML, "spread", lambda df, name: names.append(name) or scratch.spread(df, name), raising=False)
    found = ML.search("logistic_regression", Q._ready(spark, sf_dir)[0], 10, Q.LABELS, 3, 1)
    assert names == ["search-rows"] and found.first()["f1_mean"] > 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_each_cell_is_explained_once(spark, monkeypatch, broadcast):
    made = {}
    monkeypatch.setattr(A, "written", lambda df, name: made.setdefault(name, scratch.written(df, name)), raising=False)
    if not broadcast:
        monkeypatch.setattr(A, "BROADCAST_CELLS", 0, raising=False)
    rows = spark.range(600).selectExpr("id as row_id", "double(id % 7) as a", "double(id % 3) as b", "double((id % 7 > 3) and (id % 3 > 0)) as label")
    model = ML.fit("random_forest", ML.assemble(rows, ["a", "b"], "label"), 2, numTrees=5)
    ready = ML.assemble(rows, ["a", "b"], "label")
    got = {(r["row_id"], r["class"]): (r["phi"]["a"], r["phi"]["b"]) for r in A.tree_attribution(PipelineModel(stages=model.stages), ["0", "1"], ready, ["a", "b"], "row_id").collect()}
    assert len(got) == 1200 and made["cell-phi"].count() <= 21
    groups, _, trees = A.forest_paths(A.forest_nodes(model.stages[-1]).toPandas())
    x = np.array([[i % 7, i % 3] for i in range(600)], float)
    phi = A.tree_values(groups, trees, x, 2)
    for (i, c), v in got.items():
        assert v == pytest.approx(tuple(phi[i, :, int(c)]), abs=1e-12)
