"""Resamples drawn bucket by bucket are those drawn at once."""

from __future__ import annotations

import numpy as np
import pytest

from flowmill.operators import significance as S


@pytest.mark.parametrize("size", [1, 5, 4096])
def test_distribution_doesn_t_depend_on_buckets(spark, monkeypatch, size):
    monkeypatch.setattr(S, "BUCKET_PATTERNS", size)
    rows = [(i, i % 3, i % 3 if i % 4 else (i + 1) % 3, i % 3 if i % 7 else (i // 7 + 1) % 3) for i in range(600)]
    paired = spark.createDataFrame(rows, "row_id long, y_true int, p0 int, p1 int")
    got = {r["rep"]: (r["p0"], r["p1"]) for r in S.bootstrap_scores(paired, ["p0", "p1"], 400).collect()}
    assert len(got) == 401
    t, p = np.array([r[1] for r in rows]), np.array([[r[2], r[3]] for r in rows])
    one = np.ones(600)
    assert got[0] == pytest.approx([S.macro_f1(t, p[:, k], one) for k in (0, 1)])
    rng = np.random.default_rng(1)
    want = np.array([[S.macro_f1(t, p[:, k], w) for k in (0, 1)] for w in rng.multinomial(600, np.full(600, 1 / 600), 400)])
    have = np.array([got[i] for i in range(1, 401)])
    for k in (0, 1):
        assert have[:, k].mean() == pytest.approx(want[:, k].mean(), abs=4 * want[:, k].std() / 20)
        assert have[:, k].std() == pytest.approx(want[:, k].std(), rel=0.2)
    assert np.corrcoef(have.T)[0, 1] == pytest.approx(np.corrcoef(want.T)[0, 1], abs=0.15)  # the models share resamples
