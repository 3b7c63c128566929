"""Ways of computing that must give the same rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.operators import profile, ranks
from flowmill.sources import captures


def test_quantiles_of_few_and_of_many_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i % 3 if i % 7 else None, float(v) if i % 5 else None, float(i % 4), float("nan") if i % 50 == 0 else float(i)) for i, v in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame([*rows, (9, None, None, None)], "g int, a double, b double, c double")
    for by in (None, ["g"]):
        got = []
        for limit in (0, 10_000):
            monkeypatch.setattr(ranks, "FEW_ROWS", limit)
            q = ranks.quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 0.95, 1.0], by).collect()
            got.append({(r["g"] if by else 0, r["column"]): r["q"] for r in q})
        assert got[0].keys() == got[1].keys() and len(got[0]) == (15 if by else 3)
        for key, q in got[0].items():
            assert q == pytest.approx(got[1][key], nan_ok=True) or all(v is None for v in q + got[1][key])


def test_bitmaps_choose_as_a_semi_join(spark, monkeypatch):
    positions = [0, 1, 2, 7, 8, 9, 32767, 32768, 32769, 65535, 65536, 65537, 10**10, None]
    df = spark.createDataFrame([(s, p, i) for i, (s, p) in enumerate((s, p) for s in ("a", "b", None) for p in positions)], "f string, p long, v int").withColumn("_source", F.lit(1))
    chosen = spark.createDataFrame([("a", 0), ("a", 2), ("a", 8), ("a", 32768), ("a", 32768), ("b", 1), ("b", 65536), ("b", 10**10), ("c", 5), ("a", None), (None, 7)], "f string, p long")
    want = sorted(r["v"] for r in df.join(chosen, ["f", "p"], "left_semi").collect())
    for limit in (0, 100):
        monkeypatch.setattr(captures, "BROADCAST_BITMAPS", limit)
        got = captures.materialize_rows(df, chosen, "f", "p")
        assert got.columns == ["f", "p", "v", "_source"] and sorted(r["v"] for r in got.collect()) == want
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().toString()


def test_correlations_of_78_columns_with_gaps(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 78)) * 10.0 ** rng.integers(-3, 6, 78) + 1e6
    x[:, 5] = x[:, 4] * 2 + 1
    x[:, 7] = 3.0
    gone = rng.random(x.shape) < 0.1
    names = [f"c{i}" for i in range(78)]
    df = spark.createDataFrame([[None if g else float(v) for v, g in zip(r, m, strict=True)] for r, m in zip(x, gone, strict=True)], ", ".join(f"{n} double" for n in names)).repartition(5)
    r = {(p["a"], p["b"]): p["r"] for p in profile.correlation_pairs(df, names).collect()}
    assert len(r) == 78 * 77 // 2
    for i, j in ((0, 1), (4, 5), (3, 70), (5, 7), (76, 77)):
        both = ~gone[:, i] & ~gone[:, j]
        want = None if 7 in (i, j) else np.corrcoef(x[both, i], x[both, j])[0, 1]
        assert r[names[i], names[j]] == (None if want is None else pytest.approx(want, abs=1e-7))
    assert all(v is None for v in (p["r"] for p in profile.correlation_pairs(df.limit(0), names[:3]).collect()))
