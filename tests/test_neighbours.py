"""Neighbours by cells against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.operators import imbalance as I
from flowmill.operators import neighbours as N


def brute(q, x, k):
    out = {}
    for i, v in q:
        d = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), j) for j, w in x if j != i)
        if d:
            out[i] = [j for _, j in d[:k]]
    return out


def points(spark, rows):
    return spark.createDataFrame([(i, [float(c) for c in v], i % 3) for i, v in rows], "row_id long, x array<double>, y int")


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(0, 6, 3)) for i in range(300)]  # many ties and copies
    rows += [(1000 + i, [50, 50, 50]) for i in range(40)] + [(2000, [-90, 0, 0])]
    if small:
        monkeypatch.setattr(N, "BLOCK_ROWS", 16)
        monkeypatch.setattr(N, "CELL_ROWS", 10)
    df = points(spark, rows)
    got = {r["row_id"]: [e["o"] for e in r["n"]] for r in N.nearest(N.usable(df, F.col("y")), N.usable(df, F.col("y")), 5).collect()}
    assert got == brute(rows, rows, 5)
    some = {r["row_id"]: [e["o"] for e in r["n"]] for r in N.nearest(N.usable(df.where("y = 0"), F.lit(True)), N.usable(df.where("y = 1"), F.lit(True)), 3).collect()}
    assert some == brute([r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 3 == 1], 3)


def test_clusters_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 40)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 10
    rows = [(i, centres[i % 40] + rng.normal(size=16)) for i in range(2000)]
    own = N.usable(points(spark, rows), F.col("y"))
    found, visits, cells = N.search(own, own, 5)
    pairs = visits.join(cells.blocks.select("cell", "part", (F.octet_length("ids") / 8).alias("n")), ["cell", "part"]).agg(F.sum(F.octet_length("ids") / 8 * F.col("n"))).first()[0] or 0
    at_home = sum(int(n) ** 2 for n in cells.count)
    assert (pairs + at_home) / 2000**2 < 0.2
    assert {r["row_id"]: [e["o"] for e in r["n"]] for r in found.collect()} == brute(rows, rows, 5)


def test_odd_tables(spark):
    df = points(spark, [(1, [1.0])]).unionByName(spark.createDataFrame([(None, [1.0], 1), (2, None, 1)], "row_id long, x array<double>, y int"))
    own = N.usable(df, F.col("y"))
    assert N.nearest(own, own, 3).count() == 0
    assert N.nearest(own, own.where("false"), 3).count() == 0
    assert I.nearest_votes(df.where("false"), "y", 3).count() == 0


def test_queries_of_many_cells_share_a_block(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 20)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=24)) for i in range(600)]  # no clusters: each query meets most cells
    own = N.usable(points(spark, rows), F.col("y"))
    _, visits, cells = N.search(own, own, 5)
    assert visits.count() <= 4 * len(cells.centres)


@pytest.fixture
def unclustered(spark, monkeypatch):
    """2,000 rows of 24 numbers (0.4 MB) in 51 cells, each of which meets most cells."""
    monkeypatch.setattr(N, "CELL_ROWS", 40)
    rng = np.random.default_rng(10)
    return [(i, rng.normal(size=24)) for i in range(2000)]


def test_visits_are_not_broadcast(spark, unclustered):
    more = unclustered + [(i + 2000, 1.1 * v) for i, v in unclustered]
    rows = N.usable(points(spark, more), F.col("y"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")  # a table of the visits has more, though fewer rows than the blocks that they meet
    try:
        got = {r["row_id"]: [e["o"] for e in r["n"]] for r in N.nearest(rows.where("row_id % 16 = 0"), rows, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(got) == 250
    assert {i: got[i] for i in range(0, 4000, 160)} == brute(more[::160], more, 3)


def test_queries_are_sent_once_a_group(spark, unclustered):
    own = N.usable(points(spark, unclustered), F.col("y"))
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: store.executorList(False).apply(0).totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        assert N.nearest(own, own, 3).count() == 2000
        assert shuffled() - before < 8e6  # a copy of the queries a cell has 20 MB
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("kind", ["floats", "few values", "far from zero", "tiny", "huge", "near copies"])
def test_blocks_compare_exactly(kind):
    rng = np.random.default_rng(11)
    for n, dims, k in ((1, 3, 2), (5, 2, 5), (90, 6, 3), (300, 17, 4)):
        y = rng.integers(0, 3, (n, dims)).astype(float) if kind == "few values" else rng.normal(size=(n, dims))
        y = y * {"tiny": 1e-30, "huge": 1e25}.get(kind, 1) + (1e9 if kind == "far from zero" else 0)
        if kind == "near copies":
            y[n - n // 2 :] = y[: n // 2] * (1 + 1e-14)
        ids, cut = np.arange(n) * 7, n // 3
        held = N.Held([(ids[a:b], y[a:b], a) for a, b in ((0, cut), (cut, n)) if b > a], y.mean(0))
        most = np.full(n, np.inf)
        for _ in range(2):  # without and with bounds
            d, o, place = held.closest(ids, y, most, np.zeros((n, len(held.blocks))), 0.0, k)
            for i in range(n):
                apart = ((y - y[i]) ** 2).sum(1)
                want = [j for j in np.lexsort((ids, apart)) if j != i][:k]
                assert place[i][: len(want)].tolist() == want and o[i][: len(want)].tolist() == ids[want].tolist()
            most = d[:, -1]
