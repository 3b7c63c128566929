"""Importances of forests over cells: rows that agree in label, weight and every feature's bin are one row with a count.

A forest sees features by their bins only, so a tree grown on a cell of n rows is the tree grown on the n
rows. Spark ML would draw a Poisson(1) number of copies of each row for each tree; of a cell's n rows
together it draws Poisson(n), which is what is drawn here. The trees are fitted by Spark ML, one a
fit, since each has weights of its own; after the scans that make the cells, the work no longer depends on the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import removed, written

#: Bins of a feature (Spark ML's default); distinct values up to which each is weighed, ranges of a feature with more.
BINS, VALUES, RANGES = 32, 5000, 2048
#: Up to so many rows a forest is fitted on them; beyond it on cells, if so many rows share one on average.
FEW_ROWS, SHARED = 1_000_000, 4

#: Cells of a partition that a tree is fitted on: trees are fitted side by side, so that few large tasks are cheaper.
FIT_ROWS = 100_000


def bin_cuts(values: list[tuple[float, float]], bins: int = BINS) -> list[float]:
    """Lower bounds of all bins but the first, of ascending (value, weight): every value is a bin if there are
    at most `bins`, else their weights are near equal, by the rule that Spark ML applies to its sample."""
    if len(values) <= bins:
        return [v for v, _ in values[1:]]
    stride = sum(w for _, w in values) / bins
    cuts, so_far, target = [], values[0][1], stride
    for v, w in values[1:]:
        if abs(so_far - target) < abs(so_far + w - target):
            cuts.append(v)
            target += stride
        so_far += w
    return cuts


def _bucketed(df: DataFrame, cuts: dict[str, list[float]], prefix: str) -> DataFrame:
    """df with the bin of each column that has cuts (x < the first: 0)."""
    cuts = {c: v for c, v in cuts.items() if v}
    if not cuts:
        return df
    inf = float("inf")
    return Bucketizer(inputCols=list(cuts), outputCols=[prefix + c for c in cuts], splitsArray=[[-inf, *v, inf] for v in cuts.values()]).transform(df)


def _cuts(wide: DataFrame, names: list[str], distinct: dict[str, int]) -> dict[str, list[float]]:
    many = [c for c in names if distinct[c] > VALUES]
    q = wide.agg(*[F.percentile_approx(c, [k / RANGES for k in range(1, RANGES)], 10_000).alias(c) for c in many]).first() if many else {}
    ranged = _bucketed(wide, {c: sorted({v for v in q[c] if v > float("-inf")}) for c in many}, "_r_")
    cell = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"_r_{c}" if f"_r_{c}" in ranged.columns else c).alias("k"), F.col(c).alias("v")) for c in names])
    weighed = ranged.select("weight", F.explode(cell).alias("e")).groupBy("e.c", "e.k").agg(F.min("e.v").alias("v"), F.sum("weight").alias("w"))
    found: dict[str, list] = {c: [] for c in names}
    for r in weighed.collect():  # about VALUES rows a feature at most
        found[r["c"]].append((r["v"], r["w"]))
    return {c: bin_cuts(sorted(v)) for c, v in found.items()}


def cells(train: DataFrame) -> DataFrame | None:
    """(b0, b1, ..., label, weight, n) of train (features, label, weight), None if it has few rows or the cells would be almost as many."""
    first = train.select("features").first()
    if first is None:
        return None
    names = [f"b{j}" for j in range(len(first[0]))]
    x = train.select(vector_to_array("features").alias("x"), "label", "weight")
    wide = x.select("label", "weight", *[F.col("x")[j].alias(c) for j, c in enumerate(names)])
    about = wide.agg(F.count("*").alias("n"), *[F.approx_count_distinct(c).alias(c) for c in names]).first()
    if about["n"] <= FEW_ROWS:
        return None
    binned = _bucketed(wide, _cuts(wide, names, about.asDict()), "_b_")
    bins = [F.col(f"_b_{c}").alias(c) if f"_b_{c}" in binned.columns else F.lit(0.0).alias(c) for c in names]
    keyed = binned.select(*bins, "label", "weight")
    if keyed.agg(F.approx_count_distinct(F.xxhash64(*keyed.columns))).first()[0] * SHARED > about["n"]:
        return None
    return keyed.groupBy(*keyed.columns).agg(F.count("*").alias("n"))


def with_draws(found: DataFrame, trees: int, seed: int = 42) -> DataFrame:
    """(features, label, weight, draws): a Poisson(n) number for each tree, that depends on seed and cell alone."""
    key = [c for c in found.columns if c != "n"]
    kept = found.select(F.array(*key[:-2]).alias("bins"), "label", "weight", "n", F.xxhash64(*key).alias("key"))

    def draw(batches):
        for pdf in batches:
            drawn = [np.random.default_rng([seed, k % (1 << 64)]).poisson(n, trees).astype(np.int64) for k, n in zip(pdf["key"].tolist(), pdf["n"], strict=True)]
            yield pdf.drop(columns=["key", "n"]).assign(draws=drawn)

    drawn = kept.mapInPandas(draw, "bins array<double>, label double, weight double, draws array<long>")
    return drawn.withColumn("features", array_to_vector("bins")).drop("bins")


def importance(found: DataFrame, grow: Callable[[DataFrame, int], np.ndarray], trees: int = 100, seed: int = 42, parallel: int = 12) -> np.ndarray:
    """The mean of the trees' importances. grow: (features, label, weight) rows and a seed to one tree's importances, that add up to 1 or 0."""
    spark = found.sparkSession
    stored = written(with_draws(found, trees, seed), "forest-cells")
    drawn = stored.repartition(1 + stored.count() // FIT_ROWS).cache()
    drawn.count()

    def one(t: int) -> np.ndarray:
        own = drawn.select("features", "label", (F.col("weight") * F.col("draws")[t]).alias("weight")).where("weight > 0")
        return grow(own, seed + t)

    with ThreadPoolExecutor(parallel) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(one), t) for t in range(trees)]
        total = np.sum([j.result() for j in jobs], axis=0)
    drawn.unpersist()
    removed(stored)
    return total / total.sum() if total.sum() > 0 else total
