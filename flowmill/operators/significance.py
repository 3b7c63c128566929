"""Paired significance: exact McNemar p, bootstrap intervals over compressed prediction patterns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written


def _stirling_error(n: int) -> float:
    """log n! minus Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _deviance(x: int, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation near the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, j = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def _two_sided(a: int, b: int) -> float:
    """P of a split at least as uneven as a : b under a fair coin: the term at the split by Loader's
    saddle point, the terms below it by their ratios until the rest is under 1e-17 of the sum."""
    n, k = a + b, min(a, b)
    if not k:
        return min(1.0, 2 * 0.5**n)
    log_p = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n / 2) - _deviance(n - k, n / 2) + 0.5 * math.log(n / (2 * math.pi * k * (n - k)))
    total, last = 1.0, 1.0
    for at in range(0, k, 1 << 16):
        j = np.arange(at, min(k, at + (1 << 16)), dtype=np.float64)
        ratio = (k - j) / (n - k + 1 + j)
        terms = last * np.cumprod(ratio)
        total, last = total + float(terms.sum()), float(terms[-1])
        if last * ratio[-1] <= 1e-17 * total * (1 - ratio[-1]):
            break
    return min(1.0, 2 * math.exp(log_p) * total)


@F.arrow_udf(T.DoubleType())
def _exact_p(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_two_sided(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def binomial_p(counts: DataFrame) -> DataFrame:
    """counts (.., only_leader, only_rival), a few rows, with the exact two-sided p."""
    return counts.withColumn("p", _exact_p("only_leader", "only_rival"))


def separable(p: Column, ci_low: Column, ci_high: Column, alpha: float = 0.05) -> Column:
    """Whether both tests tell two models apart; null where one is unknown."""
    return F.when(p.isNull() | ci_low.isNull() | ci_high.isNull(), None).otherwise((p < alpha) & ((ci_low > 0) | (ci_high < 0)))


def macro_f1(truth: np.ndarray, pred: np.ndarray, weight: np.ndarray) -> float:
    """Macro-F1 over the classes that the weighted rows hold as truth or prediction."""
    some = weight > 0
    labels = np.union1d(truth[some], pred[some])
    t = np.array([weight[truth == x].sum() for x in labels], float)
    p = np.array([weight[pred == x].sum() for x in labels], float)
    c = np.array([weight[(truth == x) & (pred == x)].sum() for x in labels], float)
    return float(np.mean(2 * c / (t + p))) if len(labels) else 0.0


#: Patterns that a task resamples at once.
BUCKET_PATTERNS = 4096


def bootstrap_scores(paired: DataFrame, models: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(rep, one column a model) of macro-F1 over resamples that all models share; rep 0 is the rows as they are.

    Rows are compressed to distinct (truth, predictions) patterns with counts: at most classes to the
    power models + 1, whatever the number of rows. Patterns are dealt to buckets by hash and stay there. A
    replicate's multinomial counts are drawn in two steps: how many rows each bucket gets, from the buckets'
    totals, the same in every task by its seed, and each bucket's patterns given that number. Buckets hand on
    their classes' counts, which Spark adds up.
    """
    patterns = paired.groupBy(F.col("y_true").alias("t"), *[F.col(m).alias(f"p{i}") for i, m in enumerate(models)]).agg(F.count("*").alias("n"))
    patterns = written(patterns, "patterns")
    buckets = max(1, -(-patterns.count() // BUCKET_PATTERNS))
    patterns = patterns.withColumn("bucket", F.pmod(F.xxhash64("t", *[f"p{i}" for i in range(len(models))]), F.lit(buckets)).cast("int"))
    sizes = np.zeros(buckets, np.int64)
    for r in patterns.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        sizes[r["bucket"]] = r["n"]

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own = pdf.sort_values(list(pdf.columns)), int(key[0])
        n, t = pdf["n"].to_numpy(np.int64), pdf["t"].to_numpy()
        drawn = np.empty((replicates + 1, len(n)), np.int64)
        drawn[0] = n
        for rep in range(1, replicates + 1):
            here = np.random.default_rng([seed, rep]).multinomial(sizes.sum(), sizes / sizes.sum())[own]
            drawn[rep] = np.random.default_rng([seed, rep, own]).multinomial(here, n / n.sum())
        out = []
        for i in range(len(models)):
            p = pdf[f"p{i}"].to_numpy()
            for label in np.union1d(t, p):
                counts = [drawn[:, mask].sum(1) for mask in (t == label, p == label, (t == label) & (p == label))]
                out.append(pd.DataFrame({"rep": np.arange(replicates + 1), "model": np.int32(i), "label": int(label), "t": counts[0], "p": counts[1], "c": counts[2]}))
        return pd.concat(out)

    parts = patterns.groupBy("bucket").applyInPandas(draw, "rep long, model int, label long, t long, p long, c long")
    sums = parts.groupBy("rep", "model", "label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("c").alias("c"))
    f1 = F.avg(F.try_divide(2.0 * F.col("c"), F.col("t") + F.col("p")))  # classes that the resample doesn't hold don't count
    scores = sums.groupBy("rep").pivot("model", list(range(len(models)))).agg(f1)
    return scores.select("rep", *[F.coalesce(F.col(str(i)), F.lit(0.0)).alias(m) for i, m in enumerate(models)])


def _interval(value: Column) -> list[Column]:
    resampled = F.when(F.col("rep") > 0, value)  # as many rows as replicates
    return [F.max(F.when(F.col("rep") == 0, value)).alias("f1"), F.percentile(resampled, F.lit(0.025)).alias("ci_low"), F.percentile(resampled, F.lit(0.975)).alias("ci_high")]


def bootstrap_f1(paired: DataFrame, models: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(model, f1, ci_low, ci_high) of macro-F1 over shared resamples."""
    scores = bootstrap_scores(paired, models, replicates, seed).unpivot(["rep"], models, "model", "score")
    return scores.groupBy("model").agg(*_interval(F.col("score")))


def bootstrap_differences(paired: DataFrame, leader: str, rivals: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(rival, d_f1, ci_low, ci_high): how far each rival's macro-F1 is behind the leader's on the same resamples."""
    scores = bootstrap_scores(paired, [leader, *rivals], replicates, seed)
    gaps = scores.select("rep", *[(F.col(leader) - F.col(r)).alias(r) for r in rivals]).unpivot(["rep"], rivals, "rival", "gap")
    return gaps.groupBy("rival").agg(*_interval(F.col("gap"))).withColumnRenamed("f1", "d_f1")
