"""Profiles: every statistic of many columns in one aggregation, then unpivoted."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import finite_or_null
from .ranks import quantiles, same_groups


def stats_by_column(df: DataFrame, columns: list[str], stats: dict, by: list[str] | None = None) -> DataFrame:
    """(by..., column, one column a statistic): stats maps names to functions of a Column. One pass."""
    by = by or []
    wide = df.groupBy(*by).agg(*[F.struct(*[f(F.col(c)).alias(k) for k, f in stats.items()]).alias(c) for c in columns])
    long = wide.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("e"))
    return long.select(*by, "e.column", "e.s.*")


def is_missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return stats_by_column(df, columns, {"missing": lambda c: F.count_if(is_missing(c)), "infinite": lambda c: F.count_if(F.abs(c) == float("inf"))})


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def value_counts(df: DataFrame, label: str, categories: DataFrame) -> DataFrame:
    """(label, n) of every category, absent ones with 0."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return categories.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def describe_dataset(df: DataFrame, numeric: list[str], label: str, key: list[str]) -> DataFrame:
    """One row: rows, missing and infinite cells of numeric columns, labels, rows that repeat another
    in `key` (numbers made comparable first)."""
    per = missing_counts(df, numeric).agg(F.sum("missing").alias("missing_cells"), F.sum("infinite").alias("infinite_cells"))
    shape = df.agg(F.count("*").alias("n_rows"), F.count_distinct(label).alias("n_labels"))
    norm = {c for c in key if c in numeric}
    kinds = df.select(*[finite_or_null(F.col(c)).alias(c) if c in norm else F.col(c) for c in key]).groupBy(*key).agg(F.count("*").alias("_n"))
    repeats = kinds.agg(F.sum(F.col("_n") - 1).alias("duplicate_rows"))
    return shape.join(F.broadcast(per)).join(F.broadcast(repeats))


def dataset_summary(df: DataFrame, numeric: list[str], label: str, key: list[str], top: int = 5) -> DataFrame:
    """(metric, name, value) of everything describe_dataset() counts, and the columns of each type, the
    `top` columns with most missing cells, the numeric columns with infinite ones, rows a label."""
    one = describe_dataset(df, numeric, label, key)
    totals = one.unpivot([], one.columns, "metric", "value").select("metric", F.lit("").alias("name"), F.col("value").cast("long").alias("value"))
    kinds = [k for _, k in df.dtypes]
    types = df.sparkSession.createDataFrame([("type", k, kinds.count(k)) for k in sorted(set(kinds))], "metric string, name string, value long")  # a row a type
    cells = missing_counts(df, numeric)
    missing = top_k(cells, "missing", top, "column").select(F.lit("missing"), "column", "missing")
    infinite = cells.where("infinite > 0").select(F.lit("infinite"), "column", "infinite")
    labels = df.groupBy(F.coalesce(F.col(label), F.lit("")).alias("name")).agg(F.count("*").alias("value")).select(F.lit("label").alias("metric"), "name", "value")
    return totals.union(types).union(missing).union(infinite).union(labels)


def moments(c: Column) -> dict[str, Column]:
    return {"n": F.count(c), "s": F.sum(c), "ss": F.sum(c * c)}


def _comoments(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """[6, a, b] of a batch's rows where both columns are known: rows, means of a and b, variations of a
    and b, covariation."""
    m = known.astype(float)
    n = m.T @ m
    with np.errstate(invalid="ignore", divide="ignore"):
        shift = np.where(m.sum(0) > 0, np.where(known, x, 0).sum(0) / m.sum(0), 0)
        z = np.where(known, x - shift, 0)  # near zero, so that sums of squares keep their digits
        s, ss = z.T @ m, (z * z).T @ m
        mean = np.where(n > 0, s / n, 0)
        v = ss - s * mean
        c = z.T @ z - s * mean.T
    return np.stack([n, mean + shift[:, None], mean.T + shift[None, :], v, v.T, c])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_comoments() of both batches' rows."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    w = a[0] * share
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w])


def comoments(df: DataFrame, columns: list[str]) -> np.ndarray:
    """[6, a, b] of every two columns over the rows where both aren't null: each task reduces its rows to
    one matrix a kind, tasks are merged in a few groups, and these by the driver. One scan."""
    k = len(columns)

    def part(batches):
        total = np.zeros((6, k, k))
        for b in batches:
            cells = [c.cast(pa.float64()) for c in b.columns]
            known = np.stack([np.asarray(pc.is_valid(c)) for c in cells], 1)
            total = _merged(total, _comoments(np.stack([c.to_numpy(zero_copy_only=False) for c in cells], 1), known))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "sums"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        total = reduce(_merged, [np.frombuffer(s).reshape(6, k, k) for s in pdf["sums"]])
        return pd.DataFrame({"slot": [0], "sums": [total.tobytes()]})

    parts = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(part, "slot int, sums binary")
    found = parts.groupBy("slot").applyInPandas(whole, "slot int, sums binary").collect()  # at most 16 rows of columns squared
    return reduce(_merged, [np.frombuffer(bytes(r["sums"])).reshape(6, k, k) for r in found], np.zeros((6, k, k)))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns, a before b, over rows where both are known; r is null for a
    constant column and NaN for one with NaN."""
    s = comoments(df, columns)
    rows = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            v = s[3, i, j] * s[4, i, j]
            rows.append((a, columns[j], None if v <= 0 else float(s[5, i, j] / np.sqrt(v))))
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def discriminative_features(df: DataFrame, features: list[str], label: str, k: int) -> DataFrame:
    """The k features whose class means vary most: sample deviation over absolute mean, 0 if undefined."""
    means = stats_by_column(df, features, {"m": F.avg}, [label])
    spread = means.groupBy("column").agg(F.coalesce(F.try_divide(F.stddev_samp("m"), F.abs(F.avg("m"))), F.lit(0.0)).alias("score"))
    return top_k(spread, "score", k, "column")


def class_profile(df: DataFrame, label: str, column: str) -> DataFrame:
    """(label, mean, std, lo, hi, p05, p95) of a column in every class."""
    x = F.col(column)
    g = df.groupBy(label).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    q = quantiles(df, [column], [0.05, 0.95], [label]).select(F.col(label).alias("_l"), F.col("q")[0].alias("p05"), F.col("q")[1].alias("p95"))
    return g.join(q, same_groups([label], ["_l"])).drop("_l")


def majority_baseline(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("baseline"))


def shares(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
