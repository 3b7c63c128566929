"""Feature preparation: statistics are fitted on one frame and applied to another as a broadcast row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import finite_or_null
from .profile import stats_by_column
from .ranks import one_row, quantiles

SCALERS = {
    "standard": (lambda c: F.avg(c), lambda c: F.stddev_pop(c)),
    "minmax": (lambda c: F.min(c), lambda c: F.max(c) - F.min(c)),
}


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    return quantiles(df, columns, [0.5]).select("column", F.col("q")[0].alias("median"))


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with at most one value, those without any included."""
    return stats_by_column(df, columns, {"lo": F.min, "hi": F.max}).where(F.col("lo").isNull() | (F.col("lo") == F.col("hi"))).select("column")


def impute_median(fit: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Gaps become fit's medians, 0 where fit has no value."""
    row = one_row(quantiles(fit, columns, [0.5]), columns, {"_m_": F.col("q")[0]})
    return df.join(F.broadcast(row)).withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns}).drop(*row.columns)


def scale(fit: DataFrame, df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(x - center) / spread with fit's values; a zero or missing spread counts as 1. Kinds: those of
    SCALERS, and robust (median and quartile distance)."""
    if kind == "robust":
        q = F.col("q")
        row = one_row(quantiles(fit, columns, [0.25, 0.5, 0.75]), columns, {"_c_": q[1], "_s_": q[2] - q[0]})
    else:
        center, spread = SCALERS[kind]
        row = fit.agg(*[center(F.col(c)).alias(f"_c_{c}") for c in columns], *[spread(F.col(c)).alias(f"_s_{c}") for c in columns])
    by = lambda c: F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return df.join(F.broadcast(row)).withColumns({c: (F.col(c) - F.col(f"_c_{c}")) / by(c) for c in columns}).drop(*row.columns)


def fit_apply(fit: DataFrame, df: DataFrame, columns: list[str], kind: str = "standard") -> DataFrame:
    """Coerce, drop columns that are constant in fit, fill medians, scale: fitted on fit only.
    Columns that df lacks are filled with their median."""
    ready = lambda d: d.withColumns({c: finite_or_null(F.col(c).cast("double")) if c in d.columns else F.lit(None).cast("double") for c in columns})
    fit, df = ready(fit), ready(df)
    gone = {r[0] for r in constant_columns(fit, columns).collect()}  # one row a column
    keep = [c for c in columns if c not in gone]
    df = impute_median(fit, df.drop(*gone), keep)
    return scale(impute_median(fit, fit.select(*keep), keep), df, keep, kind)


def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(column, f): one-way ANOVA from per-class counts, means and variances, one aggregation."""
    per = stats_by_column(df, features, {"n": F.count, "m": F.avg, "v": F.var_pop}, [label])
    total = per.groupBy("column").agg(F.count("*").alias("k"), F.sum("n").alias("nn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"))
    j = per.join(F.broadcast(total), "column")
    sums = j.groupBy("column", "k", "nn").agg(F.sum(F.col("n") * (F.col("m") - F.col("mm")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    return sums.select("column", F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("nn") - F.col("k"))).alias("f"))


def correlation_filter(pairs: DataFrame, columns: list[str], threshold: float) -> list[str]:
    """Columns kept from left to right: a column goes if an earlier kept one correlates above the
    threshold. pairs has one row for each two columns; constant columns (null r) stay."""
    strong = {(r["a"], r["b"]) for r in pairs.where(F.abs("r") > threshold).collect()}  # columns squared at most
    kept: list[str] = []
    for c in columns:
        if not any((k, c) in strong for k in kept):
            kept.append(c)
    return kept


def jaccard_overlap(chosen: DataFrame) -> DataFrame:
    """(a, b, jaccard) of every two methods in (method, feature), a small table."""
    sizes = chosen.groupBy("method").agg(F.count_distinct("feature").alias("n"))
    other = chosen.select(F.col("method").alias("b"), "feature")
    common = chosen.select(F.col("method").alias("a"), "feature").join(other, "feature").groupBy("a", "b").agg(F.count_distinct("feature").alias("c"))
    na, nb = sizes.toDF("a", "na"), sizes.toDF("b", "nb")
    every = na.crossJoin(F.broadcast(nb)).join(common, ["a", "b"], "left").withColumn("c", F.coalesce("c", F.lit(0)))  # methods squared
    return every.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"))


def consensus_features(chosen: DataFrame, least: int) -> DataFrame:
    return chosen.groupBy("feature").agg(F.count_distinct("method").alias("methods")).where(F.col("methods") >= least)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """df with `weight` N / (C * n): counts are pre-aggregated and joined back."""
    counts = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    every = Window.partitionBy()
    w = F.sum("_n").over(every) / (F.count("*").over(every) * F.col("_n"))
    return df.join(F.broadcast(counts.select("_l", w.alias("weight"))), F.col(label) == F.col("_l")).drop("_l")


def target_quota(df: DataFrame, label: str, target, ratio: float) -> DataFrame:
    """(label, current, desired): max(current, ceil(majority * ratio)) of the target class."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("current"))
    most = F.max("current").over(Window.partitionBy())
    return counts.select("label", "current", F.greatest("current", F.ceil(most * F.lit(ratio))).alias("desired")).where(F.col("label") == target)


def random_oversample(ranked: DataFrame, quota: DataFrame, label: str) -> DataFrame:
    """Rows of (.., label, rn, n) repeated until their class has `desired` rows: whole copies for all,
    one more for the first of the class's random order. Classes without a quota stay as they are."""
    q = quota.select(F.col("label").alias("_l"), "desired")
    j = ranked.join(F.broadcast(q), F.col(label) == F.col("_l"), "left")
    want = F.coalesce("desired", "n")
    copies: Column = F.floor(want / F.col("n")) + F.when(F.col("rn") <= want % F.col("n"), 1).otherwise(0)
    return j.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_l", "desired", "rn", "n")
