"""Robustness: conflicting labels, distribution shift, out-of-profile rows, bounded perturbations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from .ranks import quantiles


def label_conflicts(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Groups of identical features with more than one label: features, rows, labels."""
    g = df.groupBy(*features).agg(F.count("*").alias("n_rows"), F.collect_set(label).alias("_l"))
    return g.where(F.size("_l") > 1).withColumn("labels", F.array_join(F.array_sort("_l"), ",")).drop("_l")


def label_shift_tv(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """Total variation between two label distributions, absent labels as 0."""
    n = lambda df, name: df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias(name))
    j = n(a, "x").join(n(b, "y"), "label", "full_outer").na.fill(0)
    total = j.agg(F.sum("x").alias("tx"), F.sum("y").alias("ty"))
    return j.join(F.broadcast(total)).agg((F.sum(F.abs(F.col("x") / F.col("tx") - F.col("y") / F.col("ty"))) / 2).alias("tv"))


def iqr_profile(df: DataFrame, columns: list[str], whisker: float = 3.0) -> DataFrame:
    """(column, lower, upper): quartiles widened by whisker times their distance."""
    q = quantiles(df, columns, [0.25, 0.75])
    lo, hi = F.col("q")[0], F.col("q")[1]
    return q.select("column", (lo - whisker * (hi - lo)).alias("lower"), (hi + whisker * (hi - lo)).alias("upper"))


def ood_flags(df: DataFrame, profile: DataFrame, columns: list[str], limit: float = 0.1) -> DataFrame:
    """df with `outside` (share of features that aren't finite or lie outside the profile) and `ood`."""
    bounds = profile.groupBy().pivot("column", columns).agg(F.max(F.struct("lower", "upper"))).toDF(*[f"_b_{c}" for c in columns])

    def out(c: str) -> Column:
        x, b = F.col(c), F.col(f"_b_{c}")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < b["lower"]) | (x > b["upper"]), 1).otherwise(0)

    share = sum((out(c) for c in columns), F.lit(0)) / len(columns)
    return df.join(F.broadcast(bounds)).withColumn("outside", share).withColumn("ood", F.col("outside") > limit).drop(*bounds.columns)


def perturb(df: DataFrame, columns: list[str], epsilon: float | Column, position: str, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """v + or - epsilon * max(|v|, 1), plus on even positions, clipped to the bounds."""
    sign = F.when(F.col(position) % 2 == 0, 1.0).otherwise(-1.0)

    def moved(c: str) -> Column:
        v = F.col(c) + sign * epsilon * F.greatest(F.abs(c), F.lit(1.0))
        return F.greatest(F.lit(float(bounds[c][0])), F.least(F.lit(float(bounds[c][1])), v)) if bounds and c in bounds else v

    return df.withColumns({c: moved(c) for c in columns})


def flip_rate(a: DataFrame, b: DataFrame, row_id: str, pred: str) -> DataFrame:
    j = a.select(row_id, F.col(pred).alias("_a")).join(b.select(row_id, F.col(pred).alias("_b")), row_id)
    return j.agg(F.avg(F.when(~F.col("_a").eqNullSafe(F.col("_b")), 1.0).otherwise(0.0)).alias("flip_rate"))


def evasion_report(df: DataFrame, columns: list[str], position: str, predict: Callable[[DataFrame], Column], epsilons: list[float], labels: list[int]) -> DataFrame:
    """One row an epsilon: macro-F1, the worst drop of a class's recall, whether both stay within the
    policy (0.9 of the clean F1, a drop of 0.15). df has y_true; predict gives the prediction column."""
    # one pass: each row meets every epsilon (a few literals), 0 among them
    each = df.withColumn("_e", F.explode(F.array(*[F.lit(float(e)) for e in [0.0, *epsilons]])))
    moved = perturb(each, columns, F.col("_e"), position)
    runs = moved.select(F.col("_e").alias("model"), "y_true", predict(moved).alias("y_pred"))
    m = M.marginals(M.confusion_matrix(runs, labels))
    f1 = m.groupBy("model").agg(F.avg("f1").alias("f1_macro"))
    clean = m.where("model = 0.0").select("label", F.col("recall").alias("_r0"))
    drop = m.where("support > 0").join(clean, "label").groupBy("model").agg(F.max(F.col("_r0") - F.col("recall")).alias("worst_drop"))
    base = f1.where("model = 0.0").select(F.col("f1_macro").alias("_f0"))
    j = f1.join(drop, "model").join(F.broadcast(base)).where("model > 0")
    ok = (F.col("f1_macro") >= 0.9 * F.col("_f0")) & (F.col("worst_drop") <= 0.15)
    return j.select(F.col("model").alias("epsilon"), "f1_macro", "worst_drop", ok.alias("passed"))


def robustness_report(train: DataFrame, test: DataFrame, features: list[str], label: str, profile: DataFrame, evasion: DataFrame, *, max_shift: float = 0.1, max_ood: float = 0.1) -> DataFrame:
    """(check_name, value, passed) of all checks: conflicting labels in the training rows, shift of the
    labels, share of test rows outside the profile, each epsilon of an evasion report. A feature or
    label that either side lacks, or an empty side, is an error."""
    for name, df in (("train", train), ("test", test)):
        if missing := [c for c in [*features, label] if c not in df.columns]:
            raise ValueError(f"{name} lacks {missing}")
        if df.isEmpty():
            raise ValueError(f"{name} has no rows")
    n = label_conflicts(train, features, label).agg(F.count("*").alias("n"))
    rows = n.select(F.lit("conflict_groups").alias("check_name"), F.col("n").cast("double").alias("value"), (F.col("n") == 0).alias("passed"))
    shift = label_shift_tv(train, test, label).select(F.lit("label_shift"), F.round("tv", 9), F.round("tv", 9) <= max_shift)
    share = ood_flags(test, profile, features).agg(F.avg(F.col("ood").cast("int")).alias("share"))
    ood = share.select(F.lit("ood_share"), F.round("share", 9), F.round("share", 9) <= max_ood)
    ev = evasion.select(F.concat(F.lit("evasion_"), F.col("epsilon").cast("string")), "f1_macro", "passed")
    return rows.union(shift).union(ood).union(ev)
