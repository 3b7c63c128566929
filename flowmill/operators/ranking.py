"""Orders and selections over one row a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranks import quantiles

#: A ranking maximises or minimises an objective under constraints (metric, operator, limit); a limit
#: in text is an offset from the best value of that metric. Ties go by the tie-breaker in the
#: objective's own direction, then by model; compat_ties lets a minimised objective prefer the larger.
POLICY = {
    "overall": {"maximize": "f1_macro", "tie": "f1_weighted", "constraints": []},
    "security": {"maximize": "recall_macro", "tie": "binary_recall", "constraints": [("binary_fpr", "<=", 0.01), ("min_per_class_recall", ">", 0.0)]},
    "deployment": {"minimize": "p95_ms", "tie": "size_mb", "constraints": [("f1_macro", ">=", "-0.02")]},
}
_COMPARE = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}


def _limited(models: DataFrame, rule: tuple) -> Column:
    metric, op, limit = rule
    bound = F.max(metric).over(Window.partitionBy()) + float(limit) if isinstance(limit, str) else F.lit(limit)
    return F.coalesce(_COMPARE[op](F.col(metric), bound), F.lit(False))  # an absent metric fails


def require_models(models: DataFrame) -> DataFrame:
    """models, or an error if there is none to rank."""
    if models.isEmpty():
        raise ValueError("no model to rank")
    return models


def policy_rankings(models: DataFrame, policy: dict, compat_ties: bool = False) -> DataFrame:
    """(ranking, model, status, objective_value): the winner of each ranking; where no model meets the
    constraints, the unconstrained winner with that status. The models' rows are made once."""
    models, out = written(models.coalesce(1), "models"), None
    for name, spec in policy.items():
        up = "maximize" in spec
        objective = spec.get("maximize") or spec["minimize"]
        ok = F.lit(True)
        for rule in spec["constraints"]:
            ok = ok & _limited(models, rule)
        pool = models.where(F.col(objective).isNotNull()).withColumn("_ok", ok)
        pool = pool.withColumn("_some", F.max("_ok").over(Window.partitionBy())).where("_ok or not _some")
        direction = lambda c, larger: F.desc_nulls_last(c) if larger else F.asc_nulls_last(c)
        place = F.row_number().over(Window.orderBy(direction(objective, up), direction(spec["tie"], up or compat_ties), "model"))
        status = F.when(F.col("_some"), "policy_pass").otherwise("conditional_no_model_meets_constraints")
        won = pool.withColumn("_p", place).where("_p = 1").select(F.lit(name).alias("ranking"), "model", status.alias("status"), F.col(objective).alias("objective_value"))
        out = won if out is None else out.union(won)
    return out


def policy_exclusions(models: DataFrame, policy: dict) -> DataFrame:
    """(ranking, model, failed): the first constraint, in policy order, that a model fails."""
    models, out = written(models.coalesce(1), "models"), None
    for name, spec in policy.items():
        failed = F.lit(None).cast("string")
        for rule in reversed(spec["constraints"]):
            failed = F.when(~_limited(models, rule), rule[0]).otherwise(failed)
        rows = models.select(F.lit(name).alias("ranking"), "model", failed.alias("failed")).where("failed is not null")
        out = rows if out is None else out.union(rows)
    return out


def champion(models: DataFrame, fpr: str, cap: float) -> DataFrame:
    """The best macro-F1 among models under the cap, else the lowest rate and then the best F1."""
    m = models.where(F.col(fpr).isNotNull()).withColumn("_ok", F.col(fpr) <= cap)
    m = m.withColumn("_some", F.max("_ok").over(Window.partitionBy())).where("_ok or not _some")
    first = F.when(F.col("_some"), -F.col("f1_macro")).otherwise(F.col(fpr))
    status = F.when(F.col("_some"), "policy_pass").otherwise("conditional_no_model_meets_fpr")
    return m.orderBy(first, F.desc("f1_macro"), "model").limit(1).select("model", status.alias("status"), F.col(fpr).alias("fpr"), "f1_macro")


def rank_measured(models: DataFrame, metric: str, descending: bool = True) -> DataFrame:
    """(model, place, absent): measured models ranked, the others without a place."""
    order = F.desc_nulls_last(metric) if descending else F.asc_nulls_last(metric)
    some = F.col(metric).isNotNull()
    return models.select("model", F.when(some, F.rank().over(Window.orderBy(order))).alias("place"), F.when(~some, metric).alias("absent"))


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """One row a key, the fresh one where there is one; `origin` says which."""
    both = fresh.withColumn("origin", F.lit("fresh")).unionByName(stored.withColumn("origin", F.lit("stored")))
    w = Window.partitionBy(key).orderBy("origin")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def leader_gap(models: DataFrame, metric: str) -> DataFrame:
    """How far each other model is behind the leader, smallest gap first."""
    leader = models.orderBy(F.desc(metric), "model").limit(1).select(F.col("model").alias("_lead"), F.col(metric).alias("_best"))
    j = models.join(F.broadcast(leader)).where("model <> _lead")
    return j.select("model", (F.col("_best") - F.col(metric)).alias("gap")).orderBy("gap", "model")


def latency_summary(durations: DataFrame) -> DataFrame:
    """(model, p50_ms, p95_ms, rows_per_s) from (model, ms, n_rows)."""
    n = durations.groupBy("model").agg(F.max("n_rows").alias("n"))
    q = quantiles(durations, ["ms"], [0.5, 0.95], ["model"]).join(n, "model")
    return q.select("model", F.col("q")[0].alias("p50_ms"), F.col("q")[1].alias("p95_ms"), (1000 * F.col("n") / F.col("q")[0]).alias("rows_per_s"))


def worst_attack_class(m: DataFrame, benign: int) -> DataFrame:
    w = m.where((F.col("label") != benign) & (F.col("support") > 0)).groupBy("model").agg(F.min(F.struct("recall", "label")).alias("w"))
    return w.select("model", F.col("w.label").alias("worst_class"), F.col("w.recall").alias("worst_recall"))


def operational_impact(cm: DataFrame, m: DataFrame, benign: int) -> DataFrame:
    """Alerts per 10,000 benign rows, missed attacks and the worst attack class of each model."""
    from .metrics import binary_view

    b = binary_view(cm, benign, 0.0).select("model", (10_000 * F.col("binary_fpr")).alias("alerts_per_10k"), "missed")
    return b.join(worst_attack_class(m, benign), "model")


def trust_verdict(models: DataFrame, classes: int) -> DataFrame:
    """Warning flags from f1_macro, accuracy, baseline and cv_std; without folds the stability is null."""
    s = F.col("cv_std")
    bands = F.when(s < 0.02, "stable").when(s < 0.05, "moderate").when(s < 0.10, "variable").when(s >= 0.10, "unstable")
    return models.select("model", (F.col("f1_macro") >= 0.99).alias("near_perfect"), (F.col("accuracy") - F.col("baseline")).alias("lift"), bands.alias("stability"), F.lit(1.0 / classes).alias("chance"))


def consequences(ext: DataFrame, m: DataFrame, latency: DataFrame, benign: int) -> DataFrame:
    """Spread of missed attacks, latency, throughput and, where latency has `size_bytes`, stored size over the
    models, and the best model's weakest attack class."""
    best = ext.orderBy(F.desc("f1_macro"), "model").limit(1).select("model")
    weak = worst_attack_class(m, benign).join(best, "model").select(F.col("worst_class").alias("weakest_class"))
    j = ext.join(latency, "model")
    over = {"latency_spread": "p95_ms", "throughput_spread": "rows_per_s", "size_spread": "size_bytes"}
    spread = j.agg(F.min("missed").alias("fewest_missed"), F.max("missed").alias("most_missed"), F.min_by("model", F.struct("missed", "model")).alias("safest"), *[(F.max(c) / F.min(c)).alias(name) for name, c in over.items() if c in latency.columns])
    return spread.join(F.broadcast(weak))
