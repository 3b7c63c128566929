"""Metrics from confusion counts: one wide aggregation, then algebra over a few rows a model.

Undefined ratios are 0 unless a function says null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, undefined: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(undefined).cast("double"))


def confusion_matrix(preds: DataFrame, labels: list[int]) -> DataFrame:
    """(model, y_true, y_pred, n) of every model and every two labels, absent cells 0."""
    counts = preds.groupBy("model", "y_true", "y_pred").agg(F.count("*").alias("n"))
    models = counts.select("model").distinct()
    both = F.array(*[F.lit(x) for x in labels])
    grid = models.withColumn("y_true", F.explode(both)).withColumn("y_pred", F.explode(both))
    return grid.join(counts, ["model", "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def marginals(cm: DataFrame) -> DataFrame:
    """(model, label, support, predicted, tp, total, precision, recall, f1, fpr, fnr, fp, fn)."""
    part = lambda label, s, p, t: F.struct(F.col(label).alias("label"), s.cast("long").alias("s"), p.cast("long").alias("p"), t.cast("long").alias("t"))
    n, zero = F.col("n"), F.lit(0)
    hit = F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(0)
    both = cm.select("model", F.explode(F.array(part("y_true", n, zero, hit), part("y_pred", zero, n, zero))).alias("e"))
    m = both.groupBy("model", F.col("e.label").alias("label")).agg(F.sum("e.s").alias("support"), F.sum("e.p").alias("predicted"), F.sum("e.t").alias("tp"))
    m = m.withColumn("total", F.sum("support").over(Window.partitionBy("model")))
    m = m.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    m = m.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support")), "fpr": ratio(F.col("fp"), F.col("total") - F.col("support")), "fnr": ratio(F.col("fn"), F.col("support"))})
    return m.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def model_metrics(m: DataFrame, label_set: str = "all") -> DataFrame:
    """One row a model from marginals(); balanced accuracy over all labels or those with true rows."""
    over = F.when((F.col("support") > 0) if label_set == "true" else F.lit(True), F.col("recall"))
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support"))
    return m.groupBy("model").agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg(over).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"),
        weighted("precision").alias("precision_weighted"), weighted("recall").alias("recall_weighted"), weighted("f1").alias("f1_weighted"),
    )


def per_class_report(m: DataFrame) -> DataFrame:
    """(model, row, precision, recall, f1, support): classes, then accuracy, macro and weighted rows."""
    rows = m.select("model", F.col("label").cast("string").alias("row"), "precision", "recall", "f1", "support")
    k = model_metrics(m)
    totals = m.groupBy("model").agg(F.sum("support").alias("support"))
    j = k.join(totals, "model")
    pick = lambda name, p, r, f: j.select("model", F.lit(name).alias("row"), F.col(p).alias("precision"), F.col(r).alias("recall"), F.col(f).alias("f1"), "support")
    return rows.union(pick("accuracy", "accuracy", "accuracy", "accuracy")).union(pick("macro avg", "precision_macro", "recall_macro", "f1_macro")).union(pick("weighted avg", "precision_weighted", "recall_weighted", "f1_weighted"))


def binary_view(cm: DataFrame, benign: int, undefined: float | None = None) -> DataFrame:
    """Attack against benign, one row a model; an empty side gives `undefined`."""
    t, p = F.col("y_true") == benign, F.col("y_pred") == benign
    s = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    g = cm.groupBy("model").agg(s(t).alias("benign"), s(~t).alias("attack"), s(t & ~p).alias("false_alerts"), s(~t & p).alias("missed"), s(~t & ~p).alias("caught"))
    g = g.withColumns({"binary_fpr": ratio(F.col("false_alerts"), F.col("benign"), undefined), "binary_fnr": ratio(F.col("missed"), F.col("attack"), undefined), "binary_recall": ratio(F.col("caught"), F.col("attack"), undefined), "binary_precision": ratio(F.col("caught"), F.col("caught") + F.col("false_alerts"), undefined)})
    return g.withColumn("binary_f1", ratio(2 * F.col("binary_precision") * F.col("binary_recall"), F.col("binary_precision") + F.col("binary_recall"), undefined))


def mcc(m: DataFrame) -> DataFrame:
    """Multiclass Matthews correlation of each model from marginals()."""
    d = lambda c: F.col(c).cast("double")
    g = m.groupBy("model").agg(F.sum(d("tp")).alias("c"), F.sum(d("support")).alias("s"), F.sum(d("support") * d("predicted")).alias("pt"), F.sum(d("predicted") ** 2).alias("pp"), F.sum(d("support") ** 2).alias("tt"))
    return g.select("model", ratio(F.col("c") * F.col("s") - F.col("pt"), F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt")))).alias("mcc"))


def extended_metrics(cm: DataFrame, benign: int, reportable: int) -> DataFrame:
    """One row a model: averages, macro-F1 over classes with enough rows, binary view, correlation."""
    m = marginals(cm)
    base = model_metrics(m).select("model", "precision_macro", "recall_macro", "precision_weighted", "recall_weighted", "f1_macro", "f1_weighted")
    rep = m.groupBy("model").agg(F.coalesce(F.avg(F.when(F.col("support") >= reportable, F.col("f1"))), F.lit(0.0)).alias("f1_macro_reportable"), F.min("recall").alias("min_per_class_recall"))
    return base.join(rep, "model").join(binary_view(cm, benign, 0.0), "model").join(mcc(m), "model")


def target_metrics(cm: DataFrame, target: int, benign: int) -> DataFrame:
    """The target class against the rest, one row a model."""
    t, p = F.col("y_true") == target, F.col("y_pred") == target
    s = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    g = cm.groupBy("model").agg(s(t & p).alias("tp"), s(t & ~p).alias("fn"), s(~t & p).alias("fp"), s(~t & ~p).alias("tn"), s(t & (F.col("y_pred") == benign)).alias("to_benign"))
    g = g.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    beta = lambda b: ratio((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall"))
    return g.select("model", "precision", "recall", beta(1.0).alias("f1"), beta(4.0).alias("f2"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), "fp", "fn", "to_benign")


#: Ranges of a model's distinct scores, each ranked on its own.
SCORE_RANGES = 64


def calibrate_threshold(preds: DataFrame, target: int, max_fpr: float) -> DataFrame:
    """The score threshold with the best target F1 (then precision, recall, threshold) among those
    whose false-positive rate is at most max_fpr; one row a model. Scores are aggregated to distinct
    values first; no row, where no threshold qualifies."""
    by_score = preds.groupBy("model", "score").agg(F.count_if(F.col("y_true") == target).alias("pos"), F.count_if(F.col("y_true") != target).alias("neg"))
    # totals of score ranges first, so that distinct scores are ranked range by range. The ranges hold about
    # equally many distinct scores, however close together these lie
    edges = by_score.groupBy("model").agg(F.percentile_approx("score", [k / SCORE_RANGES for k in range(1, SCORE_RANGES)], 1000).alias("_e"))
    by_score = by_score.join(edges, "model").withColumn("_r", F.size(F.filter("_e", lambda e: e < F.col("score")))).drop("_e")
    w = Window.partitionBy("model")
    ranges = by_score.groupBy("model", "_r").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("model", "_r", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_pa"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_na"), F.sum("_p").over(w).alias("_pt"), F.sum("_n").over(w).alias("_nt"))
    down = Window.partitionBy("model", "_r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    c = by_score.withColumns({"_pi": F.sum("pos").over(down), "_ni": F.sum("neg").over(down)}).join(ranges, ["model", "_r"])
    c = c.select("model", F.col("score").alias("threshold"), (F.col("_pi") + F.col("_pa")).alias("tp"), (F.col("_ni") + F.col("_na")).alias("fp"), "_pt", "_nt").where("_pt > 0 and _nt > 0 and threshold between 0 and 1")
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.col("tp") / F.col("_pt"), "fpr": F.col("fp") / F.col("_nt"), "fn": F.col("_pt") - F.col("tp")}).where(F.col("fpr") <= max_fpr)
    c = c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    best = c.groupBy("model").agg(F.max(F.struct("f1", "precision", "recall", "threshold", "fpr", "fp", "fn")).alias("b"))
    return best.select("model", "b.*")


def require_thresholds(best: DataFrame, models: DataFrame, max_fpr: float) -> DataFrame:
    """best (of calibrate_threshold), or an error that names the models for which no threshold satisfies the cap."""
    if missing := [r[0] for r in models.select("model").distinct().join(best.select("model"), "model", "left_anti").orderBy("model").collect()]:  # a row a model
        raise ValueError(f"no threshold satisfies max FPR {max_fpr} for {missing}")
    return best


def threshold_decision(probabilities: Column, target: int, threshold: float) -> Column:
    """The target where its probability reaches the threshold, else the likeliest other class."""
    others = F.transform(probabilities, lambda p, i: F.when(i != target, p).otherwise(float("-inf")))
    return F.when(probabilities[target] >= threshold, target).otherwise(F.array_position(others, F.array_max(others)).cast("int") - 1)


def confusion_diff(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Cells whose counts differ, absent cells as 0."""
    key = ["model", "y_true", "y_pred"]
    a, b = stored.select(*key, F.col("n").alias("stored_n")), rebuilt.select(*key, F.col("n").alias("rebuilt_n"))
    return a.join(b, key, "full_outer").na.fill(0, ["stored_n", "rebuilt_n"]).where("stored_n <> rebuilt_n")


def normalized_rows(cm: DataFrame) -> DataFrame:
    return cm.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("model", "y_true"))))


def mcnemar_counts(paired: DataFrame, leader: str, rivals: list[str]) -> DataFrame:
    """(rival, only_leader, only_rival): rows that just one of the two gets right; one pass for all rivals."""
    right = lambda c: F.col(c) == F.col("y_true")
    wide = paired.agg(*[F.struct(F.count_if(right(leader) & ~right(r)).alias("only_leader"), F.count_if(~right(leader) & right(r)).alias("only_rival")).alias(r) for r in rivals])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rival"), F.col(r).alias("c")) for r in rivals])).alias("e")).select("e.rival", "e.c.*")
