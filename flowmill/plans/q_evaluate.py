"""Queries over predictions: metrics, calibration, significance, rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import significance as G
from .catalog import query
from .views import PREDS, preds, table

LABELS = [0, 1, 2, 3, 4]
BENIGN = 4
CM = f"""{PREDS}, cm as (select m.model, t.y as y_true, p.y as y_pred, coalesce(c.n, 0) as n from (values (0),(1),(2),(3)) m(model) cross join (values (0),(1),(2),(3),(4)) t(y) cross join (values (0),(1),(2),(3),(4)) p(y)
 left join (select model, y_true, y_pred, count(*) as n from preds group by all) c on c.model = m.model and c.y_true = t.y and c.y_pred = p.y)"""
MARG = f"""{CM}, s as (select model, y_true as label, sum(n)::bigint as support, sum(n) filter (where y_true = y_pred)::bigint as tp from cm group by all), pr as (select model, y_pred as label, sum(n)::bigint as predicted from cm group by all),
m0 as (select model, label, support, predicted, tp, sum(support) over (partition by model)::bigint as total, predicted - tp as fp, support - tp as fn from s join pr using (model, label)),
m1 as (select *, coalesce(tp / nullif(predicted, 0)::double, 0) as precision, coalesce(tp / nullif(support, 0)::double, 0) as recall, coalesce(fp / nullif(total - support, 0)::double, 0) as fpr, coalesce(fn / nullif(support, 0)::double, 0) as fnr from m0),
m as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from m1)"""
METRICS = f"""{MARG}, mm as (select model, sum(tp) / sum(support)::double as accuracy, avg(recall) as balanced_accuracy, avg(precision) as precision_macro, avg(recall) as recall_macro, avg(f1) as f1_macro,
 sum(precision * support) / sum(support) as precision_weighted, sum(recall * support) / sum(support) as recall_weighted, sum(f1 * support) / sum(support) as f1_weighted, min(recall) as min_recall from m group by model)"""
BINARY = """b0 as (select model, (sum(n) filter (where y_true = 4))::bigint as benign, (sum(n) filter (where y_true <> 4))::bigint as attack, (sum(n) filter (where y_true = 4 and y_pred <> 4))::bigint as false_alerts,
 (sum(n) filter (where y_true <> 4 and y_pred = 4))::bigint as missed, (sum(n) filter (where y_true <> 4 and y_pred <> 4))::bigint as caught from cm group by model),
b1 as (select *, false_alerts / nullif(benign, 0)::double as binary_fpr, missed / nullif(attack, 0)::double as binary_fnr, caught / nullif(attack, 0)::double as binary_recall, caught / nullif(caught + false_alerts, 0)::double as binary_precision from b0),
bv as (select *, 2 * binary_precision * binary_recall / nullif(binary_precision + binary_recall, 0) as binary_f1 from b1)"""
_RATES = ["accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted"]
_VIEW = ["binary_fpr", "binary_fnr", "binary_recall", "binary_precision", "binary_f1"]


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 8) for c in cols})


def sql_rounded(*cols):
    return ", ".join(f"round({c}, 8) as {c}" for c in cols)


def cm(spark, d):
    return M.confusion_matrix(preds(spark, d), LABELS)


@query("confusion_matrix", f"with {CM} select * from cm")
def _(spark, d):
    return cm(spark, d)


@query("model_metrics", f"with {METRICS} select model, {sql_rounded(*_RATES)} from mm")
def _(spark, d):
    return rounded(M.model_metrics(M.marginals(cm(spark, d))), *_RATES)


@query("per_class_report", f"""with {METRICS}, t as (select model, sum(support)::bigint as support from m group by model)
select model, label::varchar as "row", {sql_rounded('precision', 'recall', 'f1')}, support from m
union all select model, 'accuracy', round(accuracy, 8), round(accuracy, 8), round(accuracy, 8), support from mm join t using (model)
union all select model, 'macro avg', round(precision_macro, 8), round(recall_macro, 8), round(f1_macro, 8), support from mm join t using (model)
union all select model, 'weighted avg', round(precision_weighted, 8), round(recall_weighted, 8), round(f1_weighted, 8), support from mm join t using (model)""")
def _(spark, d):
    return rounded(M.per_class_report(M.marginals(cm(spark, d))), "precision", "recall", "f1")


_MCC = "k as (select model, (sum(tp)::double * sum(support) - sum(support::double * predicted)) / nullif(sqrt((sum(support)::double ^ 2 - sum(predicted::double ^ 2)) * (sum(support)::double ^ 2 - sum(support::double ^ 2))), 0) as mcc from m group by model)"
_EXT = ["precision_macro", "recall_macro", "precision_weighted", "recall_weighted", "f1_macro", "f1_weighted", "f1_macro_reportable", "min_per_class_recall", *_VIEW, "mcc"]
EXT = f"""{METRICS}, {BINARY}, {_MCC}, rep as (select model, coalesce(avg(f1) filter (where support >= 500), 0) as f1_macro_reportable, min(recall) as min_per_class_recall from m group by model),
ext as (select * from mm join rep using (model) join bv using (model) join k using (model))"""


@query("extended_metrics", f"with {EXT} select model, {sql_rounded(*_EXT)}, benign, attack, false_alerts, missed, caught from ext")
def _(spark, d):
    return rounded(M.extended_metrics(cm(spark, d), BENIGN, 500), *_EXT)


@query("target_metrics", f"""with {CM}, g as (select model, sum(n) filter (where y_true=2 and y_pred=2) as tp, sum(n) filter (where y_true=2 and y_pred<>2) as fn, sum(n) filter (where y_true<>2 and y_pred=2) as fp, sum(n) filter (where y_true<>2 and y_pred<>2) as tn, sum(n) filter (where y_true=2 and y_pred=4) as tb from cm group by model),
h as (select *, tp / (tp + fp)::double as precision, tp / (tp + fn)::double as recall from g)
select model, {sql_rounded('precision', 'recall')}, round(2 * precision * recall / (precision + recall), 8) as f1, round(5 * precision * recall / (4 * precision + recall), 8) as f2, round(fp / (fp + tn)::double, 8) as fpr, fp::bigint as fp, fn::bigint as fn, tb::bigint as to_benign from h""")
def _(spark, d):
    return rounded(M.target_metrics(cm(spark, d), 2, BENIGN), "precision", "recall", "f1", "f2", "fpr")


@query("binary_view", f"with {CM}, {BINARY} select model, benign, attack, false_alerts, missed, caught, {sql_rounded(*_VIEW)} from bv")
def _(spark, d):
    return rounded(M.binary_view(cm(spark, d), BENIGN), *_VIEW)


@query("f1_matrix", f"with {MARG} select label, any_value(support) filter (where model = 0) as support, " + ", ".join(f"round(max(f1) filter (where model = {k}), 8) as f1_{k}" for k in range(4)) + " from m group by label")
def _(spark, d):
    m = M.marginals(cm(spark, d))
    wide = m.groupBy("label").pivot("model", [0, 1, 2, 3]).agg(F.round(F.max("f1"), 8)).toDF("label", "f1_0", "f1_1", "f1_2", "f1_3")
    return wide.join(m.where("model = 0").select("label", "support"), "label")


@query("confusion_normalized", f"with {CM} select model, y_true, y_pred, n, round(n / sum(n) over (partition by model, y_true), 8) as share from cm")
def _(spark, d):
    return rounded(M.normalized_rows(cm(spark, d)), "share")


@query(
    "calibrate_threshold",
    f"""with {PREDS}, s as (select model, score, count(*) filter (where y_true = 2) as pos, count(*) filter (where y_true <> 2) as neg from preds group by all),
c as (select model, score as threshold, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by model) as pt, sum(neg) over (partition by model) as nt from s window w as (partition by model order by score desc)),
e as (select model, threshold, tp::bigint as tp, fp::bigint as fp, (pt - tp)::bigint as fn, tp / (tp + fp)::double as precision, tp / pt::double as recall, fp / nt::double as fpr from c where threshold between 0 and 1),
f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from e where fpr <= 0.1),
g as (select *, row_number() over (partition by model order by f1 desc, precision desc, recall desc, threshold desc) as rk from f)
select model, {sql_rounded('f1', 'precision', 'recall', 'threshold', 'fpr')}, fp, fn from g where rk = 1""",
)
def _(spark, d):
    return rounded(M.calibrate_threshold(preds(spark, d), 2, 0.1), "f1", "precision", "recall", "threshold", "fpr")


_P = [f"((row_id * {k}) % 101)" for k in (7, 13, 17, 19, 23)]


@query("threshold_decision", f"with x as (select event_id as row_id from events), p as (select row_id, [{', '.join(_P)}] as q from x), s as (select row_id, list_transform(q, lambda v: coalesce(v / nullif(list_sum(q), 0)::double, 0)) as q from p) select row_id, case when q[3] >= 0.3::double then 2 else (case when q[1] >= greatest(q[2], q[4], q[5]) then 0 when q[2] >= greatest(q[4], q[5]) then 1 when q[4] >= q[5] then 3 else 4 end) end as decision from s")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("row_id"))
    q = F.array(*[F.expr(p) for p in _P])
    total = F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    return e.select("row_id", M.threshold_decision(F.transform(q, lambda v: F.coalesce(F.try_divide(v, total), F.lit(0.0))), 2, 0.3).alias("decision"))


@query("confusion_diff", f"with {CM} select model, y_true, y_pred, n + (y_true = 1)::int as stored_n, n as rebuilt_n from cm where model = 2 and y_pred = 3 and y_true = 1")
def _(spark, d):
    """Stored matrices with one cell off, against the rebuilt ones."""
    c = cm(spark, d)
    off = (F.col("model") == 2) & (F.col("y_pred") == 3) & (F.col("y_true") == 1)
    return M.confusion_diff(c.withColumn("n", F.col("n") + off.cast("int")), c)


def paired(spark, d):
    return preds(spark, d).groupBy("row_id", "y_true").pivot("model", [0, 1, 2, 3]).agg(F.first("y_pred")).toDF("row_id", "y_true", "p0", "p1", "p2", "p3")


_WIDE = f"{PREDS}, w as (select row_id, y_true, " + ", ".join(f"max(y_pred) filter (where model = {k}) as p{k}" for k in range(4)) + " from preds group by all)"


@query("mcnemar_counts", f"with {_WIDE} " + " union all ".join(f"select 'p{k}' as rival, count(*) filter (where p0 = y_true and p{k} <> y_true) as only_leader, count(*) filter (where p0 <> y_true and p{k} = y_true) as only_rival from w" for k in (1, 2, 3)))
def _(spark, d):
    return M.mcnemar_counts(paired(spark, d), "p0", ["p1", "p2", "p3"])


_COUNTS = " union all ".join(f"select 'p{k}' as rival, count(*) filter (where p0 = y_true and p{k} <> y_true) as only_leader, count(*) filter (where p0 <> y_true and p{k} = y_true) as only_rival from w" for k in (1, 2, 3))


@query("mcnemar_exact", f"with {_WIDE}, c as ({_COUNTS}), t as (select *, only_leader + only_rival as n, least(only_leader, only_rival) as k from c) select rival, only_leader, only_rival, round(least(1.0, 2 * list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 9) as p from t")
def _(spark, d):
    """Two-sided binomial p of each rival's discordant counts."""
    return G.binomial_p(M.mcnemar_counts(paired(spark, d), "p0", ["p1", "p2", "p3"])).withColumn("p", F.round("p", 9))


@query("bootstrap_ci")
def _(spark, d):
    """Macro-F1 of each model: point estimate and percentile interval over shared resamples."""
    return G.bootstrap_f1(paired(spark, d), ["p0", "p1", "p2", "p3"])


@query("leader_separability")
def _(spark, d):
    """Each rival against the leader: exact p, interval of the difference of macro-F1, whether both tell them apart."""
    wide, rivals = paired(spark, d), ["p1", "p2", "p3"]
    p = G.binomial_p(M.mcnemar_counts(wide, "p0", rivals)).select("rival", "p")
    j = G.bootstrap_differences(wide, "p0", rivals).join(F.broadcast(p), "rival")  # a row a rival
    return j.withColumn("separable", G.separable(F.col("p"), F.col("ci_low"), F.col("ci_high")))


_CV = """f as (select model, row_id % 5 as fold, y_true, y_pred from preds), l as (select distinct model, fold, y from (select distinct model, fold from f) cross join (values (0),(1),(2),(3),(4)) t(y)), g as (select l.model, l.fold, l.y, (select count(*) from f where f.model=l.model and f.fold=l.fold and f.y_true=l.y and f.y_pred=l.y) as tp, (select count(*) from f where f.model=l.model and f.fold=l.fold and f.y_true=l.y) as s, (select count(*) from f where f.model=l.model and f.fold=l.fold and f.y_pred=l.y) as p from l), h as (select model, fold, avg(coalesce(2 * tp / nullif(s + p, 0)::double, 0)) as f1 from g group by all), cv as (select model, avg(f1) as f1_mean, stddev_pop(f1) as f1_std from h group by model)"""


def cross_validated(spark, d):
    """(model, f1_mean, f1_std) over five folds."""
    folds = preds(spark, d).select(F.struct("model", (F.col("row_id") % 5).alias("fold")).alias("model"), "y_true", "y_pred")
    per = M.model_metrics(M.marginals(M.confusion_matrix(folds, LABELS))).select("model.model", "model.fold", "f1_macro")
    return per.groupBy("model").agg(F.avg("f1_macro").alias("f1_mean"), F.stddev_pop("f1_macro").alias("f1_std"))


@query("cv_summary", f"with {PREDS}, {_CV} select model, {sql_rounded('f1_mean', 'f1_std')} from cv")
def _(spark, d):
    """Mean and population deviation of macro-F1 over five folds."""
    return rounded(cross_validated(spark, d), "f1_mean", "f1_std")


_LAT = "lat as (select (event_id % 4)::int as model, 1 + (event_id * 31 % 97) / 10.0::double * (1 + event_id % 4) as ms, 1000 as n_rows from events)"


def latencies(spark, d):
    """Durations of scoring batches of 1000 rows, derived from event ids."""
    return table(spark, d, "events").selectExpr("cast(event_id % 4 as int) as model", "1 + (event_id * 31 % 97) / 10.0D * (1 + event_id % 4) as ms", "1000 as n_rows")


@query("latency_summary", f"with {_LAT} select model, round(quantile_cont(ms, 0.5), 8) as p50_ms, round(quantile_cont(ms, 0.95), 8) as p95_ms, round(1000 * any_value(n_rows) / quantile_cont(ms, 0.5), 6) as rows_per_s from lat group by model")
def _(spark, d):
    g = R.latency_summary(latencies(spark, d))
    return g.select("model", F.round("p50_ms", 8).alias("p50_ms"), F.round("p95_ms", 8).alias("p95_ms"), F.round("rows_per_s", 6).alias("rows_per_s"))


LAT = f"{_LAT}, ls as (select model, quantile_cont(ms, 0.95) as p95_ms, quantile_cont(ms, 0.5) as p50_ms from lat group by model)"
FIELD = f"{EXT}, {LAT}, field as (select ext.model, f1_macro, f1_weighted, recall_macro, binary_recall, case when ext.model = 3 then null else binary_fpr end as binary_fpr, min_per_class_recall, p95_ms, (10 - ext.model)::double as size_mb from ext join ls on ext.model = ls.model)"


def field(spark, d):
    """Ranked metrics of each model: one lacks its false-positive rate."""
    e = M.extended_metrics(cm(spark, d), BENIGN, 500).join(R.latency_summary(latencies(spark, d)), "model")
    return e.select("model", "f1_macro", "f1_weighted", "recall_macro", "binary_recall", F.when(F.col("model") != 3, F.col("binary_fpr")).alias("binary_fpr"), "min_per_class_recall", "p95_ms", (10 - F.col("model")).cast("double").alias("size_mb"))


@query("leaderboard", f"with {FIELD} select model, round(f1_macro, 8) as f1_macro, row_number() over (order by f1_macro desc, model) as f1_place, row_number() over (order by p95_ms, model) as latency_place from field")
def _(spark, d):
    f = field(spark, d)
    place = lambda *o: F.row_number().over(Window.orderBy(*o))  # noqa: E731  one row a model
    return f.select("model", F.round("f1_macro", 8).alias("f1_macro"), place(F.desc("f1_macro"), "model").alias("f1_place"), place("p95_ms", "model").alias("latency_place"))


@query("rank_measured", f"with {FIELD} select model, case when binary_fpr is not null then rank() over (order by binary_fpr is null, binary_fpr desc) end as place, case when binary_fpr is null then 'binary_fpr' end as absent from field")
def _(spark, d):
    return R.rank_measured(field(spark, d), "binary_fpr")


@query("upsert_metrics", f"with {FIELD} select model, round(case when model in (1, 2) then f1_macro / 2 else f1_macro end, 8) as f1_macro, case when model in (1, 2) then 'fresh' else 'stored' end as origin from field")
def _(spark, d):
    f = field(spark, d).select("model", "f1_macro")
    fresh = f.where("model in (1, 2)").withColumn("f1_macro", F.col("f1_macro") / 2)
    return rounded(R.upsert(f, fresh, "model"), "f1_macro")


#: The query's own limits, so that the rule-made models split into passing and failing ones.
_POLICY = R.POLICY | {
    "security": R.POLICY["security"] | {"constraints": [("binary_fpr", "<=", 0.2), ("min_per_class_recall", ">", 0.0)]},
    "deployment": R.POLICY["deployment"] | {"constraints": [("f1_macro", ">=", "-0.1")]},
}


@query("policy_rankings", f"""with {FIELD}, b as (select max(f1_macro) as best from field),
o as (select 'overall' as ranking, model, true as ok, f1_macro as key1, f1_weighted as key2 from field
 union all select 'security', model, coalesce(binary_fpr <= 0.2, false) and coalesce(min_per_class_recall > 0, false), recall_macro, binary_recall from field
 union all select 'deployment', model, f1_macro >= best - 0.1, -p95_ms, -size_mb from field, b),
oo as (select *, bool_or(ok) over (partition by ranking) as any_ok from o),
r as (select *, row_number() over (partition by ranking order by key1 desc, key2 desc, model) as rk from oo where ok or not any_ok)
select ranking, model, case when any_ok then 'policy_pass' else 'conditional_no_model_meets_constraints' end as status from r where rk = 1""")
def _(spark, d):
    return R.policy_rankings(field(spark, d), _POLICY).select("ranking", "model", "status")


@query("policy_exclusions", f"with {FIELD}, b as (select max(f1_macro) as best from field) select 'security' as ranking, model, case when coalesce(binary_fpr <= 0.2, false) then 'min_per_class_recall' else 'binary_fpr' end as failed from field where not (coalesce(binary_fpr <= 0.2, false) and coalesce(min_per_class_recall > 0, false)) union all select 'deployment', model, 'f1_macro' from field, b where f1_macro < best - 0.1")
def _(spark, d):
    return R.policy_exclusions(field(spark, d), _POLICY)


@query("champion", f"with {FIELD}, t as (select *, coalesce(binary_fpr <= 0.2, false) as ok, bool_or(coalesce(binary_fpr <= 0.2, false)) over () as any_ok from field where binary_fpr is not null) select model, case when any_ok then 'policy_pass' else 'conditional_no_model_meets_fpr' end as status, round(binary_fpr, 8) as fpr, round(f1_macro, 8) as f1_macro from t where ok or not any_ok order by case when any_ok then -f1_macro else binary_fpr end, f1_macro desc, model limit 1")
def _(spark, d):
    return rounded(R.champion(field(spark, d), "binary_fpr", 0.2), "fpr", "f1_macro")


@query("operational_impact", f"with {EXT}, w as (select model, label, recall, row_number() over (partition by model order by recall, label) as rk from m where label <> 4 and support > 0) select e.model, round(10000 * binary_fpr, 6) as alerts_per_10k, missed, w.label as worst_class, round(w.recall, 8) as worst_recall from ext e join w on e.model = w.model and rk = 1")
def _(spark, d):
    c = cm(spark, d)
    return R.operational_impact(c, M.marginals(c), BENIGN).select("model", F.round("alerts_per_10k", 6).alias("alerts_per_10k"), "missed", "worst_class", F.round("worst_recall", 8).alias("worst_recall"))


@query("trust_verdict", f"with {METRICS}, bl as (select max(n) / sum(n)::double as b from (select y_true, count(*) as n from preds where model = 0 group by 1)), {_CV} select mm.model, f1_macro >= 0.99 as near_perfect, round(accuracy - b, 8) as lift, case when f1_std < 0.02 then 'stable' when f1_std < 0.05 then 'moderate' when f1_std < 0.1 then 'variable' else 'unstable' end as stability, 0.2::double as chance from mm join cv on mm.model = cv.model, bl")
def _(spark, d):
    p = preds(spark, d)
    base = p.where("model = 0").groupBy("y_true").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("baseline"))
    m = M.model_metrics(M.marginals(cm(spark, d))).join(cross_validated(spark, d).withColumnRenamed("f1_std", "cv_std"), "model")
    return rounded(R.trust_verdict(m.join(F.broadcast(base)), 5), "lift")


@query("granularity", f"with {MARG} select model, label, support, round(1.0::double / support, 8) as step from m where support > 0 and support < 1000 and model = 0")
def _(spark, d):
    """Classes so small that one row moves their recall by a visible step."""
    return M.marginals(cm(spark, d)).where("support > 0 and support < 1000 and model = 0").select("model", "label", "support", F.round(1.0 / F.col("support"), 8).alias("step"))


@query("separable", f"with {FIELD} select model, case when model = 3 then null else (case when model = 2 then 0.2 else 0.01 end < 0.05 and (f1_macro - best > 0.0 or f1_macro - best < -0.01)) end as separable from field, (select max(f1_macro) as best from field)")
def _(spark, d):
    f = field(spark, d)
    best = f.agg(F.max("f1_macro").alias("best"))
    t = f.join(F.broadcast(best)).select("model", F.when(F.col("model") != 3, F.when(F.col("model") == 2, 0.2).otherwise(0.01)).alias("p"), (F.col("best") - F.col("f1_macro") - 0.01).alias("ci_low"), (F.col("best") - F.col("f1_macro")).alias("ci_high"))
    return t.select("model", G.separable(F.col("p"), F.col("ci_low"), F.col("ci_high")).alias("separable"))


@query("leader_gap", f"with {FIELD} select f.model, round(b.f1_macro - f.f1_macro, 8) as gap from field f, (select model, f1_macro from field where binary_fpr is not null order by f1_macro desc, model limit 1) b where f.model <> b.model and f.binary_fpr is not null")
def _(spark, d):
    return rounded(R.leader_gap(field(spark, d).where("binary_fpr is not null"), "f1_macro"), "gap")


@query("extended_table", f"with {FIELD} select f.model, {sql_rounded('f1_macro', 'recall_macro', 'mcc')}, round(f.p95_ms, 8) as p95_ms, round(1000000 / p50_ms, 6) as rows_per_s, size_mb from field f join (select model, mcc from ext) e using (model) join ls on ls.model = f.model")
def _(spark, d):
    e = M.extended_metrics(cm(spark, d), BENIGN, 500).select("model", "mcc")
    t = R.latency_summary(latencies(spark, d)).select("model", F.round("rows_per_s", 6).alias("rows_per_s"))
    return rounded(field(spark, d).join(e, "model").join(t, "model").select("model", "f1_macro", "recall_macro", "mcc", "p95_ms", "rows_per_s", "size_mb"), "f1_macro", "recall_macro", "mcc", "p95_ms")


@query("compare_models", f"with {METRICS} select model, {sql_rounded('accuracy', 'f1_macro', 'f1_weighted')} from mm")
def _(spark, d):
    return rounded(M.model_metrics(M.marginals(cm(spark, d))).select("model", "accuracy", "f1_macro", "f1_weighted"), "accuracy", "f1_macro", "f1_weighted")


@query("consequences", f"with {EXT}, {LAT}, bm as (select model from ext order by f1_macro desc, model limit 1), wk as (select label from m where model = (select model from bm) and label <> 4 order by recall, label limit 1) select min(missed) as fewest_missed, max(missed) as most_missed, arg_min(ext.model, missed * 10 + ext.model) as safest, (select label from wk) as weakest_class, round(max(p95_ms) / min(p95_ms), 8) as latency_spread, round(max(p50_ms) / min(p50_ms), 8) as throughput_spread from ext join ls on ext.model = ls.model")
def _(spark, d):
    c = cm(spark, d)
    return rounded(R.consequences(M.extended_metrics(c, BENIGN, 500), M.marginals(c), R.latency_summary(latencies(spark, d)), BENIGN), "latency_spread", "throughput_spread")
