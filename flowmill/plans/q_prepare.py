"""Queries over feature preparation, selection and class balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imbalance as I
from ..operators import prepare as R
from ..operators import profile as P
from ..operators import sampling as S
from .catalog import query
from .q_clean import clean
from .views import CLEAN, FLOWS, flows, table

NUM = ["f_rate", "f_value", "f_k", "f_const"]
_NULLED = f"{FLOWS}, nul as (select row_id, row_id % 10 < 7 as is_train, label_raw, case when isfinite(f_rate) then f_rate end as f_rate, f_value, f_k, f_const from flows)"


def nulled(spark, d):
    from ..functions.labels import finite_or_null

    return flows(spark, d).select("row_id", (F.col("row_id") % 10 < 7).alias("is_train"), "label_raw", finite_or_null(F.col("f_rate")).alias("f_rate"), "f_value", "f_k", "f_const")


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("column_medians", f"with {_NULLED} " + " union all ".join(f"select '{c}' as \"column\", round(median({c}), 6) as median from nul" for c in NUM))
def _(spark, d):
    return _r(R.medians(nulled(spark, d), NUM), "median")


@query("constant_columns", f"with {_NULLED} select 'f_const' as \"column\" from nul having min(f_const) = max(f_const)")
def _(spark, d):
    return R.constant_columns(nulled(spark, d), NUM)


@query("impute_median", f"with {_NULLED} select row_id, coalesce(f_rate, (select median(f_rate) from nul where is_train)) as f_rate, f_value from nul")
def _(spark, d):
    n = nulled(spark, d)
    return R.impute_median(n.where("is_train"), n, ["f_rate", "f_value"]).select("row_id", "f_rate", "f_value")


def _scale_sql(center: str, spread: str) -> str:
    return f"with {_NULLED}, s as (select {center} as c, {spread} as w, max(f_const) as k from nul where is_train) select row_id, round((f_value - c) / w, 6) as f_value, round(f_const - k, 6) as f_const from nul, s"


def _scaled(spark, d, kind):
    n = nulled(spark, d)
    return _r(R.scale(n.where("is_train"), n, ["f_value", "f_const"], kind).select("row_id", "f_value", "f_const"), "f_value", "f_const")


@query("scale_standard", _scale_sql("avg(f_value)", "stddev_pop(f_value)"))
def _(spark, d):
    return _scaled(spark, d, "standard")


@query("scale_minmax", _scale_sql("min(f_value)", "max(f_value) - min(f_value)"))
def _(spark, d):
    return _scaled(spark, d, "minmax")


@query("scale_robust", _scale_sql("quantile_cont(f_value, 0.5)", "quantile_cont(f_value, 0.75) - quantile_cont(f_value, 0.25)"))
def _(spark, d):
    return _scaled(spark, d, "robust")


@query("preprocess_fit_apply", f"with {_NULLED}, md as (select median(f_rate) as m from nul where is_train), im as (select row_id, is_train, coalesce(f_rate, m) as f_rate, f_value from nul, md), s as (select avg(f_rate) as ra, stddev_pop(f_rate) as rs, avg(f_value) as va, stddev_pop(f_value) as vs from im where is_train) select row_id, round((f_rate - ra) / rs, 6) as f_rate, round((f_value - va) / vs, 6) as f_value from im, s where not is_train")
def _(spark, d):
    """Fitted on training rows, applied to the others; the constant column is dropped."""
    n = nulled(spark, d)
    out = R.fit_apply(n.where("is_train"), n.where("not is_train"), ["f_rate", "f_value", "f_const"])
    return _r(out.select("row_id", "f_rate", "f_value"), "f_rate", "f_value")


_WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "copy_price", "copy_tax"]


@query("corr_filter", "select * from (values ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) t(\"column\")")
def _(spark, d):
    """Columns kept by the correlation filter: copies with a little noise go."""
    t = table(spark, d, "lineitem").selectExpr("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_extendedprice * 2 + l_linenumber as copy_price", "l_tax + l_linenumber * 1e-6 as copy_tax")
    kept = R.correlation_filter(P.correlation_pairs(t, _WIDE), _WIDE, 0.95)
    return spark.createDataFrame([(c,) for c in kept], "`column` string")


_F = ["f_rate", "f_value", "f_user", "f_k"]


@query("anova_f", f"""with {CLEAN}, u as (unpivot (select label, f_rate::double as f_rate, f_value::double as f_value, f_user::double as f_user, f_k::double as f_k from clean) on f_rate, f_value, f_user, f_k into name "column" value v),
p as (select "column", label, count(*) as n, avg(v) as m, var_pop(v) as s from u group by all), t as (select "column", count(*) as k, sum(n) as nn, sum(n * m) / sum(n) as mm from p group by 1)
select p."column", round((sum(n * (m - mm) ^ 2) / (any_value(k) - 1)) / (sum(n * s) / (any_value(nn) - any_value(k))), 6) as f from p join t using ("column") group by 1""")
def _(spark, d):
    c = clean(spark, d)
    return _r(R.anova_f(c.select("label", *[F.col(x).cast("double").alias(x) for x in _F]), _F, "label"), "f")


#: A method chooses the features whose rows have a mean discount of 5 % or more; sums of integers, so that both engines agree.
_CHOSEN = "ch as (select 'm' || (l_suppkey % 4)::varchar as method, 'f' || (l_partkey % 37)::varchar as feature from lineitem group by all having sum(round(l_discount * 100)::bigint) >= 5 * count(*))"


def _chosen(spark, d):
    pairs = table(spark, d, "lineitem").selectExpr("concat('m', cast(l_suppkey % 4 as string)) as method", "concat('f', cast(l_partkey % 37 as string)) as feature", "cast(round(l_discount * 100) as long) as cents")
    return pairs.groupBy("method", "feature").agg((F.sum("cents") >= 5 * F.count("*")).alias("_in")).where("_in").drop("_in")


@query("jaccard_overlap", f"with {_CHOSEN}, s as (select method, count(*) as n from ch group by 1) select a.method as a, b.method as b, round(c / (a.n + b.n - c)::double, 6) as jaccard from s a cross join s b cross join lateral (select count(*) as c from ch x join ch y using (feature) where x.method = a.method and y.method = b.method)")
def _(spark, d):
    return _r(R.jaccard_overlap(_chosen(spark, d)), "jaccard")


@query("consensus_features", f"with {_CHOSEN} select feature, count(*) as methods from ch group by 1 having count(*) >= 3")
def _(spark, d):
    return R.consensus_features(_chosen(spark, d), 3)


_PHI = "phi as (select l_returnflag as class, 'f' || (l_partkey % 11)::varchar as feature, (l_discount - 0.05) * (l_partkey % 11) as phi from lineitem)"


@query("shap_topk", f"with {_PHI}, o as (select '*' as class, feature, avg(abs(phi)) as v from phi group by feature union all select class, feature, avg(abs(phi)) from phi group by all), r as (select *, row_number() over (partition by class order by v desc, feature) as rk from o) select class, feature, round(v, 8) as importance, rk from r where rk <= 3")
def _(spark, d):
    from ..operators.explain import top_features

    t = table(spark, d, "lineitem").selectExpr("l_returnflag as class", "concat('f', cast(l_partkey % 11 as string)) as feature", "(l_discount - 0.05) * (l_partkey % 11) as phi")
    return top_features(t, 3).withColumn("importance", F.round("importance", 8))


@query("balanced_weights", f"with {CLEAN}, c as (select label, count(*) as n from clean group by 1) select label, round(sum(n) over () / (count(*) over () * n)::double, 8) as weight, n from c")
def _(spark, d):
    w = R.balanced_weights(clean(spark, d), "label")
    return w.groupBy("label").agg(F.round(F.max("weight"), 8).alias("weight"), F.count("*").alias("n"))


@query("target_quota", f"with {CLEAN}, c as (select label, count(*) as n from clean group by 1) select label, n as current, greatest(n, ceil((select max(n) from c) * 0.3::double)::bigint) as desired from c where label = 'Heartbleed'")
def _(spark, d):
    return R.target_quota(clean(spark, d), "label", "Heartbleed", 0.3)


@query("random_oversample", f"with {CLEAN}, r as (select *, row_number() over (partition by label order by md5(concat_ws(':', '42', label, row_id::varchar)), row_id) as rn, count(*) over (partition by label) as n from clean), q as (select *, case when label = 'Bot' then greatest(n, ceil((select max(n) from r) * 0.5::double)::bigint) else n end as want from r) select row_id, label, want // n + (rn <= want % n)::int as copies from q")
def _(spark, d):
    ranked = S.hash_rank(clean(spark, d).select("row_id", "label"), "label", "row_id")
    grown = R.random_oversample(ranked, R.target_quota(ranked, "label", "Bot", 0.5), "label")
    return grown.groupBy("row_id", "label").agg(F.count("*").alias("copies"))


@query("minority_targets", f"with {CLEAN}, c as (select label, count(*) as n from clean group by label) select label, n, greatest(n, floor((select max(n) from c) * 0.3::double)::bigint) as goal from c")
def _(spark, d):
    """Rows to which each class but the largest is raised: 30 % of the largest."""
    return I.minority_targets(clean(spark, d), "label")
