"""Queries over robustness checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import robust as B
from ..sources import captures
from .catalog import query
from .q_clean import clean
from .views import CLEAN, FLOWS, flows, preds, table
from .views import PREDS as _PREDS

_RULE_SQL = "case when v >= 60 then 2 when v >= 25 then 1 else 0 end"


@query("label_conflicts", "select l_quantity, l_discount, l_tax, l_linenumber, count(*) as n_rows, string_agg(distinct l_returnflag, ',' order by l_returnflag) as labels from lineitem group by all having count(distinct l_returnflag) > 1")
def _(spark, d):
    return B.label_conflicts(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_returnflag")


_TV = "a as (select event_type as label, count(*) as x from events where ts < timestamp '2024-01-16' group by 1), b as (select event_type as label, count(*) as y from events where ts >= timestamp '2024-01-16' group by 1), tv as (select round(sum(abs(coalesce(x, 0) / (select sum(x) from a)::double - coalesce(y, 0) / (select sum(y) from b)::double)) / 2, 9) as tv from a full join b using (label))"


def _tv(spark, d):
    e = table(spark, d, "events")
    return B.label_shift_tv(e.where("ts < timestamp'2024-01-16'"), e.where("ts >= timestamp'2024-01-16'"), "event_type").select(F.round("tv", 9).alias("tv"))


@query("label_shift_tv", f"with {_TV} select tv from tv")
def _(spark, d):
    return _tv(spark, d)


_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
_PROFILE = " union all ".join(f"select '{c}' as \"column\", quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from lineitem where l_shipdate < timestamp '1996-01-01'" for c in _COLS)
_IQR = f'pr as (select "column", q1 - 0.5 * (q3 - q1) as lower, q3 + 0.5 * (q3 - q1) as upper from ({_PROFILE}))'


def _profile(spark, d):
    return B.iqr_profile(table(spark, d, "lineitem").where("l_shipdate < timestamp'1996-01-01'"), _COLS, 0.5)


@query("iqr_profile", f'with {_IQR} select "column", round(lower, 6) as lower, round(upper, 6) as upper from pr')
def _(spark, d):
    return _profile(spark, d).select("column", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


_OUT = " + ".join(f"(not isfinite({c}) or {c} < (select lower from pr where \"column\" = '{c}') or {c} > (select upper from pr where \"column\" = '{c}'))::int" for c in _COLS)


@query("ood_flags", f"with {_IQR}, o as (select l_returnflag, ({_OUT}) / 3.0::double as outside from lineitem) select l_returnflag, round(outside, 6) as outside, outside > 0.1 as ood, count(*) as n from o group by all")
def _(spark, d):
    f = B.ood_flags(table(spark, d, "lineitem"), _profile(spark, d), _COLS)
    return f.groupBy("l_returnflag", F.round("outside", 6).alias("outside"), "ood").agg(F.count("*").alias("n"))


@query("perturb", f"with {FLOWS} select row_id, greatest(0, least(100, f_value + case when row_id % 2 = 0 then 1 else -1 end * 0.1::double * greatest(abs(f_value), 1))) as f_value from flows")
def _(spark, d):
    return B.perturb(flows(spark, d).select("row_id", "f_value"), ["f_value"], 0.1, "row_id", {"f_value": (0, 100)})


@query("flip_rate", f"with {_PREDS} select round(avg((a.y_pred <> b.y_pred)::int), 9) as flip_rate from preds a join preds b using (row_id) where a.model = 0 and b.model = 2")
def _(spark, d):
    p = preds(spark, d)
    return B.flip_rate(p.where("model = 0"), p.where("model = 2"), "row_id", "y_pred").select(F.round("flip_rate", 9).alias("flip_rate"))


_EPS = [0.01, 0.05, 0.2]
_EVASION = f"""{CLEAN}, base as (select row_id, f_value::double as v0, case when f_value::double + (row_id % 3 - 1) * 5 >= 60 then 2 when f_value::double + (row_id % 3 - 1) * 5 >= 25 then 1 else 0 end as y_true from clean),
runs as (select e, y_true, {_RULE_SQL} as y_pred from (select e, y_true, v0 + case when row_id % 2 = 0 then 1 else -1 end * e * greatest(abs(v0), 1) as v from base, (values (0.0::double), (0.01::double), (0.05::double), (0.2::double)) t(e))),
g as (select e, y, count(*) filter (where y_true = y) as s, count(*) filter (where y_pred = y) as p, count(*) filter (where y_true = y and y_pred = y) as tp from runs, (values (0),(1),(2)) l(y) group by all),
r as (select e, y, s, coalesce(tp / nullif(s, 0)::double, 0) as rec, coalesce(tp / nullif(p, 0)::double, 0) as pre from g),
f as (select e, avg(coalesce(2 * pre * rec / nullif(pre + rec, 0), 0)) as f1 from r group by e),
w as (select a.e, max(b.rec - a.rec) as wd from r a join r b on a.y = b.y and b.e = 0 where a.s > 0 group by a.e),
ev as (select f.e as epsilon, round(f1, 8) as f1_macro, round(wd, 8) as worst_drop, f1 >= 0.9 * (select f1 from f where e = 0) and wd <= 0.15 as passed from f join w on f.e = w.e where f.e > 0)"""


def _evasion(spark, d):
    rule = lambda c: F.when(c >= 60, 2).when(c >= 25, 1).otherwise(0)
    base = clean(spark, d).select("row_id", F.col("f_value").cast("double").alias("v")).withColumn("y_true", rule(F.col("v") + (F.col("row_id") % 3 - 1) * 5))
    r = B.evasion_report(base, ["v"], "row_id", lambda df: rule(F.col("v")), _EPS, [0, 1, 2])
    return r.select("epsilon", F.round("f1_macro", 8).alias("f1_macro"), F.round("worst_drop", 8).alias("worst_drop"), "passed")


@query("evasion_report", f"with {_EVASION} select * from ev")
def _(spark, d):
    return _evasion(spark, d)


@query(
    "robustness_report",
    f"""with {_EVASION}, {_TV}, cf as (select count(*) as n from (select 1 from lineitem group by l_quantity, l_discount, l_tax, l_linenumber having count(distinct l_returnflag) > 1))
select 'conflict_groups' as check_name, n::double as value, n = 0 as passed from cf
union all select 'label_shift', tv, tv <= 0.1 from tv
union all select 'evasion_' || epsilon::varchar, f1_macro, passed from ev""",
)
def _(spark, d):
    """All checks as rows: name, value, whether it passes."""
    c = B.label_conflicts(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_returnflag").agg(F.count("*").alias("n"))
    rows = c.select(F.lit("conflict_groups").alias("check_name"), F.col("n").cast("double").alias("value"), (F.col("n") == 0).alias("passed"))
    shift = _tv(spark, d).select(F.lit("label_shift"), "tv", F.col("tv") <= 0.1)
    ev = _evasion(spark, d).select(F.concat(F.lit("evasion_"), F.col("epsilon").cast("string")), "f1_macro", "passed")
    return rows.union(shift).union(ev)


_SPLIT = "l_shipdate < timestamp '1996-01-01'"


@query(
    "robustness_summary",
    f"""with {_EVASION}, {_IQR}, o as (select ({_OUT}) / 3.0::double > 0.1 as ood from lineitem where not ({_SPLIT})),
cf as (select count(*) as n from (select 1 from lineitem where {_SPLIT} group by {", ".join(_COLS)} having count(distinct l_returnflag) > 1)),
x as (select l_returnflag as label, count(*) as n from lineitem where {_SPLIT} group by 1), y as (select l_returnflag as label, count(*) as n from lineitem where not ({_SPLIT}) group by 1),
s as (select round(sum(abs(coalesce(x.n, 0) / (select sum(n) from x)::double - coalesce(y.n, 0) / (select sum(n) from y)::double)) / 2, 9) as tv from x full join y using (label))
select 'conflict_groups' as check_name, n::double as value, n = 0 as passed from cf
union all select 'label_shift', tv, tv <= 0.1 from s
union all select 'ood_share', round(avg(ood::int), 9), round(avg(ood::int), 9) <= 0.1 from o
union all select 'evasion_' || epsilon::varchar, f1_macro, passed from ev""",
)
def _(spark, d):
    """The whole report on early against late lines, written as JSON and read back."""
    t = table(spark, d, "lineitem").select(*_COLS, "l_returnflag", "l_shipdate")
    early = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")
    report = B.robustness_report(t.where(early), t.where(~early), _COLS, "l_returnflag", _profile(spark, d), _evasion(spark, d))
    path = captures.scratch_path(spark, "robustness")
    report.coalesce(1).write.json(path)  # a row a check
    return spark.read.schema(report.schema).json(path)
