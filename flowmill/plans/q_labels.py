"""Queries over label functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from .catalog import query
from .views import FLOWS, LABELED, flows

_NORM = "coalesce(lower(trim(regexp_replace(regexp_replace(label_raw, '[\\x00-\\x1f\\x7f-\\x{9f}\\x{fffd}]+', ' ', 'g'), '\\s+', ' ', 'g'))), '')"
_MULTI = "case " + " ".join(f"when k = '{k}' then '{v}'" for k, v in L.EXACT.items()) + " " + " ".join(f"when starts_with(k,'{k}') then '{v}'" for k, v in L.PREFIXES) + " else 'Other' end"
_ALIAS = "coalesce(case " + " ".join(f"when a = '{k}' then '{v}'" for k, v in L.ALIASES.items()) + " end, trim(label_raw))"
_KEYED = f"{FLOWS}, keyed as (select *, {_NORM} as k from flows)"


@query("normalize_label", f"with {_KEYED} select label_raw, k as label_norm, count(*) as n from keyed group by all")
def _(spark, d):
    return L.normalize_labels(flows(spark, d).groupBy("label_raw").agg(F.count("*").alias("n")), "label_raw", "label_norm").select("label_raw", "label_norm", "n")


@query("map_multiclass", f"with {_KEYED} select label, count(*) as n from (select {_MULTI} as label from keyed) group by all")
def _(spark, d):
    return flows(spark, d).groupBy(L.map_to_multiclass(L.normalize_label(F.col("label_raw"))).alias("label")).agg(F.count("*").alias("n"))


@query("map_binary", f"with {_KEYED} select case when k = 'benign' then 'Normal' else 'Attack' end as label, count(*) as n from keyed group by all")
def _(spark, d):
    return flows(spark, d).groupBy(L.map_to_binary(L.normalize_label(F.col("label_raw"))).alias("label")).agg(F.count("*").alias("n"))


@query(
    "label_audit",
    f"""with {_KEYED}, m as (select label_raw, {_MULTI} as label from keyed),
per as (select 'class' as kind, label as name, count(*) as n from m group by label),
other as (select 'other' as kind, label_raw as name, count(*) as n from m where label = 'Other' group by label_raw order by n desc, name limit 5)
select * from per union all select * from other""",
)
def _(spark, d):
    """Rows of each class, and the five commonest raw labels without one."""
    m = flows(spark, d).select("label_raw", L.map_to_multiclass(L.normalize_label(F.col("label_raw"))).alias("label"))
    per = m.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("class").alias("kind"), F.col("label").alias("name"), "n")
    other = m.where("label = 'Other'").groupBy("label_raw").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label_raw").limit(5)
    return per.union(other.select(F.lit("other"), "label_raw", "n"))


@query("normalize_label_combined", f"with {LABELED} select label, count(*) as n from labeled group by label")
def _(spark, d):
    return flows(spark, d).groupBy(L.combined_family(F.col("label_raw")).alias("label")).agg(F.count("*").alias("n"))


@query("alias_label", f"with {FLOWS}, a as (select label_raw, lower(trim(regexp_replace(label_raw, '\\s+', ' ', 'g'))) as a from flows) select {_ALIAS} as label, count(*) as n from a group by all")
def _(spark, d):
    return flows(spark, d).groupBy(L.alias_label(F.col("label_raw")).alias("label")).agg(F.count("*").alias("n"))


@query("normalize_raw_label", f"with {FLOWS} select trim(regexp_replace(regexp_replace(label_raw, '[^\\x20-\\x7E]', ' ', 'g'), ' +', ' ', 'g')) as label, count(*) as n from flows group by all")
def _(spark, d):
    return flows(spark, d).groupBy(L.normalize_raw_label(F.col("label_raw")).alias("label")).agg(F.count("*").alias("n"))


@query("encode_labels", f"with {LABELED} select label, (dense_rank() over (order by label) - 1)::int as code, count(*) as n from labeled group by label")
def _(spark, d):
    """Codes in alphabetical order, from the distinct labels (a few rows)."""
    from pyspark.sql import Window

    counts = flows(spark, d).groupBy(L.combined_family(F.col("label_raw")).alias("label")).agg(F.count("*").alias("n"))
    return counts.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).alias("code"), "n")
